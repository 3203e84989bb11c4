r"""Secret scan with corpus-wide ownership frequency.

Three base kinds are matched in every whole text; a further kind (``token``: long runs that mix digits, upper
and lower case) supplies candidates that are reported only if the corpus shows them to be one owner's. For each
candidate the digest of its value is counted over distinct repositories and owners: a value with many owners
is a widely copied example, one with a single owner, few repositories and varied characters looks live; what one owner
has in many repositories stays unclear.

Positions come from the text between the matches: the running sum of the lengths of gaps and matches gives the
start of each, in code points. The texts are read once; everything later works on the matches.

Defined cases: a null text is empty and has no spans; a null repository or owner counts as none; equal spans of
one kind cannot occur; rows that repeat an id each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_counted, read, stored


@dataclass(frozen=True)
class Kind:
    """A pattern, the group that holds the value, and how long the value must be."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = True
    probe: str = ""  # a pattern that every match worth keeping contains; defaults to the pattern


# fixed values: the base patterns of the contract, in its order
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (
    Kind("assign", ASSIGN, group=2, least=8, probe=ASSIGN[:-2] + "{8,})"),
    # a match that is too short ends where its run of characters ends, so asking for the length at once is the same
    Kind("access", r"AKIA[A-Z0-9]{12,}"),
    Kind("hex", r"[0-9a-f]{32,}"),
    Kind("token", r"[A-Za-z0-9+/_=-]{20,}", base=False),
)
# Values that documentation uses as stand-ins.
PLACEHOLDER = r"(?i)example|changeme|placeholder|dummy|your|xxxx|0000|1234567"
OWNERS = 3  # a value with this many owners is a copied example
REPOS = 4  # a value in this many repositories of one owner is the owner's own boilerplate
VARIED = 8  # distinct characters of a value that looks live
MIXED = 12  # distinct characters of a further token


def matches(text: Column, kind: Kind, number: int) -> Column:
    """Array of (kind, i, gap, m, g): the i-th match, the length of the text before it, its value."""
    p = F.lit(kind.pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    value = F.regexp_extract_all(text, p, F.lit(kind.group)) if kind.group else whole
    gaps = F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(whole))
    rows = F.zip_with(gaps, F.arrays_zip(whole.alias("m"), value.alias("g")), lambda gap, x: F.struct(
        F.lit(number).alias("kind"), F.length(gap).alias("gap"), F.length(x["m"]).alias("len"), x["g"].alias("value")))
    none = F.array().cast("array<struct<kind:int,gap:int,len:int,value:string>>")
    return F.when(text.rlike(kind.probe or kind.pattern), rows).otherwise(none)


def distinct_chars(c: Column) -> Column:
    return F.size(F.array_distinct(F.split(c, "")))


def is_mixed(v: Column) -> Column:
    return v.rlike("[0-9].*[0-9]") & v.rlike("[a-z].*[a-z]") & v.rlike("[A-Z].*[A-Z]") & (distinct_chars(v) >= MIXED)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None,
         owner: Column | None = None, kinds: tuple[Kind, ...] = KINDS,
         owners: int = OWNERS) -> tuple[DataFrame, DataFrame]:
    """(rows, candidates): a row id and document id per row; all candidates with span, value, counts and verdict."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = stored(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
        (F.lit(None) if repo is None else repo).cast("string").alias("repo"),
        (F.lit(None) if owner is None else owner).cast("string").alias("owner"),
        F.concat(*[matches(text, k, n) for n, k in enumerate(kinds)]).alias("found")), "secrets-found")
    upto = Window.partitionBy("row", "kind").orderBy("i")
    base, least = [k.base for k in kinds], [k.least for k in kinds]
    is_base = F.array(*map(F.lit, base))[F.col("kind")]
    spans = (found.where(F.size("found") > 0).select("row", "doc_id", "repo", "owner", F.posexplode("found"))
             .select("row", "doc_id", "repo", "owner", F.col("pos").alias("i"), "col.*")
             .withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).withColumn("start", F.col("end") - F.col("len"))
             .where(F.length("value") >= F.array(*map(F.lit, least))[F.col("kind")])
             .where(is_base | is_mixed(F.col("value"))))
    # a further token that touches a base span adds nothing
    by_start = Window.partitionBy("row").orderBy("start", "kind")
    before = F.max(F.when(is_base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(is_base, F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    spans = (spans.withColumns({"before": before, "after": after})
             .where(is_base | ((F.coalesce("before", F.lit(0)) <= F.col("start"))
                               & (F.coalesce("after", F.col("end")) >= F.col("end"))))
             .select("row", "doc_id", "repo", "owner", "kind", is_base.alias("base"), "start", "end",
                     F.sha2("value", 256).alias("value_sha256"), distinct_chars(F.col("value")).alias("varied"),
                     F.col("value").rlike(PLACEHOLDER).alias("placeholder")))
    spans = stored(spans, "secrets-spans")
    counts = stored(spans.groupBy("value_sha256", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
                    .groupBy("value_sha256").agg(F.sum("n").alias("n"), F.countDistinct("repo").alias("repos"),
                                                 F.countDistinct("owner").alias("owners")), "secrets-counts")
    verdict = (F.when((F.col("owners") >= owners) | F.col("placeholder"), "example")
               .when((F.col("owners") <= 1) & (F.col("repos") < REPOS) & (F.col("varied") >= VARIED), "live").otherwise("unclear"))
    told = join_counted(spans, counts, "value_sha256", "n", spans.count()).withColumn("verdict", verdict)
    return found.select("row", "doc_id"), told.where("base or verdict = 'live'")


def report(rows: DataFrame, spans: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """One row per document: counts by kind and verdict, base digest and all spans."""
    none = [F.lit(None).cast(t).alias(c) for c, t in (("kind", "int"), ("start", "long"), ("end", "long"), ("verdict", "string"))]
    all_rows = rows.select("row", "doc_id", *none).unionByName(spans.select("row", "doc_id", "kind", "start", "end", "verdict"))
    of = lambda i: F.count(F.when(F.col("kind") == i, 1))
    names = F.array(*[F.lit(k.name) for k in kinds])
    told = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    is_base = F.array(*[F.lit(k.base) for k in kinds])
    return (all_rows.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), *[of(i).alias(f"n_{k.name}") for i, k in enumerate(kinds)],
        F.count(F.when(F.col("verdict") == "live", 1)).alias("n_live"),
        F.count(F.when(F.col("verdict") == "example", 1)).alias("n_example"),
        F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end")))).alias("s"))
        .select("doc_id", *[f"n_{k.name}" for k in kinds], "n_live", "n_example",
                F.sha2(told(F.filter("s", lambda s: is_base[s["kind"]])), 256).alias("base_sha256"), told(F.col("s")).alias("spans")))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner of a document is its source; a repository is a source in one language."""
    docs = read(spark, sf_dir, "documents")
    return report(*scan(docs, repo=F.concat_ws("/", "source", "lang"), owner=F.col("source")))


def _oracle() -> str:
    q = lambda s: s.replace("'", "''")
    parts = []
    for n, k in enumerate(KINDS):
        parts.append(f"""select doc_id, source, lang, {n} kind, generate_subscripts(m, 1) i, unnest(m) m, unnest(g) g,
          unnest(list_slice(p, 1, len(m))) gap from (select doc_id, source, lang,
          regexp_extract_all(t, '{q(k.pattern)}', 0) m, regexp_extract_all(t, '{q(k.pattern)}', {k.group}) g,
          string_split_regex(t, '{q(k.pattern)}') p from d)""")
    least = " ".join(f"when {n} then {k.least}" for n, k in enumerate(KINDS))
    name = " ".join(f"when {n} then '{k.name}'" for n, k in enumerate(KINDS))
    mixed = (f"regexp_matches(g, '[0-9].*[0-9]') and regexp_matches(g, '[a-z].*[a-z]') "
             f"and regexp_matches(g, '[A-Z].*[A-Z]') and len(list_distinct(string_split(g, ''))) >= {MIXED}")
    told = "string_agg(name || ':' || b || ':' || e, ',' order by b, kind)"
    return f"""
with d as (select doc_id, source, lang, coalesce(text, '') t from documents),
m as ({' union all '.join(parts)}),
p as (select *, sum(length(gap) + length(m)) over (partition by doc_id, kind order by i) e from m),
s as (select *, e - length(m) b, kind < 3 base, case kind {name} end as name from p
      where length(g) >= case kind {least} end and (kind < 3 or ({mixed}))),
k as (select * from s x where base or not exists (select 1 from s y where y.base and y.doc_id = x.doc_id and y.b < x.e and y.e > x.b)),
f as (select g, count(distinct source) owners, count(distinct concat_ws('/', source, lang)) repos from k group by g),
v as (select k.*, case when owners >= {OWNERS} or regexp_matches(g, '{PLACEHOLDER}') then 'example'
        when owners <= 1 and repos < {REPOS} and len(list_distinct(string_split(g, ''))) >= {VARIED} then 'live' else 'unclear' end verdict
      from k join f using (g)),
a as (select doc_id, {', '.join(f'count(*) filter (kind = {n}) n_{k.name}' for n, k in enumerate(KINDS))},
  count(*) filter (verdict = 'live') n_live, count(*) filter (verdict = 'example') n_example,
  {told} filter (base) base, {told} spans from v where base or verdict = 'live' group by doc_id)
select doc_id, {', '.join(f'coalesce(n_{k.name}, 0) n_{k.name}' for k in KINDS)}, coalesce(n_live, 0) n_live,
  coalesce(n_example, 0) n_example, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from d left join a using (doc_id)"""


QUERIES = {"op8_secret_scan": op8_secret_scan}
ORACLES = {"op8_secret_scan": _oracle()}
