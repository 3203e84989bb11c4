"""Merkle manifest of a table, and membership proofs by a recursive query.

Every row is a leaf: the SHA-256 of its fields. The leaves of a group (a source), in the order of their ids, are
hashed in runs of ``FAN`` consecutive nodes, level by level, until one node is left, the group's subroot; subroots
in the order of the groups make the top tree in the same way, whose last node is the root. The runs of all levels
are stored as rows linked to their parents: each has the digests of its nodes, and the run and place in which its
own digest stands.

A proof climbs those rows with one recursive SQL query. Its anchor has a row per leaf with the digest to be tested;
each step joins the run that the row stands in, appends the siblings there, folds the digest into that of the run
and goes on to the parent, until no run is left. A step appends siblings as a reference (run, place): all leaves of
a run share the siblings above it, which are written out once a run after the climb. Runs that more than one leaf in
``SHARE`` passes (a bounded number a level) are broadcast; so a hot group, or the top, which all pass, moves no rows
to one task.

Defined cases: a null field is '-'; a null group comes first; null ids come first in their group; rows that repeat an
id are leaves of their own, ordered by leaf digest; the only leaf of a group is its subroot, a single subroot is the
root, and a row without siblings has the proof of an empty text; an empty table has no rows and no root; texts of any
length are hashed whole; columns that are not among the fields do not matter, whatever their names.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SHARE, join_counted, numbered, read, small, stored

FAN = 16
TOP = -1  # number of the tree above the groups
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Manifest:
    """Stored tables: ``leaves`` (at, doc_id, group_key, leaf, tree, level, run, place and carried columns), ``runs``
    (tree, level, run, nodes, hash, n_leaves, up_tree, up_level, up_run, up_place) and ``groups`` (group_key, tree, n, subroot)."""

    leaves: DataFrame
    runs: DataFrame
    groups: DataFrame
    root: str | None


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields, each with its byte count; ``-`` stands for null."""
    return F.sha2(F.concat(*map(field, fields)), 256)


def digest(nodes: Column) -> Column:
    return F.sha2(F.array_join(nodes, ""), 256)


def parent(nodes: DataFrame, tops: int) -> DataFrame:
    """Where nodes (tree, level, at, n nodes on their level) stand: run and place, of the top tree for a subroot, null for the root."""
    alone, above = F.col("n") == 1, F.lit(tops > 1) & (F.col("tree") != TOP)
    pick = lambda own, top: F.when(~alone, own).when(above, top)
    return nodes.withColumns({"__t": pick(F.col("tree"), F.lit(TOP)), "__l": pick(F.col("level"), F.lit(0)),
                              "__r": pick(F.floor(F.col("at") / FAN), F.floor(F.col("tree") / FAN)),
                              "__p": pick(F.col("at") % FAN, F.col("tree") % FAN)})


def grouped_runs(nodes: DataFrame, level: int) -> DataFrame:
    """Runs of the nodes (tree, at, n, hash, n_leaves) of one level."""
    return (nodes.groupBy("tree", F.floor(F.col("at") / FAN).alias("run"))
            .agg(F.array_sort(F.collect_list(F.struct("at", "hash")))["hash"].alias("nodes"), F.max("n").alias("n"),
                 F.sum("n_leaves").alias("n_leaves"))
            .select("tree", F.lit(level).alias("level"), "run", "nodes", digest(F.col("nodes")).alias("hash"),
                    F.ceil(F.col("n") / FAN).alias("n"), "n_leaves"))


def build_levels(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Stored runs of every level of trees with up to ``most`` leaves, and the last node of each tree."""
    level, runs, last = 0, [], [nodes.where("n = 1").select("tree", "hash")]
    while most > 1:
        made = stored(grouped_runs(nodes.where("n > 1"), level), f"runs-{level}")
        runs.append(made)
        nodes = made.select("tree", F.col("run").alias("at"), "n", "hash", "n_leaves")
        last.append(nodes.where("n = 1").select("tree", "hash"))
        most, level = -(-most // FAN), level + 1
    return runs, reduce(DataFrame.unionByName, last)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source",
             **carried: Column) -> Manifest:
    """Build the tree of ``docs`` level by level; ``carried`` are further columns of the leaves, such as digests to be tested."""
    quoted = [F.col(f"`{c}`") for c in fields]
    rows = stored(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{group_col}`").alias("group_key"),
                              leaf_digest(quoted).alias("leaf"), *[e.alias(c) for c, e in carried.items()]), "leaf-digests")
    order = [F.col("group_key").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    rows = numbered(rows, order, "leaves")
    groups = rows.groupBy("group_key").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = stored(numbered(groups, [F.col("first")], "groups-in-order", "tree"), "groups")
    tops, most = groups.agg(F.count(F.lit(1)), F.max("n")).first()
    named = lambda df: df.withColumn("__g", F.coalesce(F.concat(F.lit("="), F.col("group_key").cast("string")), F.lit("-")))
    side = small(named(groups).select(F.col("__g").alias("__gk"), "tree", "first", "n"))
    leaves = named(rows).join(side, F.col("__g") == F.col("__gk")).withColumns({"row": F.col("at"), "level": F.lit(0)})
    leaves = parent(leaves.withColumn("at", F.col("at") - F.col("first")), tops)
    leaves = stored(leaves.select("row", "doc_id", "group_key", "leaf", *carried, F.col("tree").alias("own_tree"), "at", "n",
                                  F.col("__t").alias("tree"), F.col("__l").alias("level"), F.col("__r").alias("run"),
                                  F.col("__p").cast("int").alias("place")), "leaf-rows")
    nodes = leaves.select(F.col("own_tree").alias("tree"), "at", "n", F.col("leaf").alias("hash"), F.lit(1).cast("long").alias("n_leaves"))
    runs, subroots = build_levels(nodes, most or 0)
    subroots = stored(subroots, "subroots")
    of_tree = groups.select(F.col("tree").alias("__n"), "n")
    top = subroots.join(of_tree, F.col("tree") == F.col("__n")).select(
        F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(tops).alias("n"), "hash", F.col("n").alias("n_leaves"))
    above, root = build_levels(top, tops)
    root = root.first()
    every = runs + above
    empty = ("tree long, level int, run long, nodes array<string>, hash string, n long, n_leaves long")
    every = reduce(DataFrame.unionByName, every) if every else docs.sparkSession.createDataFrame([], empty)
    linked = parent(every.withColumns({"at": F.col("run"), "own": F.col("level"), "level": F.col("level") + 1}), tops)
    linked = stored(linked.select("tree", F.col("own").alias("level"), "run", "nodes", "hash", "n_leaves", F.col("__t").alias("up_tree"),
                                  F.col("__l").alias("up_level"), F.col("__r").alias("up_run"),
                                  F.col("__p").cast("int").alias("up_place")), "runs")
    subroots = subroots.select(F.col("tree").alias("__n"), F.col("hash").alias("subroot"))
    groups = stored(groups.join(subroots, F.col("tree") == F.col("__n")).select("group_key", "tree", "n", "subroot"), "group-roots")
    return Manifest(leaves, linked, groups, root["hash"] if root else None)


@contextmanager
def unlimited_recursion(spark: SparkSession):
    """Let a recursive query have as many rows as there are leaves; levels are few."""
    key = "spark.sql.cteRecursionRowLimit"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)


CLIMB = """
with recursive climb(row, folded, tree, level, run, place, steps) as (
  select row, folded, tree, level, run, place, cast(array() as array<struct<tree: bigint, level: int, run: bigint, place: int>>)
  from {anchor}
  union all
  select row, sha2(array_join(array_insert(array_compact(transform(nodes, (x, i) -> if(i = place, null, x))), place + 1, folded), ''), 256),
    up_tree, up_level, up_run, up_place, steps || array(named_struct('tree', tree, 'level', level, 'run', run, 'place', place))
  from (
    select c.row, c.folded, c.tree, c.level, c.run, c.place, c.steps, coalesce(h.at, l.at) up,
      up.nodes, up.up_tree, up.up_level, up.up_run, up.up_place
    from (select * from climb where run is not null) c
    left join {heavy} h on c.tree = h.tree and c.level = h.level and c.run = h.run
    left join {light} l on c.tree = l.tree and c.level = l.level and c.run = l.run
      and case when h.at is null then 0 else 1 + pmod(xxhash64(c.row), 1000000) end = l.zero))
select row, folded, steps from climb where run is null"""


def climb(m: Manifest, tested: str = "leaf") -> DataFrame:
    """A stored row per leaf: row, folded (the root that follows from its digest ``tested``) and steps (run and place, upwards)."""
    spark, total = m.leaves.sparkSession, m.leaves.count()
    at = F.struct("nodes", "up_tree", "up_level", "up_run", "up_place").alias("at")
    # fewer than SHARE heavy runs a level; levels are logarithmic
    heavy = F.broadcast(m.runs.where(F.col("n_leaves") > total // SHARE).select("tree", "level", "run", at))
    light = m.runs.where(F.col("n_leaves") <= total // SHARE).select("tree", "level", "run", at, F.lit(0).cast("long").alias("zero"))
    anchor = m.leaves.select("row", F.col(tested).alias("folded"), "tree", "level", "run", "place")
    with unlimited_recursion(spark):
        return stored(spark.sql(CLIMB, anchor=anchor, heavy=heavy, light=light), "climb")


def siblings(nodes: Column, place: Column) -> Column:
    """The digests of a run without the one at ``place``, as one text."""
    return F.array_join(F.array_compact(F.transform(nodes, lambda x, i: F.when(i != place, x))), "")


def written_out(m: Manifest, climbed: DataFrame) -> DataFrame:
    """row, proof_sha256: the siblings that the steps of each row refer to, level by level.

    The steps above a leaf's own run are the same for all its leaves: those of the leaf at place 0 are written out.
    """
    first = F.get("steps", F.lit(0))
    key = lambda tree, level, run: F.concat_ws(":", tree, level, run)
    runs = m.runs.select(key("tree", "level", "run").alias("ref"), "nodes")
    one = climbed.where(first["place"] == 0).select(
        key(first["tree"], first["level"], first["run"]).alias("own"), F.posexplode(F.slice("steps", 2, F.size("steps"))).alias("k", "s"))
    one = stored(one.select("own", "k", key("s.tree", "s.level", "s.run").alias("ref"), F.col("s.place").alias("place")), "steps")
    refs = one.groupBy("ref").agg(F.count(F.lit(1)).alias("n"))
    named = runs.withColumnRenamed("ref", "__r").join(refs, F.col("__r") == F.col("ref")).select("ref", "nodes", "n")
    above = join_counted(one, stored(named, "passed-runs"), "ref", "n", one.count())
    above = above.groupBy("own").agg(F.array_join(F.array_sort(F.collect_list(
        F.struct("k", siblings(F.col("nodes"), F.col("place")).alias("s"))))["s"], "").alias("above"))
    own = runs.select(F.col("ref").alias("own"), F.col("nodes").alias("here"))
    full = own.join(above.withColumnRenamed("own", "__o"), F.col("own") == F.col("__o"), "left").select(
        "own", "here", F.coalesce("above", F.lit("")).alias("above"))
    rows = climbed.select("row", key(first["tree"], first["level"], first["run"]).alias("__w"), first["place"].alias("place"),
                          (F.size("steps") == 0).alias("none"))
    proof = F.concat(siblings(F.col("here"), F.col("place")), F.col("above"))
    return rows.join(full, F.col("__w") == F.col("own"), "left").select(
        F.col("row").alias("__row"), F.sha2(F.coalesce(proof, F.lit("")), 256).alias("proof_sha256"))


def verify(m: Manifest, tested: str = "leaf") -> DataFrame:
    """One row per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root from the digest in column ``tested``, verified."""
    up = climb(m, tested)
    up = up.select(F.col("row").alias("__r"), "folded", "steps")
    proofs = written_out(m, up.select(F.col("__r").alias("row"), "steps"))
    told = up.select("__r", "folded").join(proofs, F.col("__r") == F.col("__row"))
    side = small(m.groups.select(F.col("tree").alias("__n"), "subroot"))
    out = m.leaves.join(told, F.col("row") == F.col("__r")).join(side, F.col("own_tree") == F.col("__n"))
    root = F.lit(m.root).cast("string")
    return out.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", F.col("folded").alias("folded_root"),
                      (F.col("folded") == root).alias("verified"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth document, by the checksum of its id, is tested with its text in lower case."""
    docs = read(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lower = F.translate("text", *AZ)
    changed = leaf_digest([lower if c == "text" else F.col(c) for c in FIELDS])
    return verify(manifest(docs, tested=F.when(chosen, changed).otherwise(leaf_digest([F.col(c) for c in FIELDS]))), "tested")


# crc32 of the decimal text of an id, bit by bit
CRC32 = ("xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split({0}::varchar, ''), "
         "lambda ch: [ascii(ch)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, e: case when e >= 0 then xor(c, e) "
         "when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end), 4294967295)")
_FIELD = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in FIELDS)
_LOWER = f"translate(text, '{AZ[0]}', '{AZ[1]}')"
QUERIES = {"op13_merkle": op13_merkle}
ORACLES = {"op13_merkle": f"""
with recursive d as (select doc_id, source, sha256({_LEAF}) leaf,
    sha256({_LEAF.replace(_FIELD.format('text'), _FIELD.format(_LOWER))}) lower_leaf,
    coalesce({CRC32.format('doc_id')} % 5 = 0, false) chosen from documents),
l as (select *, dense_rank() over (order by source nulls first) - 1 tree, count(*) over (partition by source) n,
    row_number() over (partition by source order by doc_id nulls first, leaf) - 1 place from d),
lower_nodes(tree, level, place, n, hash) as (
  select tree, 0::bigint, place, n, leaf from l
  union all
  select tree, level + 1, place // {FAN}, (max(n) + {FAN - 1}) // {FAN}, sha256(string_agg(hash, '' order by place))
  from lower_nodes where n > 1 group by tree, level, place // {FAN}),
subroots as (select tree, hash from lower_nodes where n = 1),
upper_nodes(level, place, n, hash) as (
  select 0::bigint, tree, (select count(*) from subroots), hash from subroots
  union all
  select level + 1, place // {FAN}, (max(n) + {FAN - 1}) // {FAN}, sha256(string_agg(hash, '' order by place))
  from upper_nodes where n > 1 group by level, place // {FAN}),
depth as (select tree, max(level) depth from lower_nodes group by tree),
nodes as (select tree, level, place, hash from lower_nodes where n > 1
  union all select u.tree, u.depth + level, place, hash from upper_nodes, depth u where n > 1),
ids as (select row_number() over (order by tree, place) row, * from l),
way as (select row, i.tree, level, case when level < depth then i.place // ({FAN} ** level)::bigint else i.tree // ({FAN} ** (level - depth))::bigint end place
  from ids i join depth using (tree) join (select distinct tree, level from nodes) using (tree)),
beside as (select row, w.level, string_agg(n.hash, '' order by n.place) filter (n.place < w.place) before,
    string_agg(n.hash, '' order by n.place) filter (n.place > w.place) behind,
    string_agg(n.hash, '' order by n.place) filter (n.place <> w.place) others
  from way w join nodes n on n.tree = w.tree and n.level = w.level and n.place // {FAN} = w.place // {FAN} group by row, w.level),
folds(row, level, hash) as (
  select row, 0::bigint, case when chosen then lower_leaf else leaf end from ids
  union all
  select f.row, f.level + 1, sha256(coalesce(before, '') || hash || coalesce(behind, ''))
  from folds f join beside b on f.row = b.row and f.level = b.level),
folded as (select row, max_by(hash, level) hash from folds group by row),
proofs as (select row, string_agg(others, '' order by level) others from beside group by row),
root as (select hash from upper_nodes where n = 1)
select doc_id, leaf, s.hash subroot, r.hash root, sha256(coalesce(others, '')) proof_sha256, f.hash folded_root, f.hash = r.hash verified
from ids i join subroots s using (tree) join folded f on f.row = i.row left join proofs p on p.row = i.row, root r"""}
