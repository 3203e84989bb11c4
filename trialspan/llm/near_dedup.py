"""Near duplicates by bottom-k sketches of one hash function.

1. Words are hashed, a text's set is its distinct word shingles, its sketch the ``K`` smallest hash values.
   Texts with equal sets form a class with a number of its own.
2. Inverted lists of retained values. A value that only one class retains joins nothing and goes. Two sets with
   the wanted similarity share at least ``SHARED`` of their retained values but for a chance below 1e-8 (binomial
   tail of the bottom-k of the union), so each class needs to enter the lists of its rarest values only:
   all but ``SHARED`` of its sketch, plus one (the prefix of the overlap filter).
3. In each list the class with the fewest values of its own is the centre; centre and members are compared on
   full sets. What is linked becomes one component. Lists that still hold several components lose the texts with
   too many shingles of their own to be linked with anything, and are compared in salted blocks; lists with nearly
   the same members are compared once. Only links come out, or pairs whose ``HEAD`` smallest shingles allow one,
   which are then verified.
4. Components are contracted. No list is cut or sampled.

Defined cases: a text without words (null, empty, white space) has an empty set, is linked with nothing and
kept; rows that repeat an id get a row each, and each of their texts has its own links; a component is named by its
smallest id, so rows without id never name one, and of a component that has no id one row is kept; very long texts are
read whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, read, small, small_batches, stored
from .components import components
from .hashing import shingles
from .pieces import slices

K = 64  # retained values
SHARED = 0.45  # share of a sketch that a linked sketch has too, for certain but for 1e-8 at a similarity of 0.8
HEAD, SLACK = 256, 0.19  # shingles of a union that tell its similarity, but for a chance below 1e-8 (Hoeffding) to be off by SLACK
BLOCK = 256  # classes of a contested list on one side of a block


def sketch_rows(docs: DataFrame, id_col: str, text_col: str, words: int, k: int) -> DataFrame:
    """(doc_id, n, set_id, sketch) per row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in slices(batch.column(1)):
                sets = shingles(texts, words)
                heads = [s[:k].view(np.int64) for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(h) for h in heads])])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(map(set_digest, sets), pa.string()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*heads, np.zeros(0, np.int64)]), pa.int64())),
                ], names=["doc_id", "n", "set_id", "sketch"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, n long, set_id string, sketch array<long>"))


def set_digest(s: np.ndarray) -> str | None:
    return hashlib.sha256(s.tobytes()).hexdigest()[:32] if len(s) else None


def full_sets(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(node, shingles) of classes (node, doc_id, set_id), from the rows that have the id of one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in slices(batch.column(0)):
                sets = shingles(texts, words)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                yield pa.RecordBatch.from_arrays([
                    pa.array(map(set_digest, sets), pa.string()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64), pa.int64()))],
                    names=["set_id", "shingles"])

    ids = classes.select(F.col("doc_id").alias("__id")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.join(small(ids), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select("text")
    sets = texts.mapInArrow(run, "set_id string, shingles array<long>").dropDuplicates(["set_id"])
    return sets.join(small(classes.select("set_id", "node")), "set_id").select("node", "shingles")


def similar(inter: Column, union: Column, percent: int) -> Column:
    return 100 * inter >= percent * union


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    for c in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")), c)
    inter = F.size(F.array_intersect("set_a", "set_b"))
    return (pairs.select("a", "b", inter.alias("i"), (F.size("set_a") + F.size("set_b")).alias("t"))
            .where(similar(F.col("i"), F.col("t") - F.col("i"), percent)).select("a", "b"))


def linkable(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``rows`` of texts that can have a link to another component, with ``lone``: shingles that no other text of ``rows`` has.

    Lone shingles are in every union and in no intersection, so a text with too many of them has no link here.
    """
    held = sets.join(rows.select("node").distinct(), "node").select("node", F.explode("shingles").alias("shingle"))
    lone = (held.groupBy("shingle").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("df")).where("df = 1")
            .groupBy("node").agg(F.count(F.lit(1)).alias("lone")))
    rows = rows.join(lone, "node", "left").withColumn("lone", F.coalesce("lone", F.lit(0)))
    rows = stored(rows.where((100 - percent) * (F.col("n") - F.col("lone")) >= percent * F.col("lone")), "linkable")
    still = rows.groupBy("value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi")
    return rows.drop("m").join(still.select("value", "m"), "value")


def contested_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components of the same list; ``rows``: value, node, n, comp, m (size of the list).

    A group of near copies meets in many lists of nearly the same members. Lists that share members form a
    cluster; where all pairs of the cluster are fewer than the pairs of its lists, the cluster is compared as one
    list, on full sets inside the join, so that only links come out. Other lists are joined one by one; a pair
    comes out of the first list it shares if its smallest shingles allow a link, and is verified.
    """
    rows = stored(linkable(rows, sets, percent), "open")
    first = rows.groupBy("node").agg(F.min("value").alias("b"))
    chains = components(rows.join(first, "node").select(F.col("value").alias("a"), "b"))
    rows = stored(rows.join(chains.select(F.col("node").alias("value"), F.col("comp").alias("chain")), "value", "left")
                  .withColumn("chain", F.coalesce("chain", "value")), "chained")
    each = rows.groupBy("chain", "value").agg(F.max("m").alias("m")).groupBy("chain").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("apart"))
    whole = rows.select("chain", "node").distinct().groupBy("chain").agg(F.count(F.lit(1)).alias("u"))
    merge = stored(each.join(whole, "chain").select("chain", "u", (F.col("u").cast("double") * F.col("u") <= F.col("apart")).alias("merged")), "merge")
    rows = rows.join(merge, "chain")
    near_size = 100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n")
    few_lone = (100 - percent) * F.least(F.col("x_n") - F.col("x_lone"), F.col("y_n") - F.col("y_lone")) >= percent * (F.col("x_lone") + F.col("y_lone"))

    def met(side: DataFrame, cols: list[str], also: Column) -> DataFrame:
        """Pairs of a list with different components, by blocks."""
        side = side.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
        as_ = lambda p: side.select("value", *[F.col(c).alias(f"{p}_{c}") for c in ("node", "comp", "n", "lone", "blocks", *cols)])
        left = as_("x").withColumn("salt", F.pmod(F.xxhash64("x_node"), F.col("x_blocks")).cast("int"))
        right = as_("y").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("y_blocks") - 1)))
        # dealt out by key here: a block is as small as it should be, splitting it further would only copy its other side
        parts = int(side.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        left, right = (x.repartition(parts, "value", "salt") for x in (left, right))
        return left.join(right.hint("merge"), ["value", "salt"]).where((F.col("x_node") < F.col("y_node")) & (F.col("x_comp") != F.col("y_comp")) & near_size & few_lone & also
                                                         ).select(F.col("x_node").alias("a"), F.col("y_node").alias("b"))

    one = rows.where("merged").select(F.col("chain").alias("value"), "node", "comp", "n", "lone", F.col("u").alias("m")).distinct().join(sets, "node")
    inter = F.size(F.array_intersect("x_shingles", "y_shingles"))
    links = stored(met(one, ["shingles"], similar(inter, F.col("x_n") + F.col("y_n") - inter, percent)), "rest-links")
    apart = stored(rows.where("not merged").select("value", "node", "comp", "n", "lone", "m"), "apart")
    if apart.isEmpty():
        return links
    its = apart.groupBy("node").agg(F.collect_list("value").alias("its"))
    its = its.join(sets.select("node", F.slice("shingles", 1, HEAD).alias("head")), "node")
    union = F.slice(F.array_sort(F.transform(F.array_union("x_head", "y_head"), unsigned)), 1, HEAD)
    of_both = F.size(F.array_intersect(union, F.transform(F.array_intersect("x_head", "y_head"), unsigned)))
    close = met(apart.join(its, "node"), ["its", "head"], (F.array_min(F.array_intersect("x_its", "y_its")) == F.col("value"))
                & (100 * of_both >= F.size(union) * (percent - 100 * SLACK)))
    close = stored(close, "rest-close")
    return links.unionByName(stored(verified(close, sets, percent), "rest-verified"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                    percent: int = 80, k: int = K, shared: float = SHARED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two texts are linked when their sets of ``words``-word shingles have a Jaccard similarity of at least
    ``percent`` / 100; ``shared`` must suit that threshold and ``k``.
    """
    told = placed_rows(docs, id_col, text_col, words, percent, k, shared)
    return told.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


def placed_rows(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, k: int = K, shared: float = SHARED) -> DataFrame:
    """(doc_id, set_id, n, component_id, kept) per row of ``docs``."""
    small_batches(docs.sparkSession)
    rows = stored(sketch_rows(docs, id_col, text_col, words, k).withColumn("row", F.monotonically_increasing_id()), "sketches")
    classes = stored(rows.where("n > 0").groupBy("set_id").agg(
        F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"),
        F.first("sketch").alias("sketch")).withColumn("node", F.monotonically_increasing_id()), "classes")

    # lists of the rarest values of each class
    held = classes.select("node", "n", F.size("sketch").alias("held"), F.explode("sketch").alias("value"))
    freq = held.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    room = F.col("held") - F.ceil(F.col("held") * shared) + 1 - (F.col("held") - F.size("common"))  # what own values leave
    rare = (held.join(freq, "value").groupBy("node").agg(
        F.first("n").alias("n"), F.first("held").alias("held"),
        F.array_sort(F.collect_list(F.struct("df", "value"))).alias("common"))
        .withColumn("room", room.cast("int")).where("room > 0")
        .select("node", "n", (F.col("held") - F.size("common")).alias("own"),
                F.explode(F.slice("common", F.lit(1), F.col("room"))).alias("x")))
    lists = stored(rare.select("node", "n", "own", F.col("x.value").alias("value")), "lists")

    # centre against members
    centres = lists.groupBy("value").agg(F.min(F.struct("own", "node", "n")).alias("c"), F.count(F.lit(1)).alias("m")).where("m > 1")
    centres = stored(centres.select("value", F.col("c.node").alias("centre"), F.col("c.n").alias("cn"), "m"), "centres")
    near_size = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    members = lists.join(centres, "value")
    listed = stored(classes.select("node", "doc_id", "set_id").join(members.select("node").distinct(), "node"), "in-lists")
    sets = stored(full_sets(docs, listed, id_col, text_col, words), "sets")
    stars = (members.where((F.col("node") != F.col("centre")) & near_size(F.col("n"), F.col("cn")))
             .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct())
    links = stored(verified(stored(stars, "stars"), sets, percent), "star-links")
    comp = components(links)

    # lists with several components
    placed = stored(lists.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "placed")
    split = stored(placed.groupBy("value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m"))
                   .where("lo <> hi").select("value", "m"), "contested")
    if not split.isEmpty():
        more = contested_links(stored(placed.join(split, "value"), "contested-rows"), sets, percent)
        comp = components(links.unionByName(more))

    classes = stored(classes.select("node", "set_id", "doc_id", "row", "rows").join(comp, "node", "left")
                     .withColumn("comp", F.coalesce("comp", "node")), "class-components")
    named = classes.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.min("row").alias("first_row"))
    ends = stored(classes.select("set_id", "rows", "comp").join(named, "comp").drop("comp"), "ends")
    told = join_counted(rows.select("doc_id", "row", "n", "set_id"), ends, "set_id", "rows", rows.count())
    told = told.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    # of a component without ids its first row
    lone = F.col("doc_id").isNull() & F.col("component_id").isNull() & ((F.col("n") == 0) | (F.col("row") == F.col("first_row")))
    return told.select("doc_id", "set_id", "n", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), lone).alias("kept"))


def unsigned(x: Column) -> Column:
    """Hash values are stored as signed numbers; flipping the sign bit gives back the order of the unsigned."""
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` but for near copies of a row with a smaller id, with all columns.

    Of rows that repeat an id and a set, or have no id, one is left. Rows whose id does not tell whether they go are
    found again by the digest of their set.
    """
    told = stored(placed_rows(docs, id_col, text_col, words, percent), "near-told")
    fate = told.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if("kept").alias("stay"))
    gone = stored(fate.where("stay = 0 and doc_id is not null").select(F.col("doc_id").alias("__id")), "gone")
    unclear = stored(fate.where("(rows > 1 and stay > 0) or doc_id is null").select(F.col("doc_id").alias("__id")), "unclear")
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__id"))
    if unclear.isEmpty():
        return docs.join(small(gone), same, "left_anti")
    out = docs.join(small(gone.unionByName(unclear)), same, "left_anti")
    again = docs.join(small(unclear), same, "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"),
                                                                 F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in slices(batch.column(2)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(
                    map(set_digest, shingles(texts, words)), pa.string())], names=["all", "__id", "__set"])

    again = again.mapInArrow(run, again.drop("__text").schema.add("__set", "string"))
    kept = told.where("kept").join(small(unclear), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    kept = kept.select(F.col("doc_id").alias("__kid"), F.col("set_id").alias("__kset")).distinct()
    found = again.join(small(stored(kept, "unclear-kept")), F.col("__id").eqNullSafe(F.col("__kid")) & F.col("__set").eqNullSafe(F.col("__kset")), "left_semi")
    # rows without words are no copies of one another
    wordless, worded = found.where("__set is null"), found.where("__set is not null").dropDuplicates(["__id", "__set"])
    return out.unionByName(wordless.unionByName(worded).select("all.*"))


def op7_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=4)


QUERIES = {"op7_bottom_k": op7_bottom_k}
ORACLES = {"op7_bottom_k": r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [hash(array_to_string(w, ' '))]
  else list_distinct(list_transform(range(1, len(w) - 2), lambda i: hash(array_to_string(w[i:i + 3], ' ')))) end s from d),
n as (select doc_id, len(s) n, s from s),
p as materialized (select doc_id, n, unnest(s) x from n),
e as materialized (select a.doc_id a, b.doc_id b from p a join p b on a.x = b.x and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r as (select doc_id v, doc_id c from n union select e.b, r.c from r join e on e.a = r.v and r.c < e.b)
select doc_id, n::bigint n_shingles, c component_id, doc_id = c kept
from n join (select v, min(c) c from r group by v) on v = doc_id"""}
