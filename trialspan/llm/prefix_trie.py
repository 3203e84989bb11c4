"""Prefix trie of conversations by fixed-length block hashing.

Turns become 128-bit digests and code point counts; only those travel. ``BLOCK`` successive turns make a block with a
digest of its own, and conversations are grouped by the blocks they begin with: a group is all that share blocks 0 to j.
Turn boundaries are looked at only in blocks where the continuations of a group differ (siblings diverge); where all go
on alike, the nodes inside the block have the members of the group. The digest of a long beginning comes from digests of
``FAN`` blocks, of ``FAN`` of those, and so on, so that no task holds a whole conversation.

Subtree sums need no walk over the trie. The smallest member of a node is its owner; going down, a conversation owns
every node from some depth on. So a node's subtree saves, for each member, the text that the member shares below the
node with smaller conversations, and has one leaf for each member that owns the leaf it ends in: both are sums over the
members of numbers that belong to a conversation alone.

Defined cases: null roles and texts are empty; turns are ordered by turn, null first, and those of equal turn by their
digest; rows without conv_id belong to no conversation; the base of a negative id follows SQL's remainder; a base that
is absent gives nothing; an empty table has no conversation and no node, not even a root; texts of any length are hashed
whole; repeated rows are turns of their own; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, numbered, read, stored
from .merkle import CRC32

BLOCK = 4  # turns
FAN = 16  # blocks, or groups of blocks, hashed together
IDS = 4096  # ids joined at a time
HEAD = 5  # most turns that are taken from a base
ROOT = ""


def short_digest(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def extended(before: Column, digests: Column) -> Column:
    """Digest of what comes after ``before``; ``before`` itself if nothing does."""
    return F.when(F.size(digests) == 0, before).otherwise(short_digest(F.concat(before, F.array_join(digests, ""))))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def turns_in_order(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, p counted from 0, dig, chars) and conversations (conv_id, first, n)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = stored(df.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", short_digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("dig"),
        F.length(text).cast("long").alias("chars")), "turn-digests")
    rows = numbered(rows, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("dig")], "turns")
    convs = stored(rows.groupBy("conv_id").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "conversations")
    rows = stored(join_counted(rows, convs, "conv_id", "n", rows.count()).select(
        "conv_id", (F.col("at") - F.col("first")).alias("p"), "dig", "chars"), "turns-numbered")
    return rows, convs


def rebuilt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv_id, p, dig, chars), and all conv_ids, turnless ones too.

    The first h turns come from the conversation whose id ends in 00, h = crc32(id) % 6; own turns follow after the first h.
    """
    rows, convs = turns_in_order(df)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).alias("h")
    heads = (rows.where((F.col("conv_id") % 100 == 0) & (F.col("p") < HEAD)).groupBy("conv_id")
             .agg(F.array_sort(F.collect_list(F.struct("p", "dig", "chars"))).alias("head")).withColumnRenamed("conv_id", "__b"))
    plan = convs.select("conv_id", "n", h).join(heads, F.col("conv_id") - F.col("conv_id") % 100 == F.col("__b"), "left")
    plan = stored(plan.select("conv_id", "n", "h", F.when(F.col("__b").isNotNull(), F.slice("head", F.lit(1), F.col("h").cast("int")))
                              .otherwise(F.array().cast("array<struct<p:long,dig:string,chars:long>>")).alias("head")), "plan")
    taken = plan.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.p", "t.dig", "t.chars")
    sizes = plan.select("conv_id", "n", "h", F.size("head").cast("long").alias("k"))
    own = join_counted(rows, sizes, "conv_id", "n", rows.count()).where("p >= h").select(
        "conv_id", (F.col("k") + F.col("p") - F.col("h")).alias("p"), "dig", "chars")
    return taken.unionByName(own), convs.select("conv_id")


def prefixes(parts: DataFrame, most: int) -> DataFrame:
    """For parts (conv_id, j, d, chars, items) of conversations: digests of all before and up to each, and code points before."""
    lists = parts.groupBy("conv_id", F.floor(F.col("j") / FAN).alias("g")).agg(
        F.array_sort(F.collect_list(F.struct("j", "d", "chars", "items"))).alias("s"))
    if most > FAN:
        lists = stored(lists, "part-lists")
        up = prefixes(lists.select("conv_id", F.col("g").alias("j"), extended(F.lit(ROOT), F.col("s")["d"]).alias("d"),
                                   total(F.col("s")["chars"]).alias("chars"), F.slice(F.col("s")["items"][0], 1, 0).alias("items")), -(-most // FAN))
        up = up.select(F.col("conv_id").alias("__c"), F.col("j").alias("__g"), F.col("before").alias("b"), F.col("after").alias("a"),
                       F.col("chars_before").alias("c"))
        lists = lists.join(up, (F.col("conv_id") == F.col("__c")) & (F.col("g") == F.col("__g")))
    else:
        lists = lists.withColumns({"b": F.lit(ROOT), "a": F.lit(None).cast("string"), "c": F.lit(0).cast("long")})
    upto = lambda k: extended(F.col("b"), F.slice(F.col("s")["d"], F.lit(1), k))
    each = lists.select("*", F.posexplode("s").alias("i", "x"))
    return each.select("conv_id", "x.j", "x.d", "x.chars", "x.items", upto(F.col("i")).alias("before"),
                       F.when(F.col("i") == FAN - 1, F.coalesce("a", upto(F.col("i") + 1))).otherwise(upto(F.col("i") + 1)).alias("after"),
                       (F.col("c") + total(F.slice(F.col("s")["chars"], F.lit(1), F.col("i")))).alias("chars_before"))


def blocks_of(turns: DataFrame) -> DataFrame:
    """Stored blocks (conv_id, j, d, chars, items, before, after, chars_before) of conversations' turns."""
    blocks = turns.groupBy("conv_id", F.floor(F.col("p") / BLOCK).alias("j")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p", "dig", "chars"))), lambda t: F.struct(t["dig"].alias("dig"), t["chars"].alias("chars"))).alias("items"))
    blocks = stored(blocks.select("conv_id", "j", extended(F.lit(ROOT), F.col("items")["dig"]).alias("d"),
                                  total(F.col("items")["chars"]).alias("chars"), "items"), "blocks")
    most = blocks.agg(F.max("j")).first()[0]
    return stored(prefixes(blocks, (most or 0) + 1), "block-prefixes")


def node_key(i: Column) -> Column:
    """Key of the node after the first i turns of a block."""
    return F.when(i == BLOCK, F.col("after")).otherwise(extended(F.col("before"), F.slice(F.col("items")["dig"], F.lit(1), i)))


def turn_nodes(groups: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Trie nodes with a last turn, from block groups whose ``diverges`` says if they have siblings.

    ``measures`` gives each column that is carried and how it adds up over siblings.
    """
    each = groups.select("*", F.posexplode("items").alias("i", "x"))
    each = each.select(node_key(F.col("i") + 1).alias("key"), node_key(F.col("i")).alias("parent"), (F.col("j") * BLOCK + F.col("i") + 1).alias("depth"),
                       F.col("x")["chars"].alias("chars"), (F.col("chars_before") + total(F.slice(F.col("items")["chars"], F.lit(1), F.col("i")))).alias("above"),
                       "diverges", *measures)
    same = ["key", "parent", "depth", "chars", "above"]
    split = each.where("diverges").groupBy(*same).agg(*[e.alias(c) for c, e in measures.items()])
    return each.where("not diverges").select(*same, *measures).unionByName(split)


def block_groups(blocks: DataFrame, measures: list[Column]) -> DataFrame:
    """Blocks of all conversations grouped by everything up to the block's end."""
    return blocks.groupBy("j", "before", "d").agg(F.first("after").alias("after"), F.first("items").alias("items"), F.first("chars_before").alias("chars_before"), *measures)


def marked(groups: DataFrame, name: str) -> DataFrame:
    """Block groups with ``diverges``: whether another group begins alike and goes on otherwise."""
    groups = stored(groups, name)
    siblings = stored(groups.groupBy("before").agg(F.count(F.lit(1)).alias("siblings")), f"{name}-siblings")
    return join_counted(groups, siblings, "before", "siblings", groups.count()).withColumn("diverges", F.col("siblings") > 1)


def joined_ids(ends: DataFrame) -> DataFrame:
    """key, ends_sha256: SHA-256 of the ids at each key, ascending and joined by commas.

    Ids are joined in stretches of bounded length; a key with several stretches is hashed as its stretches stream by.
    """
    rows = numbered(ends, [F.col("key"), F.col("conv_id")], "ends")
    runs = stored(rows.groupBy("key", F.floor(F.col("at") / IDS).alias("k")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")), "id-runs")
    counts = runs.groupBy("key").agg(F.count(F.lit(1)).alias("runs"), F.first("ids").alias("ids"))
    counts = stored(counts.select("key", "runs", F.when(F.col("runs") == 1, F.sha2("ids", 256)).alias("ends_sha256")), "id-runs-counted")
    several = counts.where("runs > 1").select(F.col("key").alias("__k"))
    rest = runs.join(several, F.col("key") == F.col("__k"), "left_semi").repartition("key").sortWithinPartitions("key", "k").select("key", "ids")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            done = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if sha:
                        done.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], names=["key", "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([sha.hexdigest()])], names=["key", "ends_sha256"])

    return counts.where("runs = 1").select("key", "ends_sha256").unionByName(rest.mapInArrow(stream, "key string, ends_sha256 string"))


def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, p, dig, chars) over the conversations ``ids``.

    Columns: key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    blocks = blocks_of(turns)
    last = F.max_by(F.struct(node_key(F.size("items")).alias("key"), (F.col("chars_before") + F.col("chars")).alias("chars")), "j")
    ends = blocks.groupBy("conv_id").agg(last.alias("e"), F.count(F.lit(1)).alias("n_blocks")).withColumnRenamed("conv_id", "__c")
    convs = stored(ids.join(ends, F.col("conv_id") == F.col("__c"), "left").select(
        "conv_id", F.coalesce("e.key", F.lit(ROOT)).alias("key"), F.coalesce("e.chars", F.lit(0)).cast("long").alias("chars"),
        F.coalesce("n_blocks", F.lit(0)).alias("n_blocks")), "conversation-ends")

    # who owns what
    groups = marked(block_groups(blocks, [F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("owner")]), "block-groups")
    root = convs.agg(F.lit(ROOT).alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"),
                     F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("above"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("owner"))
    nodes = stored(turn_nodes(groups, {"n": F.sum("n"), "owner": F.min("owner")}).unionByName(root.where("n > 0")), "nodes")
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("__k")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(kids, F.col("key") == F.col("__k"), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).drop("__k"), "nodes-counted")
    parents = stored(nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("owner").alias("parent_owner"), "n_children"), "parents")
    linked = join_counted(nodes.drop("n_children"), parents.withColumnRenamed("n_children", "siblings"), "parent", "siblings", nodes.count())
    linked = stored(linked.join(nodes.select(F.col("key").alias("__k"), "n_children"), F.col("key") == F.col("__k")).drop("__k", "siblings"), "nodes-linked")

    # code points that a conversation shares with smaller ones, and whether it owns the leaf it ends in
    shared = linked.where("parent is null or owner <> parent_owner").select(F.col("owner").alias("c"), F.col("above").alias("shared"), F.lit(0).alias("leaf"))
    leaves = linked.where("n_children = 0").select(F.col("owner").alias("c"), F.lit(None).cast("long").alias("shared"), F.lit(1).alias("leaf"))
    own = shared.unionByName(leaves).groupBy("c").agg(F.max("shared").alias("shared"), F.max("leaf").alias("leaf"))
    told = stored(convs.join(own, F.col("conv_id") == F.col("c"), "left").select(
        "conv_id", "n_blocks", F.coalesce("shared", "chars").alias("shared"), F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf")), "conversations-told")

    sums = [F.sum("shared").alias("shared"), F.sum("leaf").alias("n_leaves"), F.min(F.struct("conv_id", F.col("shared").alias("own"))).alias("first")]
    members = join_counted(blocks, told, "conv_id", "n_blocks", blocks.count())
    below = marked(block_groups(members, sums), "block-sums")
    below = turn_nodes(below, {"shared": F.sum("shared"), "n_leaves": F.sum("n_leaves"), "first": F.min("first")}).select("key", "shared", "n_leaves", "first")
    below = below.unionByName(told.agg(F.lit(ROOT).alias("key"), *sums)).withColumnRenamed("key", "__b")
    digests = joined_ids(convs.select("key", "conv_id")).withColumnRenamed("key", "__e")
    out = linked.join(below, F.col("key") == F.col("__b")).join(digests, F.col("key") == F.col("__e"), "left")
    saved = F.col("shared") - F.col("first")["own"] - (F.col("n") - 1) * F.col("above")
    return out.select("key", F.col("owner").alias("conv_id"), "depth", F.col("parent_owner").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                      "n_children", "n_leaves", saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(read(spark, sf_dir, "conversations"))).drop("key")


_TURN = "strlen(role)::varchar || ':' || role || text"
QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLES = {"op12_prefix_trie": f"""
with t as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations where conv_id is not null),
c as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, substr(sha256({_TURN}), 1, 32)) - 1 p,
  sha256({_TURN}) dig, length(text) chars from t),
ids as (select conv_id, count(*) n, {CRC32.format('conv_id')} % 6 h, conv_id - conv_id % 100 base from c group by conv_id),
plan as (select i.*, least(h, coalesce(b.n, 0)) k from ids i left join (select conv_id, n from ids) b on b.conv_id = i.base),
r as (select i.conv_id, p, dig, chars from plan i join c on c.conv_id = i.base and p < h
  union all select i.conv_id, k + p - h, dig, chars from plan i join c on c.conv_id = i.conv_id and p >= h),
seq as (select i.conv_id, coalesce(list(dig order by p) filter (dig is not null), []) s, coalesce(list(chars order by p) filter (dig is not null), []) l
  from ids i left join r on r.conv_id = i.conv_id group by i.conv_id),
m as (select conv_id, d, sha256(d::varchar || array_to_string(s[1:d], ',')) id, case when d = 0 then '' else sha256((d - 1)::varchar || array_to_string(s[1:d - 1], ',')) end up,
  case when d = 0 then 0 else l[d] end chars, d = len(s) ends from (select *, unnest(range(0, len(s) + 1)) d from seq)),
n as (select id, d, up, min(conv_id) conv_id, count(*) n_convs, max(chars) chars,
  sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) ends_sha256 from m group by id, d, up),
k as (select n.*, (select count(*) from n b where b.up = n.id) n_children from n),
sub as (select m.id, sum(case when n_children = 0 then 1 else 0 end)::bigint n_leaves, sum((n_convs - 1) * k.chars)::bigint saved_tokens
  from k join m on m.conv_id = k.conv_id and m.d <= k.d group by m.id)
select k.conv_id, k.d depth, p.conv_id parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens, k.ends_sha256
from k join sub using (id) left join k p on p.id = k.up"""}
