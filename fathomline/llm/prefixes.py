"""Prefix trie of conversations, rolled up by pointer jumping.

A node is a distinct sequence of first turns. Its key is a digest: the XOR, over the turns, of hashes of (position, role, text), so running digests are a
window aggregate that can be taken in pieces, and a node's parent is its own digest less its last turn. The roll-up works on these digest-keyed parent edges: in round
k each node adds what it has gathered (its descendants nearer than 2^k levels) to its ancestor 2^k levels up, then doubles its pointer. After
log2(depth) rounds every ancestor holds the sums of its whole subtree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.llm.common import discard, staged

#: Turns of one conversation that are digested together; the digests of longer ones are put together from pieces.
PIECE = 1024
#: Conversations that end at one node are listed by ranges of so many ids.
RANGE = 4096
WORD = "([^\\x20\\x09-\\x0D]+)"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), key (a digest of role and text) and words of each turn, in order; a table in the shared folder.

    Turns are ordered by ``turn``, nulls first; those of equal ``turn`` by role, then by the digest. Null roles and texts are empty ones. Rows without a conv_id take no part,
    repeated rows are turns of their own, other columns are ignored. Rows are dealt by ranges, so a conversation that holds much of the table is numbered in pieces.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("key"),
        F.size(F.regexp_extract_all(text, F.lit(WORD), 1)).cast("long").alias("words"),
    )
    rows = staged(rows, "trie-rows")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("key")]
    dealt = staged(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "trie-dealt")
    inside = dealt.withColumn("n", F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order)))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = dealt.groupBy("part", "conv_id").count().select("part", "conv_id", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    out = staged(inside.join(pieces, ["part", "conv_id"]).select("conv_id", (F.col("before") + F.col("n") - 1).cast("long").alias("place"), "key", "words"), "trie-turned")
    discard(rows)
    discard(dealt)
    return out


def hashed(place: Column, key: Column) -> list[Column]:
    """Two 64-bit hashes of a turn at a place."""
    return [F.xxhash64(F.lit(seed), place, key) for seed in (1, 2)]


def trie(turned: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of all conversations: depth, x and y (its key), conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` holds every conv_id once, ``turned`` their turns as conv_id, place (0, 1, ... without gaps), key and words. A conversation without turns is a member of the root
    only. Without conversations there are no nodes. The result is a table in the shared folder.
    """
    rows = _digested(turned)
    nodes = rows.groupBy("depth", "x", "y").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("px").alias("px"), F.min("py").alias("py"), F.min("words").alias("words"))
    counted = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = counted.select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "conv_id", "n_convs", F.lit(None).cast("long").alias("px"), F.lit(None).cast("long").alias("py"), F.lit(0).cast("long").alias("words"))
    nodes = staged(nodes.unionByName(root), "trie-nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"))
    known = nodes.join(children, ["depth", "x", "y"], "left").fillna(0, ["n_children"])
    own = known.select("*", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    own = staged(own, "trie-own")

    gathered, temporary = _rolled_up(own)
    sums = gathered.groupBy("depth", "x", "y").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    first = own.filter("depth = 0").select(F.col("conv_id").alias("root"))  # one row
    parents = own.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id")).filter("depth > 1")
    out = own.join(sums, ["depth", "x", "y"], "left").join(parents, ["depth", "px", "py"], "left").join(_ends(turned, conversations, rows), ["depth", "x", "y"], "left").crossJoin(F.broadcast(first))
    out = out.select(
        "depth", "x", "y", "conv_id", F.when(F.col("depth") == 1, F.col("root")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    out = staged(out, "trie")
    for frame in (nodes, own, rows, *temporary):
        discard(frame)
    return out


def _digested(turned: DataFrame) -> DataFrame:
    """conv_id, depth, x and y (digest of the turns up to this one), px and py (digest of those before it), words; long conversations in pieces."""
    x, y = hashed(F.col("place"), F.col("key"))
    rows = turned.select("conv_id", "place", F.floor(F.col("place") / PIECE).alias("piece"), x.alias("hx"), y.alias("hy"), "words")
    inside = Window.partitionBy("conv_id", "piece").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.repartition("conv_id", "piece").select("*", F.expr("bit_xor(hx)").over(inside).alias("x"), F.expr("bit_xor(hy)").over(inside).alias("y"))
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy("conv_id", "piece").agg(F.expr("bit_xor(hx)").alias("tx"), F.expr("bit_xor(hy)").alias("ty"))
    pieces = pieces.select("conv_id", "piece", *(F.coalesce(F.expr(f"bit_xor({t})").over(earlier), F.lit(0)).alias(t) for t in ("tx", "ty")))
    rows = rows.join(pieces, ["conv_id", "piece"])
    rows = rows.select("conv_id", (F.col("place") + 1).alias("depth"), F.expr("x ^ tx").alias("x"), F.expr("y ^ ty").alias("y"), "hx", "hy", "words")
    return staged(rows.select("conv_id", "depth", "x", "y", F.expr("x ^ hx").alias("px"), F.expr("y ^ hy").alias("py"), "words"), "trie-turns")


def _rolled_up(own: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """What each round adds to which node (depth, x, y, leaves, saved), and the tables to discard at the end.

    live: the nodes 2^k levels down or deeper, with what they have gathered from descendants nearer than 2^k levels, and the key of their ancestor 2^k levels up.
    """
    deepest = own.agg(F.max("depth")).first()[0] or 0
    live = own.filter("depth > 0").select("depth", "x", "y", F.col("px").alias("ux"), F.col("py").alias("uy"), "leaves", "saved")
    sums, temporary, reach = [], [], 1
    while reach <= deepest:
        up = staged(live.groupBy((F.col("depth") - reach).alias("depth"), F.col("ux").alias("x"), F.col("uy").alias("y")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "trie-up")
        sums.append(up)
        temporary.append(up)
        if 2 * reach <= deepest:
            got = up.select("depth", "x", "y", F.col("leaves").alias("l"), F.col("saved").alias("s"))
            middle = live.select((F.col("depth") + reach).alias("depth"), F.col("x").alias("ux"), F.col("y").alias("uy"), F.col("ux").alias("vx"), F.col("uy").alias("vy"))
            deeper = live.filter(F.col("depth") >= 2 * reach).join(got, ["depth", "x", "y"], "left").join(middle, ["depth", "ux", "uy"])
            live = staged(deeper.select("depth", "x", "y", F.col("vx").alias("ux"), F.col("vy").alias("uy"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "trie-live")
            temporary.append(live)
        reach *= 2
    out = own.filter("false").select("depth", "x", "y", "leaves", "saved")
    for up in sums:
        out = out.unionByName(up)
    return out, temporary


def _ends(turned: DataFrame, conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """depth, x, y and ends_sha256 of the nodes at which conversations end.

    The ids that end at a node are first listed by ranges of ids, in parallel; the lists of a node then pass one after another through its checksum, so
    that none is held whole.
    """
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct("depth", "x", "y"), "depth").alias("at")).select("conv_id", "at.*")
    none = conversations.select("conv_id").join(last.select("conv_id"), "conv_id", "left_anti")
    none = none.select("conv_id", *(F.lit(0).cast("long").alias(c) for c in ("depth", "x", "y")))
    lists = last.unionByName(none).groupBy("depth", "x", "y", F.floor(F.col("conv_id") / RANGE).alias("of"))
    lists = lists.agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    schema = "depth long, x long, y long, ends_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "x", "y", "ids")), strict=True):
                if key != at:
                    if at is not None:
                        out.append((*at, digest.hexdigest()))
                    at, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["depth", "x", "y", "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, digest.hexdigest())], names=["depth", "x", "y", "ends_sha256"])

    return lists.repartition("depth", "x", "y").sortWithinPartitions("depth", "x", "y", "of").mapInArrow(run, schema)


def rebuilt(turned: DataFrame, family: int = 20, shared: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: the turns of each, and every conv_id.

    Conversation c takes the first h turns of conversation c - c % family (all if there are fewer, none if that one is absent), then its own after its first h;
    h is a checksum of c modulo ``shared``.
    """
    def h() -> Column:
        return F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(shared))

    every = turned.filter("place = 0").select("conv_id", h().alias("h"), (F.col("conv_id") - F.pmod("conv_id", F.lit(family))).alias("base"))
    heads = turned.filter((F.pmod("conv_id", F.lit(family)) == 0) & (F.col("place") < shared - 1))
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.collect_list(F.struct("place", "key", "words")).alias("turns"))  # at most shared - 1
    taken = every.join(heads, "base", "left").select("conv_id", F.filter(F.coalesce("turns", F.array()), lambda t: t["place"] < F.col("h")).alias("turns"))
    prefix = taken.select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.*")
    missing = taken.select("conv_id", (h() - F.size("turns")).alias("short")).filter("short > 0")  # where the base has fewer turns
    own = turned.filter(F.col("place") >= h()).join(missing, "conv_id", "left").select("conv_id", (F.col("place") - F.coalesce("short", F.lit(0))).cast("long").alias("place"), "key", "words")
    return prefix.unionByName(own), every.select("conv_id")
