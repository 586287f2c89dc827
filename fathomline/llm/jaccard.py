"""N-gram Jaccard join, size-aware: fixed-size subsets for small sets, inverted lists for large ones.

Equal sets are one class. The shingles of a class are ordered from rare to frequent, by document frequencies counted over all classes. A set of
n shingles may miss at most d = n - ceil(t n) of a partner's, so partners share one of its first d + 1 shingles, and two of its first d + 2.
Small sets meet by all 2-subsets of the latter; a large set scans the inverted lists of the former, in which the sets small enough to be
its partners also stand. The size that parts them is the one with the least cost over all sizes, counted from the corpus in rows that are shuffled.

Sets that share a key meet in a bin, that of the key's first set, and each set is sent to a bin once. A bin is joined where it is: inverted lists of its
sets give all overlaps, and a union-find keeps only links that join two components, one fewer than the bin's sets at most. A bin of more
shingles than a task should hold is dealt as pairs of blocks of its sets. So no pair is ever a row, and no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import HASHES, MIX_1, blocks, discard, fresh, mixed, only, raw, staged, windows
from fathomline.llm.components import components
from fathomline.llm.dealing import dealt, parts_of

#: Shingles of the sets in one bin, at most; of the bins joined at once; bytes of the sets in one task.
BIN, AT_ONCE, TASK_BYTES = 1 << 20, 1 << 18, 32 << 20
#: Entries of inverted lists, which a bin scans in memory, that cost as much as one shuffled row.
SCANNED = 64


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the windows of ``words`` words, A-Z lower-cased; of the whole sequence if it is shorter."""
    only(HASHES)
    h = HASHES.of((text or b"").lower().split())
    if 0 < len(h) < words:
        value = np.array([len(h)], dtype=np.uint64)
        for i in range(len(h)):
            value = value * MIX_1 + h[i : i + 1]
        return mixed(value)
    return np.unique(windows(h, words))


def node_of(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


def misses(n: int, percent: int) -> int:
    return n - -(-percent * n // 100)


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, row_key, n_shingles and node (128-bit fingerprint of the set, null for an empty set) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            sets = [shingles(x, words) for x in raw(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("row_key"), pa.array([len(h) for h in sets], pa.int64()), pa.array([node_of(h) if len(h) else None for h in sets], pa.binary())], names=["doc_id", "row_key", "n_shingles", "node"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("row_key"))
    return rows.mapInArrow(run, "doc_id long, row_key long, n_shingles long, node binary")


class ClassBlock:
    """The sets of the classes that are represented in one block."""

    def __init__(self, pdf: pd.DataFrame, classes: pd.DataFrame, words: int) -> None:
        wanted = set(zip(classes["doc_id"].astype(int), map(bytes, classes["node"]), strict=True))
        found: dict[bytes, np.ndarray] = {}
        for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            if not pd.isna(doc_id) and text is not None:
                h = shingles(text.encode("utf-8", "surrogatepass"), words)
                if len(h) and (int(doc_id), node := node_of(h)) in wanted:
                    found[node] = h
        self.sets = sorted(found.items())
        every = np.concatenate([h for _, h in self.sets]) if self.sets else np.zeros(0, np.uint64)
        self.unique, self.counts = np.unique(every, return_counts=True)


def prefixes(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """node, n, ones, keys, subsets, scan, hashes of the classes that share a shingle among their first d + 2.

    ``keys`` are those shared shingles, of which ``ones`` are among the first d + 1. ``subsets`` counts the 2-subsets of the keys, ``scan`` the
    classes in the inverted lists of the first ``ones``; ``hashes`` is the whole set.
    """
    rows, n_blocks = dealt(docs)
    n_parts = n_blocks
    mine = classes.select(F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int").alias("of"), "doc_id", "node")

    def asked(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        block = ClassBlock(pdf, own, words)
        out = []
        for k, p in enumerate(parts_of(block.unique, n_parts)):
            if len(p):
                many = np.flatnonzero(block.counts[p] > 1)
                out.append((k, int(own["of"].iloc[0]), block.unique[p].astype(np.uint32).tobytes(), many.astype(np.uint32).tobytes(), block.counts[p][many].astype(np.uint32).tobytes()))
        return pd.DataFrame(out, columns=["part", "block", "hashes", "many", "counts"])

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        """Document frequencies in steps of an eighth of a power of two, one byte a hash; 0 is a single document."""
        each = [np.frombuffer(x, np.uint32) for x in pdf["hashes"]]
        h = np.concatenate(each)
        n = np.ones(len(h), dtype=np.int64)
        start = 0
        for own, many, counts in zip(each, pdf["many"], pdf["counts"], strict=True):
            n[start + np.frombuffer(many, np.uint32).astype(np.int64)] = np.frombuffer(counts, np.uint32)
            start += len(own)
        _, back = np.unique(h, return_inverse=True)
        code = np.minimum(255, np.ceil(8 * np.log2(np.bincount(back, n)))).astype(np.uint8)[back]
        cuts = np.cumsum([len(x) for x in each])[:-1]
        return pd.DataFrame({"of": pdf["block"], "part": pdf["part"], "codes": [x.tobytes() for x in np.split(code, cuts)]})

    def listed(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        block = ClassBlock(pdf, answers[answers["doc_id"].notna()], words)
        code = np.zeros(len(block.unique), dtype=np.uint8)
        parts = parts_of(block.unique, n_parts)
        for part, codes in zip(answers["part"], answers["codes"], strict=True):
            if codes is not None:
                code[parts[int(part)]] = np.frombuffer(codes, np.uint8)
        out = []
        for node, h in block.sets:
            n, d = len(h), misses(len(h), percent)
            frequency = code[np.searchsorted(block.unique, h)]
            order = np.lexsort((h, frequency))[: d + 2]
            shared = [int(j) for j in range(len(order)) if frequency[order[j]]]
            if not shared:
                continue
            ones = sum(j <= d for j in shared)
            lists = float((2.0 ** (frequency[order[shared[:ones]]] / 8)).sum())
            out.append((node, n, ones, h[order[shared]].tobytes(), len(shared) * (len(shared) - 1) // 2, lists, h.tobytes()))
        return pd.DataFrame(out, columns=["node", "n", "ones", "keys", "subsets", "scan", "hashes"])

    answers = rows.groupBy("block").cogroup(mine.groupBy("of")).applyInPandas(asked, "part int, block int, hashes binary, many binary, counts binary")
    answers = answers.groupBy("part").applyInPandas(counted, "of int, part int, codes binary")
    both = mine.unionByName(answers, allowMissingColumns=True)
    return rows.groupBy("block").cogroup(both.groupBy("of")).applyInPandas(listed, "node binary, n int, ones int, keys binary, subsets long, scan double, hashes binary")


def boundary(found: DataFrame) -> int:
    """Size up to which sets are small: where listing 2-subsets below, and listing keys and scanning their lists above, cost least together, in rows.

    A large set's rows are its keys; the lists are scanned inside bins, so what stands in them is no row. 2-subsets grow with the square of the keys and each is a row.
    Sizes above 4,096 are taken together in steps of a 64th of a power of two, so the rows read here are few whatever the corpus.
    """
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.col("n"))) - 6, F.lit(0)))
    size = F.when(F.col("n") <= 4096, F.col("n").cast("double")).otherwise(F.floor(F.col("n") / step) * step)
    cost = found.groupBy(size.alias("size")).agg(F.sum(F.col("ones") + F.col("scan") / SCANNED).alias("scan"), F.sum("subsets").alias("subsets"), F.max("n").alias("n")).collect()
    best, at, total = 0.0, 0, 0.0
    for r in sorted(cost, key=lambda r: r["n"]):
        total += r["subsets"] - r["scan"]
        if total < best:
            best, at = total, r["n"]
    return at


def keys_of(found: DataFrame, small: int, percent: int) -> DataFrame:
    """kind, key, node, n, large: the keys by which classes meet, 0 for one shingle and 1 for two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "keys", 1 << 20):
            kinds, keys, rows = [], [], []
            for i, (n, ones, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "ones", "keys")), strict=True)):
                h = np.frombuffer(own, np.uint64)
                if 100 * n >= percent * (small + 1):  # large, or small enough to be a large one's partner
                    keys.append(h[:ones])
                    kinds.append(np.zeros(ones, np.int32))
                    rows.append(np.full(ones, i))
                if n <= small:
                    pairs = np.array(list(combinations(range(len(h)), 2)), dtype=np.int64).reshape(-1, 2)
                    keys.append(mixed(h[pairs[:, 0]] * MIX_1 + h[pairs[:, 1]]))
                    kinds.append(np.ones(len(pairs), np.int32))
                    rows.append(np.full(len(pairs), i))
            if keys:
                at = pa.array(np.concatenate(rows))
                n = batch.column("n").take(at)
                large = pa.array(n.to_numpy(zero_copy_only=False) > small)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds)), pa.array(np.concatenate(keys).view(np.int64)), batch.column("node").take(at), n, large], names=["kind", "key", "node", "n", "large"])

    return found.select("node", "n", "ones", "keys").mapInArrow(run, "kind int, key long, node binary, n int, large boolean")


def binned(listed: DataFrame, most: int = BIN) -> tuple[DataFrame, int]:
    """bin and node: every two classes that share a key share a bin; and the shingles of all bins together."""
    lead = listed.groupBy("kind", "key").agg(F.min("node").alias("lead"), F.max("node").alias("last"), F.max("large").alias("any_large"))
    # a list in which only small sets stand, or one set, joins nothing
    lead = lead.filter((F.col("lead") != F.col("last")) & (F.col("any_large") | (F.col("kind") == 1))).drop("last", "any_large")
    met = listed.join(lead, ["kind", "key"]).groupBy("lead", "node").agg(F.first("n").alias("n"))
    met = staged(met, "jaccard-met")
    weights = met.groupBy("lead").agg(F.sum("n").alias("weight"))
    total, widest = weights.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.max("weight"), F.lit(0))).first()
    plain = F.xxhash64("lead").alias("bin")
    if widest <= most:
        return met.select(plain, "node"), total
    cut = F.ceil(F.col("weight") / F.lit(most / 2)).cast("int")
    wide = weights.filter(F.col("weight") > most).select("lead", cut.alias("cut"))
    rest = met.join(wide, "lead", "left_anti").select(plain, "node")
    own: Column = F.pmod(F.xxhash64("node"), F.col("cut")).cast("int")
    pairs = met.join(wide, "lead").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    pairs = pairs.select(F.xxhash64("lead", F.least("own", "other"), F.greatest("own", "other")).alias("bin"), "node")
    return rest.unionByName(pairs), total * 2


def joined(nodes: list[bytes], sets: list[np.ndarray], percent: int) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the links among the sets."""
    m = len(sets)
    sizes = np.array([len(h) for h in sets], dtype=np.int64)
    own = np.repeat(np.arange(m), sizes)
    _, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    many = count[number] > 1
    own, number = own[many], number[many]
    start = np.searchsorted(own, np.arange(m + 1))
    lists = own[np.argsort(number, kind="stable")]
    at = np.zeros(len(count) + 1, dtype=np.int64)
    np.cumsum(np.bincount(number, minlength=len(count)), out=at[1:])
    root = list(range(m))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(m):
        terms = number[start[i] : start[i + 1]]
        if not len(terms):
            continue
        low, n = at[terms], at[terms + 1] - at[terms]
        ends = np.cumsum(n)
        both = np.bincount(lists[np.repeat(low - (ends - n), n) + np.arange(ends[-1])], minlength=m)
        for j in np.flatnonzero(100 * both >= percent * (sizes[i] + sizes - both)).tolist():
            if j > i and (a := top(i)) != (b := top(j)):
                root[b] = a
                out.append((nodes[i], nodes[j]))
    return out


def links_of(bins: DataFrame, total: int, found: DataFrame, percent: int) -> DataFrame:
    """a and b: links that join all classes which any links join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}
        size, last = 0, None

        def passed() -> pa.RecordBatch:
            links = joined(list(held), list(held.values()), percent)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for key, node, h in zip(batch.column("bin").to_pylist(), batch.column("node").to_pylist(), batch.column("hashes"), strict=True):
                if key != last and size >= AT_ONCE:  # whole bins only; those joined together may share sets
                    yield passed()
                    held, size = {}, 0
                last = key
                if node not in held:
                    held[node] = np.frombuffer(h.as_py(), np.uint64)
                    size += len(held[node])
        if held:
            yield passed()

    parts = max(1, math.ceil(total * 8 / TASK_BYTES))
    rows = bins.join(found.select("node", "hashes"), "node").select("bin", "node", "hashes")
    return rows.repartition(parts, "bin").sortWithinPartitions("bin").mapInArrow(run, "a binary, b binary")


def linked(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, row_key, n_shingles, node, component_id: one row per document row. Two documents link at a Jaccard similarity of ``percent`` or more.

    component_id is the smallest doc_id that links reach. Null and empty texts have no set and link with nothing. Rows with a null doc_id take no
    part: their component_id is null. Rows that share an id are documents of their own. Sets are compared by 64-bit hashes of their shingles,
    and equal sets by 128 bits. Other columns are ignored.
    """
    rows = staged(sets_of(docs, words), "jaccard-sets")
    classes = staged(rows.dropna(subset=["doc_id", "node"]).groupBy("node").agg(F.min("doc_id").alias("doc_id")), "jaccard-classes")
    found = staged(prefixes(docs, classes, words, percent), "jaccard-prefixes")
    bins, total = binned(keys_of(found, boundary(found), percent))
    links = staged(links_of(bins, total, found, percent), "jaccard-links")
    discard(found)
    labels = components(links)
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = named.join(lowest, "label").select("node", "component_id")
    out = rows.join(named, "node", "left")
    alone = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.select("doc_id", "row_key", "n_shingles", "node", alone.alias("component_id"))


def representatives(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` less all but the first (by doc_id) of each group that links join; rows without words or id all stay.

    Of rows that repeat both id and text one stays. Columns may have any names; an empty table stays empty.
    """
    found = staged(linked(docs, words, percent), "jaccard-found")
    grouped = found.dropna(subset=["doc_id", "node"])
    first = grouped.groupBy("component_id").agg(F.min(F.struct("doc_id", "row_key")).alias("first"), F.count("*").alias("n")).select("first.*")
    repeats = not grouped.groupBy("doc_id", "row_key").count().filter("count > 1").isEmpty()
    alone = found.filter("doc_id IS NULL OR node IS NULL").select("doc_id", "row_key").distinct()
    of, key = fresh(docs, "kept_id", "kept_key")
    keep = first.unionByName(alone).distinct().select(F.col("doc_id").alias(of), F.col("row_key").alias(key))
    rows = docs.join(keep, docs["doc_id"].eqNullSafe(keep[of]) & (F.xxhash64(docs["text"]) == keep[key]), "left_semi")
    return rows.dropDuplicates(["doc_id", "text"]) if repeats else rows
