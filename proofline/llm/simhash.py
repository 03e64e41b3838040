"""SimHash near-dedup: fingerprints of word shingles, linked by a self-join of binary tries.

Each distinct fingerprint goes to error+1 tries, one for each of as many blocks of its bits: of two fingerprints that differ
in at most `error` bits, one block at least is equal, so both meet in its trie. A trie of very many fingerprints is dealt out in the
same way, by error+1 blocks of its other bits. In a trie, pairs of nodes are followed together
from the root down; the differing bits add up, and a pair beyond the error budget ends there. A trie gives not pairs but a star
for each of its components, so a large group of near copies costs as many rows as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import Scratch, connected, map_batches, order_key, prepare, text_hash, without

#: Pairs of nodes followed at a time, and the number of member pairs from which two nodes are compared outright.
FRONTIER, SMALL = 1 << 19, 48


def fingerprint(text: str | None, width: int) -> int:
    """The SimHash of the word shingles of a text; 0 without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    line, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(width, len(words))
    starts = np.concatenate(([0], ends[: len(words) - width] + 1))
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 1 << 15):
        spans = zip(starts[at : at + (1 << 15)].tolist(), ends[at + width - 1 : at + width - 1 + (1 << 15)].tolist(), strict=False)
        hashes = np.array([digest(line[a:b], 42) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp long) for every row; null and empty texts have fingerprint zero."""

    def columns(batch: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(x.as_py(), width) for x in batch.column("text")], dtype=np.uint64)
        return {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "fp": pa.array(fps.view(np.int64))}

    text = F.col("text").cast("string")
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(text).alias("text_hash"), text.alias("text")), columns, "doc_id long, text_hash long, fp long")


def trie_stars(fps: np.ndarray, groups: np.ndarray, error: int) -> np.ndarray:
    """For rows in the order of (group, fingerprint): the first row of each one's component within its group.

    groups: the first row of each group and, last, the number of rows.
    """
    n, label = len(fps), np.arange(len(fps))
    ones = np.zeros((65, n + 1), np.int32)
    for bit in range(64):
        np.cumsum((fps >> np.uint64(63 - bit)) & np.uint64(1), out=ones[bit, 1:])

    def unite(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = label[a], label[b]
            differ = a != b
            a, b = a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label[:] = label[label]

    def compare(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> None:
        wide, sizes = hi2 - lo2, (hi - lo) * (hi2 - lo2)
        pair = np.repeat(np.arange(len(lo)), sizes)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        a, b = lo[pair] + k // wide[pair], lo2[pair] + k % wide[pair]
        a, b = a[a < b], b[a < b]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= error
        unite(a[near], b[near])

    lo, hi = groups[:-1], groups[1:]
    todo = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while todo:
        bit, lo, hi, lo2, hi2, spent = todo.pop()
        if len(lo) > FRONTIER:
            todo += [(bit, *(x[i : i + FRONTIER] for x in (lo, hi, lo2, hi2, spent))) for i in range(0, len(lo), FRONTIER)]
            continue
        size = (hi - lo) * (hi2 - lo2)
        few = (size <= SMALL) | (bit == 64)
        if few.any():
            for i in range(0, int(few.sum()), 1 << 15):
                compare(*(x[few][i : i + (1 << 15)] for x in (lo, hi, lo2, hi2)))
            lo, hi, lo2, hi2, spent = (x[~few] for x in (lo, hi, lo2, hi2, spent))
        if not len(lo):
            continue
        mid, mid2 = hi - (ones[bit, hi] - ones[bit, lo]), hi2 - (ones[bit, hi2] - ones[bit, lo2])
        same = lo == lo2
        children = [(lo, mid, lo2, mid2, spent), (mid, hi, mid2, hi2, spent), (lo, mid, mid2, hi2, spent + 1)]
        children.append(tuple(x[~same] for x in (mid, hi, lo2, mid2, spent + 1)))
        lo, hi, lo2, hi2, spent = (np.concatenate(x) for x in zip(*children, strict=True))
        alive = (hi > lo) & (hi2 > lo2) & (spent <= error)
        todo.append((bit + 1, *(x[alive] for x in (lo, hi, lo2, hi2, spent))))
    return label


def _masks(width: int, error: int) -> list[list[int]]:
    """For each block of `width` bits: error+1 masks that share out all other bits, as signed numbers."""
    out = []
    for at in range(0, 64, width):
        rest = [b for b in range(64) if not at <= b < at + width]
        values = [sum(1 << b for b in part.tolist()) for part in np.array_split(rest, error + 1)]
        out.append([v - (1 << 64) if v >= 1 << 63 else v for v in values])
    return out


def stars(fps: DataFrame, error: int, chunk: int = 200_000, most: int = 1 << 20) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all fingerprints within `error` bits, one star for each trie's component.

    Tries of more than `most` fingerprints are dealt out once more; there are at most (error+1) * 2**width of them.
    """
    width = -(-64 // (error + 1))
    keys = F.array(*[F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << min(width, 64 - at)) - 1)) * (error + 1) + i for i, at in enumerate(range(0, 64, width))])
    keyed = fps.select("fp", F.posexplode(keys).alias("block", "key"))
    large = [r["key"] for r in keyed.groupBy("key").count().where(F.col("count") > most).select("key").collect()]
    if large:
        part = lambda j: F.col("fp").bitwiseAND(F.element_at(F.array(*[F.lit(m[j]) for m in _masks(width, error)]), F.col("block") + 1))
        again = F.array(*[F.xxhash64("key", F.lit(j), part(j)) for j in range(error + 1)])  # tries that share a hash are one trie, which does no harm
        keyed = keyed.select("fp", F.explode(F.when(F.col("key").isin(large), again).otherwise(F.array("key"))).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((fps, keys))
            keys, fps = keys[order], fps[order]
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            label = trie_stars(fps, np.append(starts, len(keys)), error)
            linked = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(fps[linked].view(np.int64)), pa.array(fps[label[linked]].view(np.int64))], names=["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in filter(len, batches):
            held.append((batch.column("key").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)))
            rows += batch.num_rows
            if rows >= chunk and held[0][0][0] != held[-1][0][-1]:  # whole tries only: the last may go on
                keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(keys, keys[-1]))
                yield joined(keys[:cut], fps[:cut])
                held, rows = [(keys[cut:], fps[cut:])], len(keys) - cut
        if rows:
            yield joined(*(np.concatenate(x) for x in zip(*held, strict=True)))

    dealt = keyed.select("fp", "key").repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(run, "a long, b long")


def _classes(docs: DataFrame, width: int, error: int) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, text_hash, fp); and (fp, first, component_first) of the distinct fingerprints: the first row of each and of its component."""
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "simhash")
    rows = scratch.keep(fingerprints(docs, width), "fingerprints")
    first = F.min(F.struct(order_key(F.col("doc_id")).alias("id"), F.col("text_hash").alias("text")))
    distinct = scratch.keep(rows.groupBy("fp").agg(first.alias("first")), "distinct")
    roots = connected(spark, stars(distinct.select("fp"), error), scratch)
    linked = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("component"))
    least = linked.groupBy("component").agg(F.min("first").alias("component_first"))
    return rows, linked.join(least, "component").select("fp", "first", "component_first")


def near_duplicates(docs: DataFrame, width: int = 4, error: int = 4) -> DataFrame:
    """(doc_id, fp long, component_id) for every row of docs (doc_id, text); component_id is the smallest doc_id reachable by links.

    Two rows link if their fingerprints differ in at most `error` of 64 bits. Null and empty texts have fingerprint zero and
    link like any other. Repeated rows are equal, so they link. A null doc_id is never the smallest unless all of a component's
    are null; component_id is null then. An empty table gives no rows. Other columns are not read.
    """
    rows, classes = _classes(docs, width, error)
    smallest = F.col("component_first.id")
    return rows.join(classes, "fp").select("doc_id", "fp", F.when(smallest < 2**63 - 1, smallest).alias("component_id"))


def keep_first(docs: DataFrame, width: int = 4, error: int = 4) -> DataFrame:
    """docs with all its columns but one row only of each component: that with the smallest doc_id (null last).

    Ties of a doc_id go to the smaller hash of the text; of rows equal in both, one stays.
    """
    rows, classes = _classes(docs, width, error)
    key = [order_key(F.col("doc_id")), text_hash(F.col("text").cast("string"))]
    stay = classes.where("first = component_first").select(F.col("first.id").alias("a"), F.col("first.text").alias("b"), F.lit(False).alias("gone"))
    own = rows.select(order_key(F.col("doc_id")).alias("a"), F.col("text_hash").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    flagged = own.join(stay, ["a", "b"], "left").select("a", "b", F.coalesce("gone", F.lit(True)).alias("gone"), "n").where("gone or n > 1").drop("n")
    return without(docs, key, Scratch(docs.sparkSession, "simhash").keep(flagged, "flagged", small=True))
