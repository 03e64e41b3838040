"""Texts with an earlier one at a Jaccard similarity of word shingles, found by shared shingles and verified exactly.

Of a text that is similar to another by t or more, no more than (1 - t) of the shingles are missing in that one. So a text of which
more are in no other text is put aside, and nothing is lost by that. Shared ones are counted over the shingles in a fixed part of the
hash range, the same for all texts; those frequent in a sample are known to be shared and never move. Of the texts that are left, two
of similarity t share one of the first |set| - ceil(t |set|) + 1 shingles of each, in any order that is the same for all. Pairs that
meet in one go if their sizes or the parity bitmaps of their sets tell that too much differs: sets differ in no fewer elements than
their bitmaps do in bits. A text is then compared with that of the closest bitmap, and with all others only if that one is not
similar, so a large group of near copies does not leave its task in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import Scratch, map_batches, prepare, sent as sent_to_all, without
from proofline.llm.line_dedup import Hashes, _keyed, mixed, words_of

#: Bits of a shingle's hash in the order, of a bitmap, and pairs compared at a time.
HASH, BITS, PAIRS = 50, 1024, 1 << 16
#: Documents in the sample, and shingles of it that come last in the order.
SAMPLE, FREQUENT = 20_000, 100_000
#: In texts of more than WHOLE shingles, the shared ones are counted over this share of the hashes.
SHARE, WHOLE = 0.3, 64
#: What a shingle's row says instead of a number: it counts, or it is there for others only.
COUNTED, SENT = -1, -2


def shingle_sets(texts: list[list[bytes]], width: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets of the texts' shingles in their order: (owner, shingle) and each set's size. frequent: sorted; last in the order."""
    h = Hashes(texts)
    wide = np.minimum(h.n, width)
    count = np.where(h.n > 0, h.n - wide + 1, 0)
    owner = np.repeat(np.arange(len(texts)), count)
    start = h.start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    key = mixed(h.run(start, start + wide[owner]), wide[owner], 5).view(np.uint64) >> np.uint64(64 - HASH)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)
        key |= (frequent[at] == key).astype(np.uint64) << np.uint64(HASH)
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    once = np.ones(len(key), bool)
    once[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return owner[once], key[once].view(np.int64), np.bincount(owner[once], minlength=len(texts))


def similar(a: list[bytes], b: list[bytes], width: int, percent: int) -> bool:
    """Exactly: whether the shingle sets share `percent` percent of their union."""
    sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in (a, b)]
    return 100 * len(sets[0] & sets[1]) >= percent * len(sets[0] | sets[1])


def _words(column: pa.Array) -> list[list[bytes]]:
    return [words_of(t.as_py() or "") for t in column]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, th): (th, n) that add up to a text's counted shingles that are shared, less those it needs.

    A row with a need of 0 or more stands for its text and has a key of its own. Needs no more than the last row.
    """
    held: list[np.ndarray] | None = None
    before = False  # whether the held row's key is that of the row before it

    def out(th: np.ndarray, need: np.ndarray, shared: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = np.where(need >= 0, -need.astype(np.int64), shared & (need == COUNTED))
        some = (n != 0) | (need >= 0)
        th, at = np.unique(th[some], return_inverse=True)
        if len(th):
            yield pa.RecordBatch.from_arrays([pa.array(th), pa.array(np.bincount(at, n[some]).astype(np.int64))], names=["th", "n"])

    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "th", "need")]
        rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        once = np.ones(len(rows[0]), bool)
        once[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
        key, th, need = (x[once] for x in rows)
        same = key[1:] == key[:-1]
        shared = np.concatenate(([before], same)) | np.concatenate((same, [False]))
        yield from out(th[:-1], need[:-1], shared[:-1])
        held, before = [key[-1:], th[-1:], need[-1:]], bool(same[-1]) if len(same) else before
    if held is not None:
        yield from out(held[1], held[2], np.array([before]))


def _pairs(percent: int, closest: bool):  # noqa: ANN202
    """Of rows sorted by (key, doc, th): pairs of th (th, earlier, apart) that sizes and bitmaps do not rule out, for rows not done.

    apart: by how many bits the bitmaps differ, for a thousand of the sizes' sum. closest: only the earlier row with the smallest.
    """

    def of(key: np.ndarray, ids: np.ndarray, size: np.ndarray, bits: np.ndarray, done: np.ndarray) -> Iterator[pa.RecordBatch]:
        row = np.arange(len(key))
        first = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), row, 0))
        before = np.where(done, 0, row - first)
        total = np.cumsum(before)
        at = 0
        while at < len(key):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
            some = before[at:end]
            x = np.repeat(row[at:end], some)
            y = first[x] + np.arange(len(x)) - np.repeat(np.cumsum(some) - some, some)
            both = size[x] + size[y]
            ok = (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y])) & (ids[x] != ids[y])
            x, y, both = x[ok], y[ok], both[ok]
            # sets of similarity t differ in at most (1 - t) / (1 + t) of their sizes' sum
            differ = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            ok = differ * (100 + percent) <= (100 - percent) * both
            x, y, apart = x[ok], y[ok], 1000 * differ[ok] // both[ok]
            if closest and len(x):
                order = np.lexsort((y, apart, x))
                x, y, apart = x[order], y[order], apart[order]
                x, one = np.unique(x, return_index=True)
                y, apart = y[one], apart[one]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y]), pa.array(apart)], names=["th", "earlier", "apart"])
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            new = [*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "th", "size")), bits, batch.column("done").to_numpy(zero_copy_only=False)]
            cut = int(np.searchsorted(new[0], new[0][-1])) if last is None or new[0][-1] != last else 0
            if cut or (held and new[0][0] != last):  # whole groups only: the last may go on
                yield from of(*(np.concatenate(x) for x in zip(*held, [x[:cut] for x in new], strict=True)))
                held, new = [], [x[cut:] for x in new]
            held.append(new)
            last = new[0][-1]
        if held:
            yield from of(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def keep_unlike(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with all its columns, without rows that have an earlier one of a similarity of `percent` percent or more.

    Rows are in the order of doc_id (null last) and a hash of the text; whether the earlier one stays itself does not matter.
    Similarity is that of the sets of `width` consecutive words (all of them in shorter texts), words as in line_dedup. Of equal texts the first
    stays. Texts without a word are like no other text. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "similar")
    keyed = docs.select(*_keyed(docs))
    none = np.array([], np.uint64)

    def counted(batch: pa.RecordBatch) -> dict:
        return {"key": shingle_sets(_words(batch.column("text")), width, none)[1]}

    share = max(1, docs.count() // SAMPLE)
    sample = keyed.where(F.pmod(F.xxhash64("th"), F.lit(share)) == 0).dropDuplicates(["th"]).select("text")
    often = map_batches(sample, counted, "key long").groupBy("key").count().where("count > 3").orderBy(F.desc("count"), "key").limit(FREQUENT).collect()
    frequent = np.sort(np.array([r["key"] for r in often], np.uint64))
    part = int(SHARE * (1 << HASH))

    def sent(batch: pa.RecordBatch) -> dict:
        owner, key, size = shingle_sets(_words(batch.column("text")), width, frequent)
        th = batch.column("th").to_numpy()
        known, of = key >= 1 << HASH, size[owner]
        inside = (key & ((1 << HASH) - 1)) < part
        count = inside | (of <= WHOLE)
        # of those counted, as many as may be missing in a similar text need not be shared
        need = np.bincount(owner[count], minlength=len(size)) - (100 - percent) * size // 100 - np.bincount(owner[count & known], minlength=len(size))
        go = ~known & (inside | (of * percent <= WHOLE * 100))  # all of a text that could be similar to one that counts all
        some = np.flatnonzero(size > 0)
        return {
            "key": np.concatenate((key[go], th[some] | np.int64(-(1 << 63)))), "th": np.concatenate((th[owner[go]], th[some])),
            "need": np.concatenate((np.where(count[go], COUNTED, SENT), np.maximum(need[some], 0))).astype(np.int32),
        }

    rows = map_batches(keyed.select("th", "text"), sent, "key long, th long, need int")
    counts = rows.repartition("key").sortWithinPartitions("key", "th").mapInArrow(_counts, "th long, n long")
    maybe = counts.groupBy("th").agg(F.sum("n").alias("n")).where("n >= 0").select("th")
    firsts = scratch.keep(keyed.groupBy("th").agg(F.min("doc").alias("doc"), F.count("*").alias("n")), "firsts")
    some = sent_to_all(scratch.keep(firsts.select("th", "doc").join(maybe, "th", "left_semi"), "some", small=True))

    def sketch(batch: pa.RecordBatch) -> dict:
        owner, key, size = shingle_sets(_words(batch.column("text")), width, frequent)
        bits = np.zeros((len(size), BITS), np.uint8)
        np.bitwise_xor.at(bits, (owner, key % BITS), 1)
        rank = np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
        early = rank <= (100 - percent) * size[owner] // 100
        keys = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.bincount(owner[early], minlength=len(size)).cumsum())), pa.int32()), pa.array(key[early]))
        return {c: batch.column(c) for c in ("doc", "th", "text")} | {"size": size, "bits": [x.tobytes() for x in np.packbits(bits, axis=1)], "keys": keys}

    texts = keyed.join(some, ["doc", "th"]).dropDuplicates(["doc", "th"]).select("doc", "th", "text")
    sketches = scratch.keep(map_batches(texts, sketch, "doc long, th long, text string, size long, bits binary, keys array<long>"), "sketches")
    dealt = sketches.select("doc", "th", "size", "bits", F.explode("keys").alias("key"))
    dealt = dealt.join(sketches.select(F.explode("keys").alias("key")).groupBy("key").count().where("count > 1").select("key"), "key")

    def verify(batch: pa.RecordBatch) -> dict:
        good = [i for i, (a, b) in enumerate(zip(_words(batch.column("text")), _words(batch.column("other")), strict=True)) if similar(a, b, width, percent)]
        return {"th": batch.column("th").take(pa.array(good, pa.int64()))}

    def found(done: DataFrame | None) -> DataFrame:
        rows = dealt.withColumn("done", F.lit(False)) if done is None else dealt.join(done.withColumn("done", F.lit(True)), "th", "left").fillna(False, ["done"])
        sorted_rows = rows.select("key", "doc", "th", "size", "bits", "done").repartition("key").sortWithinPartitions("key", "doc", "th")
        pairs = sorted_rows.mapInArrow(_pairs(percent, done is None), "th long, earlier long, apart long")
        pairs = pairs.groupBy("th").agg(F.min_by("earlier", F.struct("apart", "earlier")).alias("earlier")) if done is None else pairs.select("th", "earlier").distinct()
        with_texts = pairs.join(sketches.select("th", "text"), "th").join(sketches.select(F.col("th").alias("earlier"), F.col("text").alias("other")), "earlier")
        return map_batches(with_texts.select("th", "text", "other"), verify, "th long").distinct()

    one = scratch.keep(found(None), "one", small=True)
    near = scratch.keep(one.union(found(one)), "near", small=True)
    scratch.drop(sketches, one)
    # what goes: similar texts, and the copies of equal ones but for the first; what is flagged and stays: rows that are there again
    doc, th, _ = _keyed(docs)
    copies = keyed.join(firsts.where("n > 1").select("th", F.col("doc").alias("first")), "th").groupBy("doc", "th").agg(F.min("first").alias("first"))
    flagged = copies.select(F.col("doc").alias("a"), F.col("th").alias("b"), (F.col("doc") != F.col("first")).alias("gone"))
    flagged = flagged.unionByName(firsts.join(near, "th", "left_semi").select(F.col("doc").alias("a"), F.col("th").alias("b"), F.lit(True).alias("gone")))
    return without(docs, [doc, th], scratch.keep(flagged.groupBy("a", "b").agg(F.max("gone").alias("gone")), "flagged", small=True))
