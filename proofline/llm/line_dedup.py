"""Line dedup by a deletion-neighbourhood join over words.

Two lines are near if one insertion, deletion or substitution of a word makes them equal. Each line gives itself and every variant
with one word left out, as hashed keys. A line that equals another's variant is one insertion away; two lines with an equal
variant that lacks the word at the same place are one substitution apart; so each key needs only its earliest line, never its
pairs. Links are verified by edit distance over the words.

Most lines are near no other. Of two near lines, the first or the last half is equal, so lines that share neither half with
another line are put aside before variants are made; nothing is lost by that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import Scratch, fresh, map_batches, order_key, prepare, text_hash

#: Odd bases of the polynomial hashes modulo 2**64, and their inverses.
BASES = tuple(np.uint64(b) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in BASES)


#: Lines, of 50 bytes each, that are sent to all tasks at most.
HOT_LINES = 10_000
#: Characters of scripts written without spaces: Thai, Lao, Burmese, Khmer, kana, Chinese. Each is a word.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def words_of(line: str) -> list[bytes]:
    """The words between ASCII white space, A-Z in lower case; a character of UNSPACED is a word."""
    if not line.isascii():
        line = UNSPACED.sub(r" \g<0> ", line)
    return line.encode("utf-8", "surrogatepass").lower().split()


def near(a: list[bytes], b: list[bytes]) -> bool:
    """Edit distance over words of at most 1."""
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    p = 0
    while p < len(a) and a[p] == b[p]:
        p += 1
    return a[p + (len(a) == len(b)) :] == b[p + 1 :]


class Hashes:
    """Polynomial hashes of all word runs of a batch of lines."""

    def __init__(self, lines: list[list[bytes]]):
        import xxhash

        self.n = np.fromiter(map(len, lines), np.int64, len(lines))
        self.start = np.cumsum(self.n) - self.n
        digest = xxhash.xxh64_intdigest
        words = np.fromiter((digest(w) for line in lines for w in line), np.uint64, int(self.n.sum()))
        self.sums, self.scale = [], []
        for base, inverse in zip(BASES, INVERSES, strict=True):
            powers = np.concatenate(([np.uint64(1)], np.full(len(words), base))).cumprod(dtype=np.uint64)
            self.scale.append(np.concatenate(([np.uint64(1)], np.full(len(words), inverse))).cumprod(dtype=np.uint64))
            self.sums.append(np.concatenate(([np.uint64(0)], (words * powers[:-1]).cumsum(dtype=np.uint64))))

    def run(self, a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
        """The hash of the words [a, b), alike wherever they stand."""
        return (self.sums[which][b] - self.sums[which][a]) * self.scale[which][a]

    def without(self, a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The hash of the words [a, b) but for that at p."""
        s = self.sums[0]
        return (s[p] - s[a] + (s[b] - s[p + 1]) * INVERSES[0]) * self.scale[0][a]


def mixed(h: np.ndarray, length: np.ndarray, tag: int) -> np.ndarray:
    x = h ^ (length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(tag))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _lines(docs: DataFrame, min_words: int, exact_words: int) -> DataFrame:
    """(doc, th, line, h1, h2, halves): every line of exact_words words or more; halves are empty under min_words."""

    def columns(batch: pa.RecordBatch) -> dict:
        owner, number, lines = [], [], []
        for i, text in enumerate(batch.column("text")):
            for k, line in enumerate((text.as_py() or "").split("\n")):
                words = words_of(line)
                if len(words) >= exact_words:
                    owner.append(i)
                    number.append(k)
                    lines.append(words)
        h = Hashes(lines)
        a, b, n = h.start, h.start + h.n, h.n
        half, less = n // 2, (n - 1) // 2
        keys = np.stack([mixed(h.run(a, a + half), half, 1), mixed(h.run(b - half, b), half, 2), mixed(h.run(a, a + less), less, 1), mixed(h.run(b - less, b), less, 2)], axis=1)
        count = np.where(n < min_words, 0, np.where(half == less, 2, 4))
        flat = keys[np.arange(4)[None, :] < count[:, None]]
        halves = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], count.cumsum())), pa.int32()), pa.array(flat))
        rows = np.array(owner, np.int64)
        doc, th = (batch.column(c).to_numpy(zero_copy_only=False)[rows] for c in ("doc", "th"))
        return {"doc": pa.array(doc, pa.int64()), "th": pa.array(th, pa.int64()), "line": number, "h1": pa.array(mixed(h.run(a, b), n, 3)), "h2": pa.array(mixed(h.run(a, b, 1), n, 3)), "halves": halves}

    return map_batches(docs, columns, "doc long, th long, line int, h1 long, h2 long, halves array<long>")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (half, h1): the lines h1 whose half another line has too. Needs no more than the last row."""
    last: tuple | None = None  # half, line, given out
    for batch in batches:
        half, line = batch.column("half").to_numpy(), batch.column("h1").to_numpy()
        if not len(half):
            continue
        if last is not None:
            half, line = np.concatenate(([last[0]], half)), np.concatenate(([last[1]], line))
        same = half[1:] == half[:-1]
        other = same & (line[1:] != line[:-1])
        first_of = np.concatenate(([True], ~same)).nonzero()[0]
        mixed_run = np.logical_or.reduceat(np.concatenate((other, [False])), first_of) if len(first_of) else np.array([], bool)
        # a run is mixed if a change of line lies inside it; the change at its end belongs to the next row of the same run
        run = np.cumsum(np.concatenate(([True], ~same))) - 1
        out = line[mixed_run[run]]
        last = (half[-1], line[-1])
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(out))], names=["h1"])


def _variants(lines: DataFrame) -> DataFrame:
    """(key, place, id): each line itself, with place -1, and without each of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                h = Hashes([words_of(t.as_py()) for t in part.column("text")])
                a, b, ids = h.start, h.start + h.n, part.column("id").to_numpy()
                owner = np.repeat(np.arange(len(ids)), h.n)
                p = np.arange(len(owner))
                key = np.concatenate((mixed(h.run(a, b), h.n, 4), mixed(h.without(a[owner], b[owner], p), h.n[owner] - 1, 4)))
                place = np.concatenate((np.full(len(ids), -1), p - a[owner])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(place), pa.array(np.concatenate((ids, ids[owner])))], names=["key", "place", "id"])

    return lines.mapInArrow(run, "key long, place int, id long")


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, place, id): (id, earlier) for lines with an earlier near one. Needs no more than the last row's state."""
    last = (0, 0)  # key and place
    first = whole = -1  # of the last key: the first id of its last place, and the line that has it as its own
    for batch in batches:
        key, place, ids = (batch.column(c).to_numpy() for c in ("key", "place", "id"))
        if not len(key):
            continue
        row = np.arange(len(key))
        new_key = np.concatenate(([first < 0 or key[0] != last[0]], key[1:] != key[:-1]))
        new_place = new_key | np.concatenate(([place[0] != last[1]], place[1:] != place[:-1]))
        at_place, at_key = (np.maximum.accumulate(np.where(x, row, -1)) for x in (new_place, new_key))
        first_of = np.where(at_place < 0, first, ids[at_place])
        whole_of = np.where(at_key < 0, whole, np.where(place[at_key] == -1, ids[at_key], -1))
        variant = place != -1
        same = variant & (first_of != ids)
        after = variant & (whole_of >= 0) & (whole_of < ids)
        before = variant & (whole_of > ids)
        # a line that lacks nothing has in each batch one earlier line of those that lack a word
        run = np.cumsum(new_key)
        best = np.full(run[-1] + 1, np.iinfo(np.int64).max)
        np.minimum.at(best, run[before], ids[before])
        some = np.unique(run[before], return_index=True)[1]
        later = np.concatenate((ids[same], ids[after], whole_of[before][some]))
        earlier = np.concatenate((first_of[same], whole_of[after], best[run[before][some]]))
        last, first, whole = (key[-1], place[-1]), int(first_of[-1]), int(whole_of[-1])
        if len(later):
            yield pa.RecordBatch.from_arrays([pa.array(later), pa.array(earlier)], names=["id", "earlier"])


def _keyed(docs: DataFrame) -> list[Column]:
    text = F.col("text").cast("string")
    return [order_key(F.col("doc_id")).alias("doc"), text_hash(text).alias("th"), text.alias("text")]


def dropped_lines(docs: DataFrame, min_words: int = 5, exact_words: int | None = None) -> DataFrame:
    """(doc, th, line, kind): the lines to drop, numbered from 0; kind is exact or near. doc and th are a row's key.

    Lines are in the order of doc_id (null last), a hash of the text, and their number. A line of min_words words or more is
    dropped if an earlier one is equal in its words (exact) or else has a word-level edit distance of 1 to it (near), whether or
    not that one stays. Words are what stands between ASCII white space, A-Z in lower case; a character of a script without
    spaces is a word. Of shorter lines, those of exact_words words (min_words if not given) or more go if they are exact, the rest
    stay. Repeated rows have one key and are treated alike.
    """
    exact_words = min_words if exact_words is None else max(1, min(exact_words, min_words))
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "lines")
    keyed = docs.select(*_keyed(docs))
    lines = scratch.keep(_lines(keyed, min_words, exact_words), "lines")
    order = F.struct("doc", "th", "line")
    repeated = lines.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).where("first <> last")
    repeated = scratch.keep(repeated.select("h1", "h2", "first", "n"), "repeated")
    # lines that stand in very many places, of which there can be no more than HOT_LINES, meet their copies where these are
    many = max(1000, lines.count() // HOT_LINES)
    hot = F.broadcast(repeated.where(F.col("n") > many).select("h1", "h2", F.col("first").alias("hot_first")))
    placed = lines.select("doc", "th", "line", "h1", "h2").join(hot, ["h1", "h2"], "left")
    rare = placed.where("hot_first is null").drop("hot_first").join(repeated.where(F.col("n") <= many).drop("n"), ["h1", "h2"])
    exact = placed.where("hot_first is not null").withColumnRenamed("hot_first", "first").unionByName(rare).where(order != F.col("first"))
    # copies of a line are one row before halves are dealt out
    halves = lines.select(F.explode("halves").alias("half"), "h1").distinct().repartition("half").sortWithinPartitions("half", "h1")
    maybe = scratch.keep(halves.mapInArrow(_shared, "h1 long").distinct(), "maybe", small=True)
    # one row for each different line among them, numbered in the order of their first places
    firsts = lines.select("doc", "th", "line", "h1", "h2").join(maybe, "h1", "left_semi").groupBy("h1", "h2").agg(F.min(order).alias("f"))
    firsts = firsts.select("h1", "h2", "f.doc", "f.th", "f.line")
    ranged = firsts.repartitionByRange("doc", "th", "line").sortWithinPartitions("doc", "th", "line")
    numbered = scratch.keep(ranged.withColumn("id", F.monotonically_increasing_id()), "numbered")
    wanted = numbered.groupBy("doc", "th").agg(F.collect_list(F.struct("line", "id")).alias("picks"))

    def cut(batch: pa.RecordBatch) -> dict:
        ids, texts = [], []
        for text, picks in zip(batch.column("text"), batch.column("picks"), strict=True):
            parts = text.as_py().split("\n")
            for pick in picks.as_py():
                ids.append(pick["id"])
                texts.append(parts[pick["line"]])
        return {"id": ids, "text": texts}

    one = keyed.join(wanted, ["doc", "th"]).select("text", "picks")
    texts = scratch.keep(map_batches(one, cut, "id long, text string").dropDuplicates(["id"]), "texts")
    found = _variants(texts).repartition("key").sortWithinPartitions("key", "place", "id").mapInArrow(_links, "id long, earlier long")
    found = scratch.keep(found.distinct(), "found", small=True)

    def verify(batch: pa.RecordBatch) -> dict:
        good = [i for i, (a, b) in enumerate(zip(batch.column("text"), batch.column("other"), strict=True)) if near(words_of(a.as_py()), words_of(b.as_py()))]
        return {"id": batch.column("id").take(pa.array(good, pa.int64()))}

    def verified(links: DataFrame) -> DataFrame:
        pairs = links.join(texts, "id").join(texts.select(F.col("id").alias("earlier"), F.col("text").alias("other")), "earlier")
        return map_batches(pairs.select("id", "text", "other"), verify, "id long").distinct()

    # a line's earliest candidate is near but for chance equality of hashes; all others are tried only then
    linked = found.groupBy("id").agg(F.min("earlier").alias("earlier"))
    near_ids = verified(linked)
    near_ids = near_ids.unionByName(verified(found.join(linked.select("id").join(near_ids, "id", "left_anti"), "id", "left_semi")))
    # a near line's copies go as exact ones, so only its first place is left to name
    close = scratch.keep(numbered.join(near_ids, "id", "left_semi").select("doc", "th", "line"), "near", small=True)
    scratch.drop(maybe, texts, found, numbered)
    both = exact.select("doc", "th", "line", F.lit("exact").alias("kind")).unionByName(close.withColumn("kind", F.lit("near")))
    return both.groupBy("doc", "th", "line").agg(F.min("kind").alias("kind"))


def _by_row(docs: DataFrame, min_words: int, exact_words: int | None, names: tuple[str, str, str] = ("doc", "th", "drops")) -> DataFrame:
    drops = dropped_lines(docs, min_words, exact_words)
    return drops.groupBy(F.col("doc").alias(names[0]), F.col("th").alias(names[1])).agg(F.array_sort(F.collect_list(F.struct("line", "kind"))).alias(names[2]))


def report(docs: DataFrame, min_words: int = 5, exact_words: int | None = None) -> DataFrame:
    """(doc_id, n_lines, n_exact, n_near, dropped) for every row of docs: how many lines, how many go and why, and their numbers.

    dropped lists the numbers, from 0, in order and joined by commas. Null texts have no lines, an empty text has one; other
    cases are as in dropped_lines(). An empty table gives no rows. Other columns are not read.
    """
    text = F.col("text").cast("string")
    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.split(text, "\n", -1))).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), order_key(F.col("doc_id")).alias("doc"), text_hash(text).alias("th"), n_lines.alias("n_lines"))
    drops = F.coalesce("drops", F.array().cast("array<struct<line: int, kind: string>>"))
    of = lambda kind: F.size(F.filter(drops, lambda x: x["kind"] == kind)).cast("long")
    joined = rows.join(_by_row(docs, min_words, exact_words), ["doc", "th"], "left")
    return joined.select("doc_id", "n_lines", of("exact").alias("n_exact"), of("near").alias("n_near"), F.array_join(F.transform(drops, lambda x: x["line"].cast("string")), ",").alias("dropped"))


def drop_lines(docs: DataFrame, min_words: int = 5, exact_words: int | None = None) -> DataFrame:
    """docs with all its columns, without the lines of dropped_lines() in text.

    Rows of which no line with a word is left, but had one, go: all their lines stand in earlier rows. Null and empty texts stay.
    n_chars, where docs has it, counts the new text's characters if lines were dropped.
    """
    doc, th, drops, new = fresh(docs, "doc", "th", "drops", "new")
    keys = [order_key(F.col("doc_id")).alias(doc), text_hash(F.col("text").cast("string")).alias(th)]
    joined = docs.select("*", *keys).join(_by_row(docs, min_words, exact_words, (doc, th, drops)), [doc, th], "left")

    gone = F.transform(drops, lambda x: x["line"])
    left = F.filter(F.split(F.col("text"), "\n", -1), lambda _, i: ~F.array_contains(gone, i))
    same = F.col(drops).isNull()
    out = joined.withColumn(new, F.when(same, F.col("text")).otherwise(F.array_join(left, "\n"))).where(same | F.col(new).rlike(r"\S"))
    changed = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(same, F.col("n_chars")).otherwise(F.length(new).cast(docs.schema["n_chars"].dataType))
    return out.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])
