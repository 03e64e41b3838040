"""Benchmark decontamination by Wu-Manber search over words.

Patterns are windows of benchmark words. Patterns of one length are searched together: a shift table over blocks of two words
skips positions where no window can end, buckets keyed by a window's last words pick the patterns to test, and a direct
comparison confirms each occurrence. Patterns come in blocks of bounded size; each block is one more pass of the same map, so no
broadcast grows with the benchmark.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import Scratch, add_columns, fresh, prepare

#: Every byte that is not in a word becomes a space: all of ASCII but digits and letters.
WORD_BYTES = bytes(b if chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(256))
#: Bytes of benchmark text in one block of patterns.
BLOCK_BYTES = 4 << 20
#: Blocks whose patterns a task holds together.
CHAIN = 8


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().translate(WORD_BYTES).split() if text else []


class WuManber:
    """Patterns of one length m: tuples of words, each with the items that hold it."""

    def __init__(self, m: int, patterns: dict[tuple, set]):
        self.m, self.block = m, min(2, m)
        self.skip = m - self.block + 1
        self.shift: dict[tuple, int] = {}
        # of each last block, the patterns that end in it; a pattern's hash picks it, and comparing its words confirms it
        self.buckets: dict[tuple, dict[tuple, list]] = defaultdict(dict)
        for pattern, items in patterns.items():
            for end in range(self.block, m + 1):
                block, distance = pattern[end - self.block : end], m - end
                if distance < self.shift.get(block, self.skip):
                    self.shift[block] = distance
            self.buckets[pattern[m - self.block :]][pattern] = list(items)

    def search(self, words: list[bytes], hits: bytearray, items: set) -> None:
        """Marks the words inside occurrences and adds the items found."""
        m, block, skip, shift, n = self.m, self.block, self.skip, self.shift, len(words)
        end = m
        while end <= n:
            key = tuple(words[end - block : end])
            step = shift.get(key, skip)
            if step:
                end += step
                continue
            owners = self.buckets[key].get(tuple(words[end - m : end]))
            if owners:
                hits[end - m : end] = b"\x01" * m
                items.update(owners)
            end += 1


def patterns_of(items: list[tuple], window: int) -> list[WuManber]:
    """One searcher for each length of (item_id, text) pairs' windows."""
    by_length: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
    for item_id, text in items:
        words = words_of(text)
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            by_length[m][tuple(words[i : i + m])].add(None if item_id is None else str(item_id))
    return [WuManber(m, patterns) for m, patterns in sorted(by_length.items())]


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with all its columns and, last, n_words, n_hit and items (names that docs has get underscores after them).

    Each block of patterns is a map over the rows, which do not move between tasks. After every CHAIN maps the rows are written,
    so that the patterns a task holds are bounded whatever the benchmark's size.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "decontam")
    found = benchmark.where("text is not null").select("item_id", F.col("text").cast("string").alias("text")).distinct()
    total = found.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    columns = docs.columns
    names = fresh(docs, "n_words", "n_hit", "items", "hits", "n_words_new", "n_hit_new", "items_new", "hits_new")
    now, new = names[:4], names[4:]
    out = docs.select("*", F.lit(None).cast("array<string>").alias(now[2]), F.lit(None).cast("binary").alias(now[3]))
    for b in range(blocks):
        block = found if blocks == 1 else found.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        patterns = sorted(((r[0], r[1]) for r in block.collect()), key=lambda x: (x[0] is None, str(x[0]), x[1]))  # one block, of bounded size
        out = add_columns(out, _searcher(patterns, window, b == blocks - 1, now[2:], new), f"{new[0]} long, {new[1]} long, {new[2]} array<string>, {new[3]} binary")
        out = out.select(*columns, *(F.col(c).alias(n) for n, c in zip(now, new, strict=True)))
        if b % CHAIN == CHAIN - 1 and b < blocks - 1:
            out = scratch.keep(out, "block")
    return out.drop(now[3])


def _searcher(patterns: list[tuple], window: int, last: bool, known: list[str], new: list[str]) -> Callable[[pa.RecordBatch], dict]:
    made: list[list[WuManber]] = []

    def columns(batch: pa.RecordBatch) -> dict:
        if not made:
            made.append(patterns_of(patterns, window))
        rows = []
        for text, items, before in zip(batch.column("text"), *(batch.column(c) for c in known), strict=True):
            words = words_of(text.as_py())
            hits, found = bytearray(before.as_py() or bytes(len(words))), set(items.as_py() or ())
            for searcher in made[0]:
                searcher.search(words, hits, found)
            rows.append((len(words), sum(hits), sorted(found - {None}) + [None] * (None in found), bytes(hits) if found and not last else None))
        return dict(zip(new, map(list, zip(*rows, strict=True)), strict=True))

    return columns


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, items array<string>, contaminated) for every row of docs (doc_id, text).

    A window is `window` consecutive words of an item; an item with fewer words, but not none, is one window. n_hit counts words
    inside any occurrence; items are the item_ids (as strings, sorted) with occurring windows; contaminated: some words are hit,
    and they are at least `percent` percent of the words. Null and empty texts have no words and are clean. Null, empty and
    wordless items have no windows; rows of an item_id that repeats count as one item, as do those of a null id, which is last in
    items. Repeated documents each get their row; an empty table gives none. Other columns are not read.
    """
    found = annotate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, window, block_bytes)
    return found.select("doc_id", "n_words", "n_hit", "items", _contaminated("n_words", "n_hit", percent).alias("contaminated"))


def _contaminated(n_words: str, n_hit: str, percent: int) -> Column:
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 100 >= F.col(n_words) * percent)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    found = annotate(docs, benchmark, window)
    n_words, n_hit = found.columns[-3:-1]
    return found.where(~_contaminated(n_words, n_hit, percent)).select(*docs.columns)
