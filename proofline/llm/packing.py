"""Packing: documents become pieces of token sequences by first-fit decreasing.

A document's full sequences are cut off as they are; its rest competes for room. Documents are dealt to randomised groups, each
packed alone: rests go from the longest to the shortest to the first sequence with room, which a tournament tree of the
sequences' free room finds in logarithmic time. The number of groups follows the number of documents, so a group's size doesn't.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import Scratch, map_batches, prepare

#: Units whose ids a Python worker keeps, and slots of the table that finds them.
CACHE_UNITS, SLOT_BITS = 1_000_000, 21
#: Pieces in a group, about.
GROUP_PIECES = 20_000
#: Bytes of text, and new units, that are handled together.
TEXT_BYTES, STEMS = 1 << 19, 256
#: Units of more bytes are hashed one by one.
LONG = 255

#: Latin letters that normalisation leaves alone, but for their case.
LETTERS = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]+")
#: First bytes of the combining marks that A to Z are composed with, which comes before letters are made small.
COMBINING = (b"\xcc", b"\xcd")
#: Classes of bytes: white space, letters, digits, marks, and others, next to which no unit begins or ends.
SPACE, LETTER, DIGIT, MARK, OTHER = range(5)
CLASS = np.full(256, OTHER, np.uint8)
for _bytes, _class in ((b" \t\n\r\x0b\x0c", SPACE), (bytes(range(97, 123)), LETTER), (bytes(range(48, 58)), DIGIT), (b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", MARK)):
    CLASS[list(_bytes)] = _class
_CUT = np.array([[a != b or a == DIGIT for b in range(5)] for a in range(5)])
_CUT[OTHER, 1:] = _CUT[1:, OTHER] = False
#: By the classes of two bytes in a row: whether a unit ends between them, and whether one begins.
ENDS, STARTS = _CUT.copy(), _CUT.copy()
ENDS[SPACE, :] = STARTS[:, SPACE] = False
#: Bases of the hash modulo 2**64, and a number for each byte.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
VALUE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


class Ids:
    """Token ids, by the tokenizers library, with the ids of units of text kept in arrays.

    The tokenizer's normalisation and splitting never reach across white space, nor across the places between letters, digits and
    marks (apostrophes but for): there a token group always ends. So a text's ids are those of its units between such places.
    Lower-casing A-Z first changes nothing but in texts with combining marks, which go through the whole tokenizer, as do texts
    that hold an added token's own text. Units are found by a 64-bit hash in an open table, all of a batch at once; new ones are
    encoded many in one call: those of Latin letters without the steps that change nothing in them, told apart by the ids that
    end a word, all others by the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.letters.normalizer, self.letters.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        # the signs that stand for the bytes of letters beyond ASCII; bytes under 128 stand for themselves
        signs = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = {code: signs.pre_tokenize_str(chr(code))[0][0] for code in range(0xC0, 0x180)}
        self.special = sorted(t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        vocabulary = self.tokenizer.get_vocab()
        self.word_ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.powers = self.inverses = np.ones(1, np.uint64)
        self.clear()

    def clear(self) -> None:
        self.keys, self.numbers = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int32)
        self.first, self.count, self.store = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32)
        self.n_units = self.n_ids = 0

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def units(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the units of data, which begins and ends with white space."""
        import xxhash

        buffer = np.frombuffer(data, np.uint8)
        kind = CLASS[buffer]
        lead = np.flatnonzero((buffer >= 0xC3) & (buffer <= 0xC5))
        code = buffer[lead].astype(np.int32) * 256 + buffer[lead + 1]
        lead = lead[(code != 0xC397) & (code != 0xC3B7) & (code != 0xC4B0) & (code != 0xC5BF)]  # two signs, and letters that change
        kind[lead] = kind[lead + 1] = LETTER
        pair = kind[:-1] * np.uint8(5) + kind[1:]
        start, end = np.flatnonzero(STARTS.ravel()[pair]) + 1, np.flatnonzero(ENDS.ravel()[pair]) + 1
        if len(self.powers) < len(buffer):
            self.powers, self.inverses = (np.concatenate(([np.uint64(1)], np.full(max(len(buffer), TEXT_BYTES) + 64, x))).cumprod(dtype=np.uint64) for x in (BASE, INVERSE))
        sums = np.empty(len(buffer) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(VALUE[buffer] * self.powers[: len(buffer)], out=sums[1:])
        h = (sums[end] - sums[start]) * self.inverses[start] + (end - start).astype(np.uint64) * BASE
        for i in np.flatnonzero(end - start > LONG):
            h[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]])
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return start, end, np.maximum(h ^ (h >> np.uint64(29)), np.uint64(1))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The numbers of the units with these hashes; -1 for new ones."""
        out, todo, slot = np.full(len(h), -1, np.int32), np.arange(len(h)), (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        while len(todo):
            there = self.keys[slot]
            hit = there == h
            out[todo[hit]] = self.numbers[slot[hit]]
            on = ~hit & (there != 0)
            todo, h, slot = todo[on], h[on], (slot[on] + 1) & ((1 << SLOT_BITS) - 1)
        return out

    def add(self, h: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """New units: their different hashes, how many ids each has, and all the ids."""
        n, more = self.n_units + len(h), self.n_ids + len(ids)
        if n > len(self.first):  # arrays grow by a half
            self.first, self.count = (np.concatenate((x, np.zeros(max(n, len(x) // 2), x.dtype))) for x in (self.first, self.count))
        if more > len(self.store):
            self.store = np.concatenate((self.store, np.zeros(max(more, len(self.store) // 2), np.uint32)))
        self.first[self.n_units : n], self.count[self.n_units : n] = self.n_ids + np.cumsum(counts) - counts, counts
        self.store[self.n_ids : more] = ids
        number, slot = np.arange(self.n_units, n), (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        self.n_units, self.n_ids = n, more
        while len(h):
            free = np.flatnonzero(self.keys[slot] == 0)
            put = free[np.unique(slot[free], return_index=True)[1]]  # one for each free slot
            self.keys[slot[put]], self.numbers[slot[put]] = h[put], number[put]
            on = np.ones(len(h), bool)
            on[put] = False
            h, number, slot = h[on], number[on], (slot[on] + 1) & ((1 << SLOT_BITS) - 1)

    def learn(self, units: list[bytes], h: np.ndarray) -> None:
        texts = b"\n".join(units).decode("utf-8", "replace").split("\n")
        plain, other = [], []
        for i, text in enumerate(texts):
            (plain if LETTERS.fullmatch(text) else other).append(i)
        for at in range(0, len(plain), STEMS):
            few = plain[at : at + STEMS]
            words = [texts[i] if len(texts[i]) == len(units[i]) else texts[i].lower().translate(self.signs) for i in few]
            ids = np.array(self.letters.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.word_ends[ids])
            if len(last) == len(few):
                self.add(h[few], np.diff(last, prepend=-1), ids)
            else:
                other.extend(few)
        if other:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in other], add_special_tokens=False)]
            self.add(h[other], np.fromiter(map(len, ids), np.int64, len(ids)), np.array([i for x in ids for i in x], np.uint32))

    def joined(self, parts: list[bytes]) -> list[np.ndarray]:
        """The ids of each part, all of them in lower case."""
        data = b"\n" + b"\n".join(parts) + b"\n"
        start, end, h = self.units(data)
        number = self.find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            keys, one = np.unique(h[new], return_index=True)
            one = new[one]
            self.learn([data[a:b] for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)], keys)
            number[new] = self.find(h[new])
        counts = self.count[number].astype(np.int64)
        after = np.concatenate(([0], np.cumsum(counts)))
        ids = self.store[np.repeat(self.first[number] - after[:-1], counts) + np.arange(after[-1])]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        cuts = after[np.searchsorted(start, np.concatenate(([0], np.cumsum(sizes))) + 1)].tolist()
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text. A text of more than TEXT_BYTES is taken in parts that end at a space."""
        if self.n_units > CACHE_UNITS - (CACHE_UNITS >> 2):
            self.clear()
        out: list[list[np.ndarray]] = [[] for _ in texts]
        parts: list[bytes] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            for owner, ids in zip(owners, self.joined(parts), strict=True):
                out[owner].append(ids)
            parts.clear()
            owners.clear()
            size = 0

        for i, text in enumerate(texts):
            data = text.encode("utf-8", "replace") if text else b""
            small = data.lower()
            if any(c in data for c in COMBINING) or (b"<|" in data and any(s in small for s in self.special)):
                out[i].append(self.plain(data.decode()))
                continue
            at = 0
            while at < len(small):
                end = len(small)
                if end - at > TEXT_BYTES:
                    end = small.rfind(b" ", at, at + TEXT_BYTES) + 1 or small.find(b" ", at + TEXT_BYTES) + 1 or end
                parts.append(small[at:end])
                owners.append(i)
                size += end - at
                at = end
                if size >= TEXT_BYTES:
                    flush()
        if parts:
            flush()
        return [x[0] if len(x) == 1 else np.concatenate([np.zeros(0, np.uint32), *x]) for x in out]


_IDS: dict[str, Ids] = {}


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 4096) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): every document's ids, with end_id after them, cut into full sequences and a rest."""
    prepare(docs.sparkSession)

    def columns(batch: pa.RecordBatch) -> dict:
        if tokenizer not in _IDS:
            _IDS[tokenizer] = Ids(tokenizer)
        out: dict[str, list] = {"doc_id": [], "start": [], "length": [], "ids_crc32": [], "doc_tokens": []}
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), _IDS[tokenizer].of(batch.column("text").to_pylist()), strict=True):
            ids = np.append(ids, end_id).astype("<u4")
            n = len(ids)
            for at in range(0, n, size):
                cut = ids[at : at + size]
                for name, value in (("doc_id", doc_id), ("start", at), ("length", len(cut)), ("ids_crc32", zlib.crc32(cut)), ("doc_tokens", n)):
                    out[name].append(value)
        return out

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), columns, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def first_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For lengths from the longest to the shortest: the bin of each, and its offset there.

    The tree's leaves hold the bins' free room in the order of the bins, its inner nodes the largest below them.
    """
    n = len(lengths)
    leaves = 1 << max(0, n - 1).bit_length()
    room = [size] * (2 * leaves)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i, length in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < length:
                node += 1
        bins[i], offsets[i] = node - leaves, size - room[node]
        room[node] -= length
        node //= 2
        while node:
            most = room[2 * node] if room[2 * node] >= room[2 * node + 1] else room[2 * node + 1]
            if room[node] == most:
                break
            room[node] = most
            node //= 2
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 4096, group_pieces: int = GROUP_PIECES, seed: int = 7) -> DataFrame:
    """pieces() with sequence_id and offset: sequences of at most `size` tokens, without gaps from offset 0.

    Null and empty texts are one piece of end_id. Repeated rows are packed each. A null doc_id stays null; its pieces are packed
    like any other's. An empty table gives no rows. Other columns are not read. Groups are drawn by a row's contents and its place
    in the written table of pieces, so two runs may pack alike documents into other sequences.
    """
    spark = docs.sparkSession
    cut = Scratch(spark, "packing").keep(pieces(docs, tokenizer, end_id, size), "pieces")
    groups = max(1, -(-cut.count() // group_pieces))
    # a row's place in the written table, so that copies of a row are dealt out too
    group = F.pmod(F.xxhash64("doc_id", "ids_crc32", "start", F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups))
    arrow = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def packed(rows: pa.Table) -> pa.RecordBatch:
        lengths = rows.column("length").to_numpy()
        bins, offsets = first_fit(lengths, size)
        ids = rows.column("group").to_numpy() * (1 << 32) + bins
        return pa.RecordBatch.from_arrays([*(rows.column(n).combine_chunks() for n in arrow.names[:5]), pa.array(ids), pa.array(offsets)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            of = batch.column("group").to_numpy()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[0].column("group")[0].as_py() != of[a]:
                    yield packed(pa.Table.from_batches(held))
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield packed(pa.Table.from_batches(held))

    dealt = cut.withColumn("group", group).repartition("group").sortWithinPartitions("group", F.desc("length"), "doc_id", "start", "ids_crc32")
    return dealt.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
