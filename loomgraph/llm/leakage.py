"""Evaluation texts leaking into training text, found with an FM-index per shard.

A shard is as many whole documents of a partition as hold SHARD words. Its text is the sequence of all their words as
numbers, every document ended by a separator of its own. The index is the Burrows-Wheeler
transform of that sequence in a wavelet matrix with bit ranks and sampled suffix positions. It is built once, knows nothing
of test items, and is a table: any later item set is searched in it without the texts. All test phrases are searched
backwards together; the places of a hit come from the sampled positions, and overlapping hits become one removal span
per document and item. Words are numbered by 64-bit hashes of their folded letters, so no word is a Python object.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import materialize

#: Consecutive words that make a leak.
WORDS = 12
#: Words and characters that one index holds; a longer document is a shard of its own.
SHARD, SHARD_CHARS = 1_000_000, 16_000_000
#: Characters whose words are found together.
CHUNK = 500_000
#: One suffix position in so many is kept.
SAMPLE = 8
#: Words of test items that one pass over the index searches; more items are searched in several passes.
BLOCK_WORDS = 500_000

_WORD = re.compile(r"[^\W_]+")
_ONE_I = str.maketrans("İIı", "iii")
_LIMIT = 0x323B0  # no letter or digit is assigned from here on


def _small(c: str) -> str:
    low = c.translate(_ONE_I).lower()
    return low if len(low) == 1 else c


def words(text: str) -> list[str]:
    """Runs of letters and digits, case aside; I, İ, ı and i are one letter."""
    return _WORD.findall("".join(map(_small, text)))


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it belongs to a word, and a 64-bit number of its folded form."""
    every = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(_LIMIT + 1)]
    inside = np.array([c.isalnum() for c in every])
    inside[_LIMIT] = False
    z = np.array([ord(_small(c)) for c in every], np.uint64) + np.uint64(1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0x9E3779B97F4A7C15)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return inside, z


def numbered_words(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of the texts in order: the text they are in, hash, first character and length."""
    inside, mix = _letters()
    cp = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    cp = np.minimum(cp, _LIMIT)
    w = inside[cp]
    edge = np.flatnonzero(np.diff(w.astype(np.int8), prepend=0, append=0))
    first, size = edge[::2], edge[1::2] - edge[::2]
    if not len(first):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    head = np.cumsum(size) - size
    power = np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    h = np.add.reduceat(mix[cp[w]] * power[np.arange(int(size.sum())) - np.repeat(head, size)], head)
    h ^= h >> np.uint64(32)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    at = np.searchsorted(begin, first, "right") - 1
    return at, h, first - begin[at], size


class WaveletMatrix:
    """Ranks of symbols in a sequence; bit planes packed into 64-bit words with running counts."""

    def __init__(self, n: int, planes: np.ndarray) -> None:
        self.n, self.planes = n, planes
        self.counts = np.zeros((len(planes), planes.shape[1] + 1), np.int64)
        np.cumsum(np.bitwise_count(planes), axis=1, out=self.counts[:, 1:])
        self.zeros = n - self.counts[:, -1]

    @classmethod
    def of(cls, seq: np.ndarray, bits: int) -> WaveletMatrix:
        planes = np.zeros((bits, len(seq) // 64 + 1), "<u8")
        for level in range(bits):
            one = ((seq >> (bits - 1 - level)) & 1).astype(bool)
            packed = np.packbits(one, bitorder="little")
            planes[level].view(np.uint8)[: len(packed)] = packed
            seq = np.concatenate((seq[~one], seq[one]))
        return cls(len(seq), planes)

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][w] + np.bitwise_count(self.planes[level][w] & mask)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol ``c`` occurs before place ``i``, for arrays of both."""
        at, low = i.astype(np.int64), np.zeros(len(i), np.int64)
        bits = len(self.planes)
        for level in range(bits):
            bit = (c >> (bits - 1 - level)) & 1
            o1, o0 = self._ones(level, at), self._ones(level, low)
            z = self.zeros[level]
            at = np.where(bit == 1, z + o1, at - o1)
            low = np.where(bit == 1, z + o0, low - o0)
        return at - low

    def symbol(self, i: np.ndarray) -> np.ndarray:
        """The symbols at places ``i``."""
        at, c = i.astype(np.int64), np.zeros(len(i), np.int64)
        for level in range(len(self.planes)):
            bit = ((self.planes[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            o1 = self._ones(level, at)
            at = np.where(bit == 1, self.zeros[level] + o1, at - o1)
            c = (c << 1) | bit
        return c


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Places of the suffixes in order: sorted by as many symbols as fit a number, then prefix doubling of what is still equal."""
    n = len(symbols)
    bits = int(symbols.max()).bit_length() + 1
    k = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(k):
        key <<= bits
        if j < n:
            key[: n - j] += symbols[j:] + 1
    order = np.argsort(key)
    sk = key[order]
    head = np.concatenate(([True], sk[1:] != sk[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while True:
        slots = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(slots):
            return order
        u = order[slots]
        key = rank[u] * (n + 2) + np.where(u + k < n, rank[np.minimum(u + k, n - 1)] + 1, 0)
        o = np.argsort(key)
        u, key = u[o], key[o]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        order[slots], head[slots] = u, fresh
        rank[u] = np.maximum.accumulate(np.where(fresh, slots, 0))
        k *= 2


class FMIndex:
    """Backward search over runs of symbols 1.., each run ended by a separator (0)."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, wavelet: WaveletMatrix, kept: np.ndarray, sample: np.ndarray) -> None:
        self.lengths, self.counts, self.wavelet, self.kept, self.sample = lengths, counts, wavelet, kept, sample
        self.run_start = np.cumsum(lengths + 1) - (lengths + 1)
        self.c = np.concatenate(([0], np.cumsum(counts)))
        self.kept_before = np.cumsum(kept) - kept
        self.n = wavelet.n

    @classmethod
    def of(cls, symbols: np.ndarray, lengths: np.ndarray, alphabet: int) -> FMIndex:
        """Index of runs of the given lengths, their symbols one after the other."""
        start = np.cumsum(lengths + 1) - (lengths + 1)
        n = int((lengths + 1).sum())
        text, is_sep = np.zeros(n, np.int64), np.zeros(n, bool)
        is_sep[start + lengths] = True
        text[~is_sep] = symbols
        # every separator sorts before all symbols and differs from the others, so equal runs stay apart
        order = suffix_order(np.where(is_sep, np.cumsum(is_sep) - 1, text + len(lengths)))
        begins = np.zeros(n, bool)
        begins[start] = True
        kept = (order % SAMPLE == 0) | begins[order]
        return cls(lengths, np.bincount(text, minlength=alphabet + 1), WaveletMatrix.of(text[order - 1], max(1, int(alphabet).bit_length())), kept, order[kept])

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix interval of each row of ``phrases`` (all of the same length), empty where it does not occur."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            low[live] = self.c[c] + self.wavelet.rank(c, low[live])
            high[live] = self.c[c] + self.wavelet.rank(c, high[live])
            live = live[high[live] > low[live]]
            if not len(live):
                break
        high = np.maximum(high, low)
        dead = np.ones(len(phrases), bool)
        dead[live] = False
        high[dead] = low[dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffixes given by their rows."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.kept[at])
        while len(todo):
            c = self.wavelet.symbol(at[todo])
            at[todo] = self.c[c] + self.wavelet.rank(c, at[todo])
            steps[todo] += 1
            todo = todo[~self.kept[at[todo]]]
        return self.sample[self.kept_before[at]] + steps


_COLUMNS = ("lengths", "vocabulary", "counts", "planes", "kept", "sample", "gaps", "sizes")


def _narrow(a: np.ndarray) -> bytes:
    """Whole numbers in two bytes each, or in four where they need it."""
    return a.astype("<u2" if not len(a) or a.max() < 1 << 16 else "<u4").tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.int64)


def _shard_row(keys: list, parts: list[tuple], key_type: pa.DataType, offsets: bool) -> pa.RecordBatch:
    lengths, h, first, size = (np.concatenate(x) for x in zip(*parts))
    vocabulary, code = np.unique(h, return_inverse=True)
    index = FMIndex.of(code + 1, lengths, len(vocabulary))
    gaps = sizes = None
    if offsets:
        begin = np.cumsum(lengths) - lengths
        gaps = np.diff(first, prepend=0)
        gaps[begin] = first[begin]
        gaps, sizes = _narrow(gaps), _narrow(size)
    raw = [lengths.astype("<i4").tobytes(), vocabulary.astype("<u8").tobytes(), index.counts.astype("<i4").tobytes(), index.wavelet.planes.tobytes(), np.packbits(index.kept).tobytes(), index.sample.astype("<i4").tobytes(), gaps, sizes]
    return pa.RecordBatch.from_arrays([pa.array([keys], pa.list_(key_type)), *[pa.array([x], pa.binary()) for x in raw]], ["keys", *_COLUMNS])


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard: int = SHARD, offsets: bool = True) -> DataFrame:
    """The FM-index of all documents, one row per shard: a table to be written and searched by :func:`search_index`.

    With ``offsets`` it also keeps where in its text each word stands, so that spans come out in characters. Null texts and
    texts without a word are not in it; a repeated document is in it each time. Empty tables give no rows.
    """
    src = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).filter("_t is not null")
    kind = dict(src.dtypes)["_k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomgraph.llm import leakage as me

        keys, parts, n, chars, key_type = [], [], 0, 0, pa.int64()
        for b in batches:
            key_type = b.schema.field(0).type
            for some_keys, texts in me._chunks(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at, h, first, size = me.numbered_words(texts)
                lengths = np.bincount(at, minlength=len(texts))
                keys += [k for k, x in zip(some_keys, lengths) if x]
                parts.append((lengths[lengths > 0], h, first, size))
                n, chars = n + len(h), chars + sum(map(len, texts))
                if n >= shard or chars >= me.SHARD_CHARS:
                    if n:
                        yield me._shard_row(keys, parts, key_type, offsets)
                    keys, parts, n, chars = [], [], 0, 0
        if n:
            yield me._shard_row(keys, parts, key_type, offsets)

    return src.mapInArrow(run, f"keys array<{kind}>, " + ", ".join(f"{c} binary" for c in _COLUMNS))


def _chunks(keys: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK or i + 1 == len(texts):
            yield keys[at : i + 1], texts[at : i + 1]
            at, size = i + 1, 0


class Phrases:
    """All phrases of ``size`` consecutive words of a block of test items, as arrays."""

    def __init__(self, items: Sequence[tuple[str, list[str]]], size: int = WORDS) -> None:
        self.size, self.items = size, [k for k, _ in items]
        texts = [t for _, ts in items for t in ts]
        of = np.repeat(np.arange(len(items)), [len(ts) for _, ts in items])
        at, h, _, _ = numbered_words(texts) if texts else (np.zeros(0, np.int64),) * 4
        self.vocabulary, code = np.unique(h, return_inverse=True)
        start = np.arange(max(0, len(code) - size + 1))
        start = start[at[start] == at[start + size - 1]] if len(start) else start
        grams = code[start[:, None] + np.arange(size)].astype(np.int32).reshape(-1, size)
        self.grams, which = np.unique(grams, axis=0, return_inverse=True)
        pairs = np.unique(np.stack((which.reshape(-1), of[at[start]] if len(start) else start)), axis=1)
        self.first, self.item = np.searchsorted(pairs[0], np.arange(len(self.grams) + 1)), pairs[1]


def _expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, .. for every pair of first and count, one after the other."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def _search(row: dict, p: Phrases) -> Iterator[tuple]:
    """(document, item, spans) of a shard."""
    vocabulary = np.frombuffer(row["vocabulary"], "<u8")
    at = np.minimum(np.searchsorted(vocabulary, p.vocabulary), len(vocabulary) - 1)
    grams = np.where(vocabulary[at] == p.vocabulary, at + 1, 0)[p.grams]
    there = np.flatnonzero((grams > 0).all(1))
    if not len(there):
        return
    lengths, counts = np.frombuffer(row["lengths"], "<i4").astype(np.int64), np.frombuffer(row["counts"], "<i4").astype(np.int64)
    n = int((lengths + 1).sum())
    planes = np.frombuffer(row["planes"], "<u8").reshape(-1, n // 64 + 1)
    kept = np.unpackbits(np.frombuffer(row["kept"], np.uint8), count=n).astype(bool)
    index = FMIndex(lengths, counts, WaveletMatrix(n, planes), kept, np.frombuffer(row["sample"], "<i4").astype(np.int64))
    low, high = index.find(grams[there])
    count = high - low
    if not count.any():
        return
    place = index.locate(_expand(low, count))
    gram = np.repeat(there, count)
    many = p.first[gram + 1] - p.first[gram]
    place, item = np.repeat(place, many), p.item[_expand(p.first[gram], many)]
    doc = np.searchsorted(index.run_start, place, "right") - 1
    word = place - index.run_start[doc]
    o = np.lexsort((word, item, doc))
    doc, item, word = doc[o], item[o], word[o]
    same = np.concatenate(([False], (doc[1:] == doc[:-1]) & (item[1:] == item[:-1])))
    new = ~(same & (np.diff(word, prepend=0) < p.size))
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(word)) - 1
    a, b = word[begin], word[end] + p.size - 1
    if row.get("gaps") is not None:
        base = np.cumsum(lengths) - lengths
        total = int(lengths.sum())
        at = np.cumsum(_wide(row["gaps"], total))
        at -= np.repeat(at[base] - _wide(row["gaps"], total)[base], lengths)
        size, of = _wide(row["sizes"], total), base[doc[begin]]
        a, b = at[of + a], at[of + b] + size[of + b]
    else:
        b = b + 1
    spans: dict[tuple[int, int], list] = {}
    for d, i, x, y in zip(doc[begin].tolist(), item[begin].tolist(), a.tolist(), b.tolist()):
        spans.setdefault((d, i), []).append({"start": x, "end": y})
    for (d, i), s in spans.items():
        yield row["keys"][d], p.items[i], s


def _blocks(items: DataFrame, item: str, texts: str) -> Iterator[list[tuple[str, list[str]]]]:
    """Test items in blocks of at most BLOCK_WORDS words; one block is on the driver at a time."""
    block, size = [], 0
    for r in items.select(item, texts).toLocalIterator():
        if r[0] is None or not r[1]:
            continue
        t = [x for x in r[1] if x]
        n = sum(x.count(" ") + 1 for x in t)
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r[0], t))
        size += n
    if block:
        yield block


def search_index(index: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "id", texts: str = "texts", size: int = WORDS) -> DataFrame:
    """(``key``, ``item_id``, ``spans``): documents of an index with at least ``size`` consecutive words of one of the item's ``texts``.

    ``spans`` are (start, end) in characters of the text, or in words where the index has no offsets; disjoint and in order. Items with fewer words
    than ``size`` cannot leak. The items are the query set: their phrases are arrays that go to the workers in blocks of at most BLOCK_WORDS
    words, every block against the whole index; an item text is never cut. No items or an empty index give no rows.
    """
    kind = dict(index.dtypes)["keys"][len("array<") : -1]
    ddl = f"_k {kind}, item_id string, spans array<struct<start:int,end:int>>"
    out = None
    for block in _blocks(items, item, texts):
        p = Phrases(block, size)
        if not len(p.grams):
            continue
        sent = index.sparkSession.sparkContext.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            from loomgraph.llm import leakage as me

            for b in batches:
                for row in b.to_pylist():
                    yield me._rows(me._search(row, sent.value), b.schema.field("keys").type.value_type)

        found = index.mapInArrow(run, ddl)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = index.sparkSession.createDataFrame([], ddl)
    return out.withColumnRenamed("_k", key)


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "id", texts: str = "texts", size: int = WORDS, shard: int = SHARD, offsets: bool = True) -> DataFrame:
    """:func:`search_index` over an index of ``docs`` that is built and written first.

    Null and empty texts leak nothing. Repeated documents come out each. Documents of any length are searched whole. Empty tables give
    no rows; other columns are dropped.
    """
    index = build_index(docs, key, text, shard, offsets)
    return search_index(materialize(index if offsets else index.drop("gaps", "sizes"), "leak-index"), items, key, item, texts, size)


def _rows(found: Iterator[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    rows = list(found)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], key_type), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], span)], ["_k", "item_id", "spans"])
