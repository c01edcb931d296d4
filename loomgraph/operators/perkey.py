"""Per-key totals of heavily skewed keys with dense accumulator arrays.

Every task reads an equal split of the input, dictionary-encodes the keys of its batches and scatters counts and sums
into dense arrays by code (``bincount``). It hands the arrays on in blocks: one row holds a code range of keys, given by
a hash, with their arrays. The blocks of a range are then reduced together: the range's keys get one shared
dictionary and the arrays of all tasks are added into one dense array by it. A key is one element of one block per task
and flush, however many rows it has; no data row is ever grouped by its key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that a task holds before it hands its arrays on; bounds a task's memory, drops nothing.
FLUSH_KEYS = 200_000
#: Characters of keys held before a flush, in a task or in a block.
FLUSH_CHARS = 64_000_000
#: Rows of the input per code range, and the least and most ranges.
RANGE_ROWS, FEWEST, MOST = 4_000_000, 32, 1 << 16
#: Sums of whole numbers are split here, so that their parts are exact as doubles within a batch.
_LOW = 26


def _scatter(code: np.ndarray, values: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How many values each code has that are not null, and their sum; whole numbers stay whole."""
    ok = pc.is_valid(values).to_numpy(zero_copy_only=False)
    n = np.bincount(code, weights=ok, minlength=size).astype(np.int64)
    if pa.types.is_floating(values.type):
        return n, np.bincount(code, weights=pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False), minlength=size)
    x = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
    high = np.bincount(code, weights=x >> _LOW, minlength=size).astype(np.int64)
    return n, (high << _LOW) + np.bincount(code, weights=x & ((1 << _LOW) - 1), minlength=size).astype(np.int64)


class Dense:
    """Growing dense arrays over a dictionary: rows per key, and for each summed column its values and their sum."""

    def __init__(self, whole: Sequence[bool]) -> None:
        self.codes: dict = {}
        self.chars = 0
        self.arrays = [np.zeros(1024, np.int64)]
        for w in whole:
            self.arrays += [np.zeros(1024, np.int64), np.zeros(1024, np.int64 if w else np.float64)]

    def encode(self, keys: Sequence) -> np.ndarray:
        """Codes of distinct keys; new ones get the next code."""
        of = np.empty(len(keys), np.int64)
        for i, k in enumerate(keys):
            c = self.codes.get(k)
            if c is None:
                c = self.codes[k] = len(self.codes)
                self.chars += len(k) if k else 0
            of[i] = c
        size = len(self.arrays[0])
        if len(self.codes) > size:
            more = max(len(self.codes), 2 * size) - size
            self.arrays = [np.pad(a, (0, more)) for a in self.arrays]
        return of

    def add_rows(self, keys: pa.Array, values: Sequence[pa.Array]) -> None:
        enc = keys.dictionary_encode(null_encoding="encode")
        code = self.encode(enc.dictionary.to_pylist())[enc.indices.to_numpy(zero_copy_only=False)]
        size = len(self.arrays[0])
        self.arrays[0] += np.bincount(code, minlength=size)
        for j, v in enumerate(values):
            n, s = _scatter(code, v, size)
            self.arrays[1 + 2 * j] += n
            self.arrays[2 + 2 * j] += s

    def add_block(self, keys: Sequence, arrays: Sequence[np.ndarray]) -> None:
        code = self.encode(keys)
        for mine, a in zip(self.arrays, arrays):
            mine[code] += a  # the keys of a block are distinct

    @property
    def full(self) -> bool:
        return len(self.codes) >= FLUSH_KEYS or self.chars >= FLUSH_CHARS

    def blocks(self, ranges: int) -> Iterator[tuple[int, list, list[np.ndarray]]]:
        """(range, keys, arrays) of the code ranges that have keys."""
        keys = list(self.codes)
        # a stable hash that all workers share; null and empty fall into the first range
        at = np.fromiter((_hash(k) % ranges for k in keys), np.int64, len(keys))
        order = np.argsort(at, kind="stable")
        cut = np.flatnonzero(np.diff(at[order], prepend=-1))
        for i in np.split(order, cut[1:]) if len(keys) else ():
            yield int(at[i[0]]), [keys[j] for j in i], [a[i] for a in self.arrays]


def _hash(key: str | None) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(key) if key else 0


def per_key(df: DataFrame, key: str, sums: Sequence[str] = ()) -> DataFrame:
    """Per value of the string column ``key``: ``n`` rows and for every column c of ``sums`` ``n_c`` and ``sum_c``.

    Null is a key of its own and comes out as null; empty texts are keys too. ``n_c`` counts the
    values of c that are not null, ``sum_c`` is their sum, 0 where there is none: a bigint for whole numbers, which wraps around beyond 64
    bits, else a double. An empty table gives no rows. Other columns of ``df`` are not read. Keys of any length stay whole.
    """
    kinds = dict(df.dtypes)
    whole = [kinds[c] in ("tinyint", "smallint", "int", "bigint") for c in sums]
    cols = [F.col(c).cast("bigint" if w else "double").alias(f"_v{i}") for i, (c, w) in enumerate(zip(sums, whole))]
    types = [pa.int64()] + [t for w in whole for t in (pa.int64(), pa.int64() if w else pa.float64())]
    names = ["n"] + [x for c in sums for x in (f"n_{c}", f"sum_{c}")]
    sql = {pa.int64(): "bigint", pa.float64(): "double"}
    inner = [f"a{i}" for i in range(len(names))]
    blocks_ddl = ", ".join(["block int", "keys array<string>", *[f"{i} array<{sql[t]}>" for i, t in zip(inner, types)]])
    rows_ddl = ", ".join(["key string", *[f"{i} {sql[t]}" for i, t in zip(inner, types)]])

    src = df.select(F.col(key).alias("key"), *cols)
    ranges = min(MOST, max(FEWEST, -(-df.count() // RANGE_ROWS)))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = Dense(whole)
        for b in batches:
            if b.num_rows:
                acc.add_rows(b.column(0), [b.column(1 + i) for i in range(len(whole))])
            if acc.full:
                yield from _block_rows(acc, ranges, inner, types)
                acc = Dense(whole)
        yield from _block_rows(acc, ranges, inner, types)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, acc = None, Dense(whole)
        for b in batches:
            for i in range(b.num_rows):
                block = b.column(0)[i].as_py()
                if block != at:  # the blocks of a range come one after the other
                    yield from _key_rows(acc, inner, types)
                    at, acc = block, Dense(whole)
                acc.add_block(b.column(1)[i].as_py(), [b.column(2 + j)[i].values.to_numpy() for j in range(len(types))])
        yield from _key_rows(acc, inner, types)

    parts = src.mapInArrow(scatter, blocks_ddl).repartition("block").sortWithinPartitions("block")
    return parts.mapInArrow(reduce, rows_ddl).withColumnsRenamed(dict(zip(inner, names)))


def _block_rows(acc: Dense, ranges: int, names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    for block, keys, arrays in acc.blocks(ranges):
        cols = [pa.array([block], pa.int32()), pa.array([keys], pa.list_(pa.string()))]
        cols += [pa.ListArray.from_arrays([0, len(a)], pa.array(a, t)) for a, t in zip(arrays, types)]
        yield pa.RecordBatch.from_arrays(cols, ["block", "keys", *names])


def _key_rows(acc: Dense, names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    if acc.codes:
        n = len(acc.codes)
        yield pa.RecordBatch.from_arrays([pa.array(list(acc.codes), pa.string()), *[pa.array(a[:n], t) for a, t in zip(acc.arrays, types)]], ["key", *names])


def dominant_keys(totals: DataFrame, share: float, n: str = "n") -> DataFrame:
    """Rows of a per-key table whose ``n`` is at least ``share`` of the sum of all ``n``; the null key is left out."""
    whole = totals.agg(F.sum(n).alias("_whole"))
    # one row against all: not a join of rows, the total is a scalar
    return totals.crossJoin(F.broadcast(whole)).filter(F.col("key").isNotNull() & (F.col(n) >= F.lit(share) * F.col("_whole"))).drop("_whole")
