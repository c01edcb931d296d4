"""Filling fixed-capacity containers with whole items.

Items are routed to context-size tiers by their length: windows of the whole capacity, of a half, a quarter and an
eighth. Every tier packs its own items, the longest first, and fills the gaps of its windows with the longest items of shorter tiers
that fit. The windows of a shorter tier are laid side by side into containers of the capacity; those that shorter items cannot
fill are dissolved, and what is left at the end is packed into long windows. Lengths are whole numbers up to the
capacity, so the plan needs only how many items have each length: a table that the capacity bounds, whatever the corpus; a
filling is repeated as often as the counts allow. Every item then finds its container by its length and its rank among the
items of that length, which takes one shuffle of small rows. Containers are dealt to step groups so that all
groups have the same load of tokens and of items.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import materialize

CAPACITY = 2048
#: Windows of a container in each tier.
TIERS = (1, 2, 4, 8)
#: A window of a shorter tier counts as filled from this share on.
FULL = 0.995
#: Containers that one training step takes at least.
STEP = 64
#: Items per bucket, and the least and most buckets, over which the items of one length are ranked.
BUCKET_ITEMS, FEWEST, MOST = 4_000_000, 64, 8192
#: Folder of the vocabulary files.
TOKENIZERS = os.environ.get("LOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's byte-level BPE splits a text before it merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("files", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def vocabulary(folder: str = TOKENIZERS, name: str = VOCABULARY) -> bytes:
    """The vocabulary file; about a megabyte, so it can go to the workers."""
    with open(os.path.join(folder, name), "rb") as f:
        return f.read()


def token_count(text: str, folder: str = TOKENIZERS, name: str = VOCABULARY) -> int:
    """Tokens of a text; strings that name special tokens are ordinary text."""
    return len(_encoding(vocabulary(folder, name)).encode_ordinary(text))


def token_sizes(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(``key``, ``n_tokens``) per row; null texts are left out, empty ones have 0 tokens. Only the driver reads the vocabulary file."""
    src = df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).filter("_t is not null")
    sent = df.sparkSession.sparkContext.broadcast(vocabulary(folder, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomgraph.llm import packing as me

        encode = me._encoding(sent.value).encode_ordinary
        for b in batches:
            seen: dict[str, int] = {}
            n = []
            for t in b.column(1).to_pylist():
                c = seen.get(t)
                if c is None:
                    c = seen[t] = len(encode(t))
                n.append(c)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["_k", "n_tokens"])

    return src.mapInArrow(run, f"_k {dict(src.dtypes)['_k']}, n_tokens bigint").withColumnRenamed("_k", key)


@dataclass
class Plan:
    """Where the items of every length go.

    ``ranges``: per length rows (first rank, items per window, first window, windows per container, first container of the tier): the item
    of rank r goes to window w = first window + (r - first rank) // items per window of the tier, which is in the container
    first container + w // windows per container. ``classes``: rows (first container, place in the dealing order), one per run of
    containers of the same filling.
    """

    capacity: int
    ranges: dict[int, list[tuple[int, int, int, int, int]]] = field(default_factory=dict)
    classes: list[tuple[int, int]] = field(default_factory=list)
    containers: int = 0


def _filling(left: np.ndarray, sizes: np.ndarray, room: int) -> dict[int, int]:
    """Items per length of one window: again and again the longest that fits."""
    use: dict[int, int] = {}
    top = len(sizes)
    while room and top:
        top = int(np.searchsorted(sizes[:top], room, "right"))
        if not top:
            break
        s = int(sizes[top - 1])
        use[s] = min(room // s, int(left[s]))
        room -= use[s] * s
        top -= 1
    return use


def _pack_tier(left: np.ndarray, room: int, slots: int, lead: int, full: float) -> list[tuple[dict[int, int], int]]:
    """Fillings of windows of ``room`` with how often each occurs, led by items over ``lead``; ``left`` loses what is packed.

    Fillings under ``full`` are not made. Windows that make no whole container of ``slots`` are dissolved again.
    """
    made, skip = [], set()
    while True:
        sizes = np.flatnonzero(left[: room + 1])
        sizes = sizes[sizes > 0]
        leads = [s for s in sizes[np.searchsorted(sizes, lead, "right") :].tolist() if s not in skip]
        if not leads:
            break
        use = _filling(left, sizes[: np.searchsorted(sizes, leads[-1], "right")], room)
        if sum(s * m for s, m in use.items()) < full * room:
            skip.add(leads[-1])
            continue
        repeat = min(int(left[s]) // m for s, m in use.items())
        for s, m in use.items():
            left[s] -= m * repeat
        made.append((use, repeat))
    spare = sum(r for _, r in made) % slots
    while spare:
        use, repeat = made.pop()
        back = min(spare, repeat)
        for s, m in use.items():
            left[s] += m * back
        if repeat > back:
            made.append((use, repeat - back))
        spare -= back
    return made


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Packs so many items of every length."""
    left = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        left[s] = n
    stages = [(k, _pack_tier(left, capacity // k, k, capacity // (2 * k), FULL if k > 1 else 0)) for k in TIERS]
    stages.append((1, _pack_tier(left, capacity, 1, 0, 0)))
    out, taken, runs = Plan(capacity), np.zeros(capacity + 1, np.int64), []
    for k, made in stages:
        window = 0
        for use, repeat in made:
            for s, m in use.items():
                out.ranges.setdefault(s, []).append((int(taken[s]), m, window, k, out.containers))
                taken[s] += m * repeat
            # containers that begin in this filling
            a, b = -(-window // k), -(-(window + repeat) // k)
            if b > a:
                runs.append((out.containers + a, b - a, k * sum(use.values()), k * sum(s * m for s, m in use.items())))
            window += repeat
        out.containers += window // k
    place = 0
    for first, n, _, _ in sorted(runs, key=lambda r: (r[3] < FULL * capacity, r[2], r[0])):
        out.classes.append((first, place))
        place += n
    out.classes.sort()
    return out


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, step: int = STEP) -> DataFrame:
    """(``container``, ``key``, ``part``, ``size``, ``tier``, ``slot``, ``step_group``): every item in one container of ``capacity``.

    An item longer than ``capacity`` is split into parts of ``capacity`` and a rest, numbered from 1; all others have part 1.
    Items of length 0 take no space and go to container 0. Rows with a null or negative ``size`` are left out. Rows with the same key are items each.
    ``tier`` is the length of the window that the piece is in and ``slot`` the window's number in its container, from 0. Containers
    are dealt to groups of ``step`` or a few more in turn and back, in the order of their number of items. An empty table gives no rows.
    """
    items = sizes.select(F.col(key).alias("_k"), F.col(size).cast("bigint").alias("_n")).filter("_n >= 0")
    parts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("_n") / capacity)).cast("int"))
    items = items.select("_k", "_n", F.explode(parts).alias("part")).select("_k", "part", F.least(F.lit(capacity), F.col("_n") - (F.col("part") - 1) * capacity).alias("size"))
    items = materialize(items, "items")
    buckets = min(MOST, max(FEWEST, -(-items.count() // BUCKET_ITEMS)))
    items = items.withColumn("bucket", F.pmod(F.xxhash64("_k", "part"), F.lit(buckets)).cast("int"))
    by = materialize(items.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n")), "lengths")
    p = plan({r[0]: r[1] for r in by.filter("size > 0").groupBy("size").agg(F.sum("n")).collect()}, capacity)
    before = by.select("size", "bucket", (F.sum("n").over(Window.partitionBy("size").orderBy("bucket")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("_k", "part")) - 1
    # lengths times buckets rows: joined where the ranks are, not sent to every task
    ranked = items.withColumn("_i", local).join(before.hint("merge"), ["size", "bucket"]).select("_k", "part", "size", (F.col("before") + F.col("_i")).alias("rank"))
    # the plan is bounded by the capacity: a few ranges per length
    where = {s: tuple(np.array(c, np.int64) for c in zip(*r)) for s, r in p.ranges.items()}
    dealt = tuple(np.array(c, np.int64) for c in zip(*p.classes)) or (np.zeros(1, np.int64),) * 2
    sent = sizes.sparkSession.sparkContext.broadcast((where, *dealt))
    groups = max(1, p.containers // step)
    kind = dict(items.dtypes)["_k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, starts, places = sent.value
        for b in batches:
            s, rank = b.column(2).to_numpy(), b.column(3).to_numpy()
            box, slot, slots = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64), np.full(len(s), TIERS[-1])
            for one in np.unique(s[s > 0]):
                first, m, window, k, base = where[int(one)]
                i = np.flatnonzero(s == one)
                j = np.searchsorted(first, rank[i], "right") - 1
                w = window[j] + (rank[i] - first[j]) // m[j]
                box[i], slot[i], slots[i] = base[j] + w // k[j], w % k[j], k[j]
            j = np.searchsorted(starts, box, "right") - 1
            turn = (places[j] + box - starts[j]) % (2 * groups)
            group = np.where(turn < groups, turn, 2 * groups - 1 - turn)
            yield pa.RecordBatch.from_arrays([pa.array(box), *b.columns[:3], pa.array((capacity // slots).astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(group)], ["container", "_k", "part", "size", "tier", "slot", "step_group"])

    placed = ranked.mapInArrow(run, f"container bigint, _k {kind}, part int, size bigint, tier int, slot int, step_group bigint")
    return placed.withColumnsRenamed({"_k": key, "size": size})
