"""Parent-child links to full hierarchies by contracting fragments.

Nodes are placed so that pieces of the forest share a partition: some nodes are centres (by a hash that
changes with every level), a node looks up for its nearest centre by pointer doubling, and goes where that centre goes.
Each partition then contracts the chains that stay inside it: all nodes that leave the partition by the same link are one
tree, named after its topmost node. Only trees that another tree points at stay in the quotient forest, about one node in eight on
a chain and far fewer where the forest branches. It is solved the same way until it fits one fragment. The
results of the trees are then laid over those of their nodes. A circle is seen where all of its nodes have met; trees that it runs
through are walked again from the node where it enters. The path is the same at every size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.skew import HOT_SHARE, split_join
from loomgraph.session import materialize

#: Nodes that one partition holds at most, and that the last quotient forest has at most.
FRAGMENT = 500_000
#: Small forests are cut as well: a fragment holds at most this part of all nodes, but never needs to be under LEAST.
SHARE, LEAST = 4, 64
#: One node in so many is a centre; doublings look 2 ** LOOKS links up.
CENTRE, LOOKS = 8, 4
#: Numbers of path elements that a batch of output holds.
BATCH = 500_000
_COLUMNS = {"id": pa.int64(), "parent": pa.int64(), "w": pa.int64(), "top": pa.int64(), "dist": pa.int64(), "kind": pa.string(), "exit": pa.int64(), "path": pa.list_(pa.int64())}
_OUT = "id bigint, parent bigint, w bigint, top bigint, dist bigint, kind string, exit bigint, path array<bigint>"
_RESULT = ("id", "kind", "top", "dist", "exit", "path")
ROOT, OUT, CIRCLE, BELOW = range(4)
_KINDS = np.array(["root", "out", "circle", "below"], object)


def current_rows(df: DataFrame, id_: str = "id", order: str = "ord") -> DataFrame:
    """The row with the highest ``order`` of every id that is not null; among ties any one of the same ``order``."""
    cols = [c for c in df.columns if c != id_]
    last = df.filter(F.col(id_).isNotNull()).groupBy(id_).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_r"))
    return last.select(id_, *[F.col(f"_r.{c}").alias(c) for c in cols])


def contract(ids: np.ndarray, parents: np.ndarray, has: np.ndarray, weights: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every node of a fragment: the row of the last node of its chain, the weights up to there, kind and row of the parent here (-1: none).

    kind: ROOT (the chain ends in a root), OUT (it leaves by the last node's link), CIRCLE (the node is on a circle), BELOW (it
    leads to one; the last node is the one before it). ``start`` marks nodes that a circle through other fragments enters
    at: they and all nodes above them here are on it.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    at = np.minimum(np.searchsorted(sorted_ids, parents), n - 1)
    up = np.where(has & (sorted_ids[at] == parents), order[at], -1)
    far, k = up.copy(), 1
    while k <= n and (far >= 0).any():  # who still has an ancestor after n links is on a circle or below one
        far = np.where(far >= 0, far[far], -1)
        k *= 2
    on = np.zeros(n, bool)
    on[far[far >= 0]] = True  # the far ancestors of a circle's nodes are all of its nodes
    walk = np.flatnonzero(start)
    while len(walk):
        on[walk] = True
        walk = up[walk]
        walk = walk[walk >= 0]
        walk = walk[~on[walk]]
    ends = (up < 0) | on | on[up]
    last = np.where(ends, np.arange(n), up)
    far = np.where(ends, 0, weights)
    while True:
        nxt = last[last]
        if (nxt == last).all():
            break
        far = far + far[last]
        last = nxt
    kind = np.where(up[last] >= 0, BELOW, np.where(has[last], OUT, ROOT))
    kind[on] = CIRCLE
    last[on], far[on] = np.flatnonzero(on), 0
    return last, far, kind, up


def _fragments(paths: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a partition does with its rows (id, parent, w, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        ids, w = t.column("id").to_numpy(), t.column("w").to_numpy()
        has = t.column("parent").is_valid().to_numpy()
        parents = t.column("parent").fill_null(0).to_numpy()
        last, far, kind, up = contract(ids, parents, has, w, t.column("start").to_numpy())
        leaves = (kind == OUT) | (kind == BELOW)
        exits = np.where(kind == CIRCLE, ids, parents[last])
        rows = [ids, parents, w, ids[last], far, _KINDS[kind], exits, None]
        nulls = [None, ~has, None, None, None, None, ~(leaves | (kind == CIRCLE)), None]
        at = 0
        while at < len(ids):
            to, path = at, None
            if paths:
                path, size = [], 0
                while to < len(ids) and size < BATCH:
                    j, p = to, [int(ids[to])]
                    while j != last[j]:
                        j = up[j]
                        p.append(int(ids[j]))
                    path.append(p)
                    size += len(p)
                    to += 1
            else:
                to = min(len(ids), at + BATCH)
                path = [None] * (to - at)
            cols = [pa.array(path, kind_) if r is None else pa.array(r[at:to], kind_, mask=None if m is None else m[at:to]) for r, m, kind_ in zip(rows, nulls, _COLUMNS.values())]
            yield pa.RecordBatch.from_arrays(cols, list(_COLUMNS))
            at = to

    return run


def _meet(rows: DataFrame, dim: DataFrame, on: str, n: int, how: str = "inner") -> DataFrame:
    """Join with a table of one row per ``on``; values that a 200th of ``n``, the most that ``rows`` can be, share meet a broadcast of at most 200."""
    hot = rows.filter(F.col(on).isNotNull()).groupBy(on).count().filter(F.col("count") >= max(2.0, HOT_SHARE * n))
    return split_join(rows, dim, on, [r[0] for r in hot.select(on).collect()], how)


def placed(links: DataFrame, fragment: int, level: int) -> DataFrame:
    """``links`` (``id``, ``parent``, ``w``) with ``place``: nodes with the same value belong in one partition.

    No value has more than about a quarter of ``fragment`` nodes. Parents and pieces over that are known from their
    counts, of which at most 4 n / ``fragment`` exist: that bounds the two broadcasts. A large parent is a centre; the
    nodes of a large piece pair with their parent or go alone.
    """
    limit = max(1, fragment // 4)
    coin = lambda c, k, of: F.pmod(F.xxhash64(F.lit(level * 2 + k), c), F.lit(of)) == 0
    large = links.filter("parent is not null").groupBy("parent").count().filter(F.col("count") > limit).select("parent", F.lit(True).alias("large"))
    rows = links.join(F.broadcast(large), "parent", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    own = F.col("parent").isNull() | coin("id", 0, CENTRE)
    state = materialize(rows.select("id", "parent", "w", "large", F.when(own, F.col("id")).otherwise(F.col("parent")).alias("at"), (own | F.col("large") | coin("parent", 0, CENTRE)).alias("stop")), "places")
    for i in range(LOOKS):
        nxt = state.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("stop").alias("next_stop"))
        moved = state.filter("not stop").join(nxt, "at").select("id", "parent", "w", "large", F.col("next").alias("at"), "next_stop")
        state = state.filter("stop").unionByName(moved.withColumnRenamed("next_stop", "stop"))
        if i % 2:
            state = materialize(state, "places")
    crowded = state.groupBy("at").count().filter(F.col("count") > limit).select("at", F.lit(True).alias("crowded"))
    alone = F.col("parent").isNull() | F.col("large") | coin("id", 1, 2) | ~coin("parent", 1, 2)
    mate = F.when(alone, F.col("id")).otherwise(F.col("parent"))
    return state.join(F.broadcast(crowded), "at", "left").select("id", "parent", "w", F.when(F.col("crowded"), mate).otherwise(F.col("at")).alias("place"))


def parted(links: DataFrame, n: int, fragment: int, level: int) -> DataFrame:
    """``links`` with every place in one partition, of which there are enough to hold half a fragment on average."""
    return placed(links, fragment, level).repartition(max(2, -(-2 * n // fragment)), "place")


def _ended(trees: DataFrame, onward: Column) -> DataFrame:
    """Results of the trees whose link leads to a node with a final result of its own."""
    kind = F.col("y_kind")
    hits = kind == "circle"
    return trees.filter(kind != "out").select(
        "tree", F.when(kind == "root", kind).otherwise("below").alias("kind"), F.when(hits, F.col("tree")).otherwise(F.col("y_top")).alias("top"),
        F.when(hits, 0).otherwise(F.col("w") + F.col("y_dist")).alias("dist"), F.when(hits, F.col("exit")).otherwise(F.col("y_exit")).alias("exit"), onward,
    )


def _solve(links: DataFrame, fragment: int, level: int, paths: bool) -> DataFrame:
    """(id, kind, top, dist, exit, path) of every id of ``links`` (id, parent, w); every parent exists.

    kind 'root': ``top`` is the root, ``dist`` the weights up to it. 'circle': on one. 'below': ``exit`` is the circle's node
    that the chain meets, ``top`` the node before it. ``path`` runs from the id to ``top``; null without ``paths``.
    """
    run, n = _fragments(paths), links.count()
    if n <= fragment:
        return materialize(links.repartition(1).select("id", "parent", "w", F.lit(False).alias("start")).mapInArrow(run, _OUT).select(*_RESULT), "last")
    local = materialize(parted(links, n, fragment, level).select("id", "parent", "w", F.lit(False).alias("start")).mapInArrow(run, _OUT), "fragments")
    # one row per tree that leaves its fragment, with what is known of the node it leads to
    to = local.select(F.col("id").alias("exit"), *[F.col(c).alias(f"y_{c}") for c in ("kind", "top", "dist", "exit", "path")])
    trees = materialize(_meet(local.filter("kind = 'out' and id = top").select(F.col("id").alias("tree"), "exit", "w"), to, "exit", n), "trees")
    pointed = trees.filter("y_kind = 'out'").select(F.col("y_top").alias("tree")).distinct()
    inner = F.col("y_kind") == "out"
    quotient = trees.join(pointed, "tree", "left_semi").select(F.col("tree").alias("id"), F.when(inner, F.col("y_top")).alias("parent"), (F.col("w") + F.when(inner, F.col("y_dist")).otherwise(0)).alias("w"))
    solved = _solve(materialize(quotient, "quotient"), fragment, level + 1, paths)
    again = None
    ring = solved.filter("kind = 'circle'").select(F.col("id").alias("top"))
    if not ring.isEmpty():
        enters = trees.join(ring.withColumnRenamed("top", "tree"), "tree", "left_semi").select(F.col("exit").alias("id"), F.lit(True).alias("start"))
        rows = local.filter("kind = 'out'").join(ring, "top", "left_semi").join(enters, "id", "left")
        rows = rows.repartition(max(2, -(-2 * n // fragment)), "top").select("id", "parent", "w", F.coalesce("start", F.lit(False)).alias("start"))
        again = materialize(rows.mapInArrow(run, _OUT), "rings")
        now = again.select(F.col("id").alias("exit"), *[F.col(c).alias(f"z_{c}") for c in ("kind", "top", "dist", "exit", "path")])
        other = trees.join(ring.withColumnRenamed("top", "tree"), "tree", "left_anti")
        met = _meet(other, now, "exit", n, "left")
        trees = materialize(met.select("tree", "exit", "w", *[F.when(F.col("z_kind").isNotNull(), F.col(f"z_{c}")).otherwise(F.col(f"y_{c}")).alias(f"y_{c}") for c in ("kind", "top", "dist", "exit", "path")]), "trees")
    onward = F.when(F.col("y_kind") == "circle", F.array().cast("array<bigint>")).otherwise(F.col("y_path")).alias("path")
    ended = _ended(trees, onward)
    # of the quotient's trees: the last one's end, and what lies between
    chains = solved.filter("kind <> 'circle'").select(F.col("id").alias("y_top"), F.col("top").alias("tree"), F.col("dist").alias("q_dist"), F.col("path").alias("q_path"))
    between = _meet(chains.drop("q_path"), ended.drop("path"), "tree", n).select("y_top", "kind", "top", (F.col("q_dist") + F.col("dist")).alias("q_dist"), F.col("exit").alias("q_exit"))
    if paths:
        steps = _meet(chains.select("y_top", F.posexplode("q_path").alias("pos", "tree")), trees.select("tree", onward), "tree", n)
        rest = steps.groupBy("y_top").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda x: x["path"])).alias("q_path"))
        between = between.join(rest, "y_top")
    else:
        between = between.withColumn("q_path", F.lit(None).cast("array<bigint>"))
    through = _meet(trees.filter(inner).select("tree", "w", "y_top", "y_dist", "y_path"), between, "y_top", n)
    through = through.select("tree", "kind", "top", (F.col("w") + F.col("y_dist") + F.col("q_dist")).alias("dist"), F.col("q_exit").alias("exit"), F.concat("y_path", "q_path").alias("path"))
    known = ended.unionByName(through).select(F.col("tree").alias("top"), *[F.col(c).alias(f"f_{c}") for c in ("kind", "top", "dist", "exit", "path")])
    laid = local.filter("kind = 'out'").join(known, "top").select("id", F.col("f_kind").alias("kind"), F.col("f_top").alias("top"), (F.col("dist") + F.col("f_dist")).alias("dist"), F.col("f_exit").alias("exit"), F.concat("path", "f_path").alias("path"))
    out = local.filter("kind <> 'out'").select(*_RESULT).unionByName(laid)
    return materialize(out if again is None else out.unionByName(again.select(*_RESULT)), "solved")


def hierarchy(links: DataFrame, id_: str = "id", parent: str = "parent", fragment: int | None = None, paths: bool = True) -> DataFrame:
    """Per id: ``path`` (from the root down to the id), ``depth``, ``root``, ``kind`` and ``circle``.

    kind: 'tree'; 'missing' (the topmost parent named does not exist, its child counts as root); 'circle' (on a
    circle of parent links, its own parent included: path is the id alone, depth and root null); 'below' (leads to
    one: path starts under it, ``circle`` is the node it hangs on, root null). Ids are unique and not null (see
    :func:`current_rows`); null ids are left out. Columns of ``links`` other than the two are not read. Empty gives empty.
    Without ``paths`` the path is null and a chain of any length takes no more room than its nodes. ``fragment`` bounds the nodes of a
    partition and of the last quotient forest; the default is a quarter of the nodes, at most FRAGMENT.
    """
    nodes = links.select(F.col(id_).cast("bigint").alias("id"), F.col(parent).cast("bigint").alias("parent")).filter("id is not null")
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    n = nodes.count()
    nodes = materialize(_meet(nodes, known, "parent", n, "left").select("id", F.when(F.col("known"), F.col("parent")).alias("parent"), (F.col("parent").isNotNull() & F.col("known").isNull()).alias("missing")), "links")
    if fragment is None:
        fragment = min(FRAGMENT, max(LEAST, -(-n // SHARE)))
    solved = _solve(nodes.select("id", "parent", F.lit(1).cast("bigint").alias("w")), fragment, 0, paths)
    missing = nodes.filter("missing").select(F.col("id").alias("top"), F.lit(True).alias("missing"))
    root = F.col("kind") == "root"
    path = F.when(F.col("kind") == "circle", F.array("id")).otherwise(F.reverse("path")) if paths else F.col("path")
    return _meet(solved, missing, "top", n, "left").select(
        "id", path.alias("path"), F.when(root, F.col("dist")).alias("depth"), F.when(root, F.col("top")).alias("root"),
        F.when(~root, F.col("kind")).when(F.col("missing"), F.lit("missing")).otherwise(F.lit("tree")).alias("kind"), F.when(F.col("kind") == "below", F.col("exit")).alias("circle"),
    )


def descendants(h: DataFrame) -> DataFrame:
    """(``id``, ``descendant``, ``distance``): one row per ancestor and node under it, from the result of :func:`hierarchy`.

    A node that leads to a circle counts as a descendant of the circle's node that it hangs on.
    """
    up = F.when(F.col("circle").isNotNull(), F.concat(F.array("circle"), F.col("path"))).otherwise(F.col("path"))
    pairs = h.select(F.col("id").alias("descendant"), F.size(up).alias("_n"), F.posexplode(up).alias("_p", "id"))
    return pairs.filter("id <> descendant").select("id", "descendant", (F.col("_n") - 1 - F.col("_p")).alias("distance"))
