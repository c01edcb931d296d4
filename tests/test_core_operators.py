"""Skewed keys, hierarchies and orphans against brute force, with the edge cases their docstrings name."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from loomgraph.operators import community as M
from loomgraph.operators import graph as G
from loomgraph.operators import hierarchy as H
from loomgraph.operators import orphans as O
from loomgraph.operators import perkey
from loomgraph.operators.skew import hot_keys, numbered, split_join


def test_per_key(spark, monkeypatch):
    monkeypatch.setattr(perkey, "FLUSH_KEYS", 7)
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 20 + [None, "", "y" * 3000] + list("abcdefghijkl")), r.choice([None, 1, 2, 3]), "x") for _ in range(2000)]
    df = spark.createDataFrame(rows, "name string, strength int, n string").repartition(5)
    got = {x.key: (x.n, x.n_strength, x.sum_strength) for x in perkey.per_key(df, "name", ["strength"]).collect()}
    want = {k: (sum(1 for a in rows if a[0] == k), sum(1 for a in rows if a[0] == k and a[1] is not None), sum(a[1] or 0 for a in rows if a[0] == k)) for k in {a[0] for a in rows}}
    assert got == want
    big = {x.key for x in perkey.dominant_keys(perkey.per_key(df, "name"), 0.2).collect()}
    assert big == {k for k, v in want.items() if k is not None and v[0] >= 400}
    assert perkey.per_key(df.limit(0), "name", ["strength"]).count() == 0
    big = spark.createDataFrame([("a", 2**60 + i, 0.5) for i in range(4)] + [("a", -(2**59) + 1, None)], "k string, i long, x double")
    assert [tuple(x) for x in perkey.per_key(big, "k", ["i", "x"]).collect()] == [("a", 5, 5, 4 * 2**60 + 6 - 2**59 + 1, 4, 2.0)]


def test_split_join_keeps_all_rows(spark):
    rows = spark.createDataFrame([("h", i) for i in range(50)] + [("c", 1), (None, 2), ("z", 3)], "k string, i int")
    dim = spark.createDataFrame([("h", 1), ("c", 2)], "k string, v int")
    hot = hot_keys(rows.groupBy("k").agg(F.count("*").alias("n")), "k", share=0.5)
    assert hot == ["h"]
    assert Counter(x.k for x in split_join(rows, dim, "k", hot).collect()) == {"h": 50, "c": 1}
    assert hot_keys(rows.limit(0).groupBy("k").agg(F.count("*").alias("n")), "k") == []


def test_numbered(spark):
    got = numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(6), ["x"], "i").collect()
    assert all(r.x == r.i for r in got) and len(got) == 1000


def _walk(par):
    out = {}
    for v in par:
        seen, x = [v], v
        while True:
            p = par[x]
            if p is None or p not in par:
                out[v] = (seen[::-1], len(seen) - 1, x, "tree" if p is None else "missing", None)
                break
            if p in seen:
                k = seen.index(p)
                out[v] = ([v], None, None, "circle", None) if v in seen[k:] else (seen[:k][::-1], None, None, "below", seen[k])
                break
            seen.append(p)
            x = p
    return out


def test_hierarchy_in_fragments(spark):
    for seed, n, frag in ((1, 150, 40), (2, 80, 1000), (3, 60, 15)):
        r = random.Random(seed)
        par = {i: None if (u := r.random()) < 0.05 else n + 5 if u < 0.08 else r.randrange(n) if u < 0.3 else max(0, i - r.randrange(1, 4)) if i else None for i in range(n)}
        df = spark.createDataFrame([(i, p, "x") for i, p in par.items()] + [(None, 1, "x")], "id int, parent int, path string")
        h = H.hierarchy(df, fragment=frag)
        got = {x.id: (list(x.path), x.depth, x.root, x.kind, x.circle) for x in h.collect()}
        want = _walk(par)
        assert got == want
        under = defaultdict(set)
        for v, (path, *_, circle) in want.items():
            for a in path[:-1] + ([circle] if circle is not None else []):
                under[a].add(v)
        found = defaultdict(set)
        for x in H.descendants(h).collect():
            found[x.id].add(x.descendant)
        assert found == under
        bare = {x.id: (x.path, x.depth, x.root, x.kind, x.circle) for x in H.hierarchy(df, fragment=frag, paths=False).collect()}
        assert bare == {v: (None, *w[1:]) for v, w in want.items()}
    assert H.hierarchy(df.limit(0)).count() == 0


def _forest(shape, n, r):
    if shape == "chain":
        order = list(range(n))
        r.shuffle(order)
        return {a: b for a, b in zip(order, [None, *order])}
    if shape == "star of chains":
        return {i: None if not i else i - 4 if i > 4 and i % 1000 else 0 for i in range(n)}
    return {i: i - r.randrange(1, 6) if i > 5 else None for i in range(n)}


@pytest.mark.parametrize("shape,n", [("chain", 200_000), ("star of chains", 6_000)])
def test_no_task_holds_more_than_a_fragment(spark, monkeypatch, shape, n):
    fragment, held, levels = n // 6, [], []

    def watched(links, size, most, level, parted=H.parted):
        out = parted(links, size, most, level)
        levels.append(size)
        held.append(max(x["count"] for x in out.groupBy(F.spark_partition_id()).count().collect()))
        return out

    monkeypatch.setattr(H, "parted", watched)
    par = _forest(shape, n, random.Random(7))
    got = H.hierarchy(spark.createDataFrame(list(par.items()), "id long, parent long"), fragment=fragment, paths=False)
    depth = {x.id: x.depth for x in got.collect()}
    roots = [v for v, p in par.items() if p is None]
    assert all(depth[v] == (0 if p is None else depth[p] + 1) for v, p in par.items()) and all(depth[v] == 0 for v in roots)
    assert max(held) <= fragment, held
    assert all(b <= 0.5 * a for a, b in zip(levels, levels[1:])), levels


def test_current_rows(spark):
    df = spark.createDataFrame([(1, 5, 2), (1, 9, None), (None, 1, 1), (2, 3, 1)], "id int, ord int, parent int")
    assert {(x.id, x.parent) for x in H.current_rows(df).collect()} == {(1, None), (2, 1)}


def _orphan_data():
    r, t0 = random.Random(5), datetime(2024, 1, 1)
    at = lambda: t0 + timedelta(hours=r.randrange(4000))
    reg = []
    for k in "abcdefgh":
        for _ in range(r.randrange(3)):
            b = at()
            reg += [(k, b, r.choice([None, b + timedelta(hours=r.randrange(1, 1500))]))] * r.choice([1, 1, 2])
    reg += [(None, at(), None), ("x", None, None), ("y", t0 + timedelta(9), t0)]
    refs = [(r.choice(["a"] * 9 + list("abcdefghxyz")), r.choice([None] + [at() for _ in range(30)]), i, r.choice(["source", "target"])) for i in range(500)] + [(None, t0, 501, "source")]
    want = [(i, s) for k, t, i, s in refs if not (k and t and any(q == k and b and b <= t and (g is None or g > t) for q, b, g in reg))]
    return reg, refs, want


def test_orphans_and_epochs(spark):
    reg, refs, want = _orphan_data()
    events = O.parent_events(spark.createDataFrame(reg, "name string, b timestamp, g timestamp"), "name", "b", "g")
    df = spark.createDataFrame(refs, "key string, ts timestamp, rel_id int, side string")
    for hot in ([], ["a"]):
        assert sorted((x.rel_id, x.side) for x in O.orphans(df, events, ["rel_id", "side"], hot).collect()) == sorted(want)
    alive = {k for k, b, g in reg if k and b and g is None}
    for bounds in ([], [datetime(2024, 3, 1)], [datetime(2024, 1, 1) + timedelta(hours=250 * i) for i in range(1, 20)]):
        found, pending = O.replay(df, events, ["side"], ["rel_id", "side"], bounds, ["a"])
        assert sorted((x.rel_id, x.side) for x in found.collect()) == sorted(want)
        snap = O.snapshot(df, pending, ["side"]).collect()
        assert sum(x.n_refs for x in snap) == len(refs) and sum(x.n_orphans for x in snap) == len(want)
        lost = {i for i, _ in want}
        assert sum(x.n_unresolved for x in snap) == sum(1 for k, _, i, _ in refs if i in lost and k not in alive)
    assert O.orphans(df.limit(0), events, ["rel_id", "side"]).count() == 0
    assert O.orphans(df, events.limit(0), ["rel_id", "side"]).count() == len(refs)


def test_louvain_distributed_and_local(spark):
    r = random.Random(3)
    pairs = [(f"{c}{i}", f"{c}{j}", 5) for c in "abc" for i in range(8) for j in range(i) if r.random() < 0.7] + [("a0", "b0", 1), ("b1", "c1", 1)]
    nodes = spark.createDataFrame([(f"{c}{i}",) for c in "abc" for i in range(8)] + [("alone",)], "key string")
    df = spark.createDataFrame([(min(u, v), max(u, v), w) for u, v, w in pairs], "u string, v string, weight bigint")
    for finish in (M.FINISH, 10):
        c = M.hierarchy(nodes, df, finish=finish).collect()
        top = [set(x.members) for x in c if x.level == 0]
        assert sorted(k for s in top for k in s) == sorted(x.key for x in nodes.collect())
        assert {"alone"} in top
        if finish == M.FINISH:
            assert {f"a{i}" for i in range(8)} in top and {f"c{i}" for i in range(8)} in top


def _planted(seed, groups=4, size=8, inside=0.4, across=20):
    r = random.Random(seed)
    e = {(f"g{g}n{j:02}", f"g{g}n{i:02}"): r.randrange(1, 6) for g in range(groups) for i in range(size) for j in range(i) if r.random() < inside}
    for _ in range(across):
        a, b = sorted((f"g{r.randrange(groups)}n{r.randrange(size):02}", f"g{r.randrange(groups)}n{r.randrange(size):02}"))
        if a != b:
            e[a, b] = 1
    return [(u, v, float(w)) for (u, v), w in e.items()]


def _modularity(pairs, label):
    m, k, inside = sum(w for *_, w in pairs), Counter(), 0.0
    for u, v, w in pairs:
        k[label[u]] += w
        k[label[v]] += w
        inside += w * (label[u] == label[v])
    return inside / m - sum(x * x for x in k.values()) / (4 * m * m)


def test_distributed_moving_leaves_no_gain(spark):
    pairs = _planted(4)
    edges = spark.createDataFrame([("p", *x) for x in pairs], "parent string, u string, v string, w double")
    nodes = spark.createDataFrame([("p", k) for k in sorted({k for u, v, _ in pairs for k in (u, v)})] + [("p", "alone"), ("q", "other")], "parent string, key string")
    q = []
    for finish in (M.FINISH, 0):
        part = {(x.parent, x.key): x.part for x in M.partition(nodes, edges, finish).collect()}
        assert len(part) == nodes.count() and part["p", "alone"] == "alone" and part["q", "other"] == "other"
        label = {k: c for (p, k), c in part.items() if p == "p"}
        q.append(_modularity(pairs, label))
    assert abs(q[0] - q[1]) < 0.02, q
    com = {x.key: x.com for x in M._move(edges).collect()}
    at = _modularity(pairs, com)
    near = defaultdict(set)
    for u, v, _ in pairs:
        near[u].add(com[v])
        near[v].add(com[u])
    assert max(_modularity(pairs, {**com, x: c}) for x in com for c in near[x]) <= at + 1e-12


def test_moving_takes_few_rounds_and_releases_what_they_leave(spark, monkeypatch):
    pairs = _planted(5, groups=12, size=20, inside=0.2, across=300)
    edges = spark.createDataFrame([(0, int(u[1:].replace("n", "")), int(v[1:].replace("n", "")), w) for u, v, w in pairs], "parent bigint, u bigint, v bigint, w double")
    rounds, freed = [], []
    real = M.materialize
    monkeypatch.setattr(M, "materialize", lambda df, name: rounds.append(name) or real(df, name))
    monkeypatch.setattr(M, "release", lambda spark: freed.append(len(rounds)))
    monkeypatch.setattr(M, "RELEASE", 2)
    label = {f"g{x.key // 100}n{x.key % 100:02}": x.com for x in M._move(edges, 400).collect()}
    n = rounds.count("moves")
    assert len(freed) == (n - 1) // 2, (n, freed)
    at = _modularity(pairs, label)
    near = defaultdict(set)
    for u, v, _ in pairs:
        near[u].add(label[v])
        near[v].add(label[u])
    assert max(_modularity(pairs, {**label, x: c}) for x in label for c in near[x]) <= at + 1e-12


def test_judging_does_not_depend_on_the_order_of_rows():
    r = np.random.RandomState(1)
    rows = []
    for block in range(4):
        other, c = r.randint(0, 30, 60), r.randint(0, 12, 60)
        order = np.lexsort((c, other))
        own = np.arange(block * 8, block * 8 + 8)
        rows.append((0, block, *map(M._shut, (other[order], c[order], r.rand(60), np.full(60, 0.01), own, own % 12, np.arange(12), r.rand(12)))))
    pdf = pd.DataFrame(rows, columns=[x.split()[0] for x in M._SENT.split(", ")])
    assert M._judged(pdf, 3).equals(M._judged(pdf[::-1], 3))
    for most in (1 << 20, 1 << 40):  # beyond 31 bits by two keys
        a, b = r.randint(0, most, 500), r.randint(0, most, 500)
        a[250:], b[250:] = a[:250], b[:250]
        assert M._in_order(a, b).tolist() == np.lexsort((b, a)).tolist()


def test_final_communities_gain_nothing_by_joining():
    """Final communities: no two gain by joining."""
    r = np.random.RandomState(2)
    n, w = 60, r.randint(1, 9, 400).astype(float)
    u, v = np.sort(r.randint(0, n, (400, 2)), axis=1).T
    label, total = M.louvain(u, v, w, n), w.sum()
    k = np.bincount(u, weights=w, minlength=n) + np.bincount(v, weights=w, minlength=n)
    # between whole communities nothing is gained any more
    k_c, between = np.bincount(label, weights=k), Counter()
    for a, b, x in zip(label[u], label[v], w):
        if a != b:
            between[min(a, b), max(a, b)] += x
    assert len(k_c) < n and all(x - k_c[a] * k_c[b] / (2 * total) <= 1e-9 for (a, b), x in between.items())


def test_large_and_small_parents_give_the_same_communities(spark):
    pairs = [(f"{c}{i}", f"{c}{j}", 5.0) for c in "abcd" for i in range(8) for j in range(i)] + [("a0", "b0", 1.0), ("b1", "c1", 1.0), ("c2", "d2", 1.0)]
    rows = [("", min(u, v), max(u, v), w) for u, v, w in pairs] + [("small", "x", "y", 1.0)]
    edges = spark.createDataFrame(rows, "parent string, u string, v string, w double")
    nodes = spark.createDataFrame(sorted({(p, k) for p, u, v, _ in rows for k in (u, v)}), "parent string, key string")
    got = [sorted(tuple(x) for x in M.partition(nodes, edges, finish).collect()) for finish in (M.FINISH, 100, 0)]
    assert got[0] == got[1] == got[2]
    assert {p for _, _, p in got[0]} == {"a0", "b0", "c0", "d0", "x"}


def test_small_parents_are_split_to_the_last_part_in_one_task(spark, monkeypatch):
    name = lambda i: "n" + format(i, "05b")
    pairs = [(name(i), name(j), 4 ** (5 - (i ^ j).bit_length())) for j in range(32) for i in range(j)]
    nodes = spark.createDataFrame([(name(i),) for i in range(32)] + [("alone",)], "key string")
    written, materialize = [], M.materialize
    monkeypatch.setattr(M, "materialize", lambda df, name, *a: written.append(name) or materialize(df, name, *a))
    got = M.hierarchy(nodes, spark.createDataFrame(pairs, "u string, v string, weight bigint"), max_size=1).orderBy("id").collect()
    assert max(x.level for x in got) >= 2 and len(written) <= 6, written
    by = {x.id: x for x in got}
    assert [x.id for x in got] == list(range(len(got))) and got[0].members == ["alone"]
    for x in got:
        kids = [y for y in got if y.parent == x.id]
        assert not kids or sorted(k for y in kids for k in y.members) == x.members and {y.level for y in kids} == {x.level + 1}
        assert x.parent is None or x.parent < x.id and set(x.members) < set(by[x.parent].members)


@pytest.mark.parametrize("finish,rounds", [(0, 99), (M.FINISH, 4)])
def test_packed_moving_with_large_nodes_leaves_no_gain(spark, monkeypatch, finish, rounds):
    pairs = _planted(5) + [("hub", f"g{g}n{i:02}", 1.0) for g in range(4) for i in range(8)] + [("hub", "hub", 2.0)]
    monkeypatch.setattr(M, "BLOCK", 20)  # the hub's edges lie in several blocks
    written, materialize = [], M.materialize
    monkeypatch.setattr(M, "materialize", lambda df, name, *a: written.append(name) or materialize(df, name, *a))
    com = {x.key: x.com for x in M._move(spark.createDataFrame([("p", *x) for x in pairs] + [("q", "a", "b", 1.0)], "parent string, u string, v string, w double"), finish).collect()}
    assert written.count("moves") <= rounds and com.pop("a") == com.pop("b")
    at, near = _modularity(pairs, com), defaultdict(set)
    for u, v, _ in pairs:
        near[u].add(com[v])
        near[v].add(com[u])
    assert max(_modularity(pairs, {**com, x: c}) for x in com for c in near[x]) <= at + 1e-12


def test_only_distinct_names_are_keyed(spark):
    m = spark.createDataFrame([(x,) for x in ["İki  ad", "ıki ad", " ", None, "bir"] * 50], "name string")
    got = G.entity_keys(m)
    assert sorted(x.key for x in got.collect()) == ["bir", "iki ad", "ıki ad"]
    assert spark.read.parquet(*got.inputFiles()).count() == 4


@pytest.mark.parametrize("variant", G.VARIANTS)
def test_entity_pairs_are_the_undirected_edges_by_number(spark, variant):
    r = random.Random(7)
    forms = lambda i: r.choice([f"Ad {i}", f"  ad {i} ", f"AD {i}", f"äd {i}"])
    ment = [(r.choice([forms(i % 30), None, " "]), "t", "d", "c", i) for i in range(300)]
    rels = [(r.choice([forms(0), forms(r.randrange(40)), None, ""]), r.choice([forms(0), forms(r.randrange(40)), None]), "r", "c", r.choice([None, 1, 3]), i) for i in range(3000)]
    m = spark.createDataFrame(ment, "name string, type string, description string, chunk_id string, ord long").repartition(3)
    rel = spark.createDataFrame(rels, "source string, target string, relation string, chunk_id string, strength int, ord long").repartition(3)
    keys, pairs = G.entity_pairs(m, rel, variant)
    name = {x.id: x.key for x in keys.collect()}
    nodes = G.entity_keys(m, variant)
    assert [name[i] for i in range(len(name))] == sorted(x.key for x in nodes.collect())
    ends = G.keyed(rel.filter("source is not null and target is not null"), {"source": "src", "target": "tgt"}, variant)
    want = defaultdict(int)
    for x in ends.collect():
        if x.src in name.values() and x.tgt in name.values() and (variant == "entity" or x.src != x.tgt):
            want[min(x.src, x.tgt), max(x.src, x.tgt)] += x.strength or 0
    got = pairs.collect()
    assert len(got) == len(want) > 100 and all(x.u <= x.v for x in got)
    assert {(name[x.u], name[x.v]): x.weight for x in got} == want
    if variant == "community":
        assert {(x.u, x.v): x.weight for x in G.undirected(G.aggregate_edges(rel, nodes, lists=False)).collect()} == want


def test_small_parents_are_spread_over_tasks(spark, monkeypatch, tmp_path):
    pairs = [(f"{c}{i}", f"{c}{j}", 5) for c in "abcdefgh" for i in range(8) for j in range(i)] + [(f"{c}0", f"{d}0", 1) for c, d in zip("abcdefg", "bcdefgh")]
    nodes = spark.createDataFrame(sorted({(k,) for u, v, _ in pairs for k in (u, v)}), "key string")
    at, descended = str(tmp_path), M._descended

    def noted(pdf, max_size):
        from pyspark import TaskContext

        open(f"{at}/{TaskContext.get().partitionId()}", "w").close()
        return descended(pdf, max_size)

    monkeypatch.setattr(M, "_descended", noted)
    got = M.hierarchy(nodes, spark.createDataFrame([(min(u, v), max(u, v), w) for u, v, w in pairs], "u string, v string, weight bigint"), max_size=4, finish=100).collect()
    assert {frozenset(x.members) for x in got if x.level == 0} == {frozenset(f"{c}{i}" for i in range(8)) for c in "abcdefgh"}
    assert len(list(tmp_path.iterdir())) > 1


def test_broken_communities_are_found(spark):
    from loomgraph.plans.graph_queries import violations

    nodes = spark.createDataFrame([(k, i) for i, k in enumerate("abcdef")], "key string, id bigint")
    pairs = spark.createDataFrame([(0, 1, 2), (1, 2, 2), (0, 2, 2), (3, 4, 2), (4, 5, 2), (3, 5, 2), (2, 3, 1)], "u bigint, v bigint, weight bigint")
    good = [(0, 0, None, ["a", "b", "c"]), (1, 1, 0, ["a"]), (2, 1, 0, ["b", "c"]), (3, 0, None, ["d", "e", "f"])]
    found = lambda rows: sorted(tuple(x) for x in violations(nodes, pairs, spark.createDataFrame(rows, "id bigint, level int, parent bigint, members array<string>")).collect())
    assert found(good) == []
    assert found([*good[:2], (2, 1, 0, ["b"]), good[3]]) == [("children", "c"), ("node not in one leaf", "c")]
    twice = found([*good[:2], (2, 1, 0, ["b", "b", "c", "f"]), good[3]])
    assert [x for x in twice if x[0] != "modularity"] == [("children", "b"), ("children", "f"), ("node not in one leaf", "b"), ("node not in one leaf", "f")]
    assert found([*good[:2], (2, 2, 0, ["b", "c"]), good[3]]) == [("level", "2")]
    bad = found([(0, 0, None, ["a", "d"]), (1, 0, None, ["b", "e"]), (2, 0, None, ["c", "f"])])
    assert len(bad) == 1 and bad[0][0] == "modularity" and float(bad[0][1]) < 0
