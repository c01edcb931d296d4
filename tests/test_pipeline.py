"""Chunking, sources, streaming, providers and the contract of the entry module."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph import control as K
from loomgraph import providers as P
from loomgraph.operators import chunking as C
from loomgraph.operators import graph as G
from loomgraph.operators import models as D
from loomgraph.operators import retrieval as R
from loomgraph.operators.search import vector_topk
from loomgraph.sources import io
from loomgraph.streaming import ingest


def test_long_article_is_packed(spark):
    body = "Başlıq\n" + "\n".join(f"{n}. " + "Söz " * 60 + "son." for n in ("I", "II", "III")) + "\nIV. " + " ".join("Cümlə " * 20 + f"{i}." for i in range(20))
    rows = C.chunk_articles(spark.createDataFrame([(1, "giriş Maddə 7. " + body), (2, "Maddə 3- qısa"), (3, None), (4, "")], "doc_id int, text string"), limit=500).orderBy("doc_id", "ord").collect()
    ids = [(r.doc_id, r.id) for r in rows]
    assert ids[0] == (1, "preambula") and ids[1] == (1, "madde_7_p1") and ids[-1] == (2, "madde_3")
    parts = [r.text for r in rows if r.id.startswith("madde_7")]
    assert all(p.startswith("Maddə 7.\n") and len(p) <= 501 for p in parts) and "Başlıq" not in "".join(parts)
    assert sum(p.count("son.") for p in parts) == 3


def test_jsonl_strict_and_lenient(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"id":"a","text":"x","embedding":[1.0]}\n{"id":"b","te\n{"id":"a","text":"y","embedding":[2.0]}\n')
    assert {r.id for r in io.done_ids(spark, str(p)).collect()} == {"a"}
    with pytest.raises(Exception):  # noqa: B017
        io.read_chunks(spark, str(p)).collect()
    assert io.done_ids(spark, str(tmp_path / "none.jsonl")).count() == 0
    (tmp_path / "e.jsonl").write_text("")
    with pytest.raises(ValueError):
        io.read_index(spark, str(tmp_path / "e.jsonl"))


def test_uploads(spark):
    docs = [("My File.json", json.dumps(["a", {"text": "b", "id": "k"}, {"text": ""}, {"id": 1}])), ("ü.json", json.dumps({"chunks": [{"text": "c"}]}))]
    got = {(r.id, r.text) for r in io.uploaded_chunks(spark.createDataFrame(docs, "name string, content string")).collect()}
    assert got == {("my_file__0", "a"), ("my_file__k", "b"), ("doc__0", "c")}


def test_cache_swap(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    assert io.load_cache(spark, path).count() == 0
    io.save_cache(spark.createDataFrame([("a", [1.0])], io.VECTOR), path)
    io.save_cache(io.load_cache(spark, path).unionByName(spark.createDataFrame([("b", [2.0])], io.VECTOR)), path)
    assert {r.key for r in io.load_cache(spark, path).collect()} == {"a", "b"}
    v = io.load_cache(spark, path)
    assert io.import_legacy_index(v, v.select("key"), 1, True) is not None
    assert io.import_legacy_index(v, v.select("key"), 2, True) is None and io.import_legacy_index(v, v.select("key"), 1, False) is None


def test_stream_adds_only_new_chunks(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    run = lambda: ingest.ingest_chunks(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    (src / "1.json").write_text('{"doc_id":"d","text":"Maddə 1. bir Maddə 2. iki"}\n')
    run()
    (src / "2.json").write_text('{"doc_id":"d","text":"Maddə 2. iki Maddə 3. üç"}\n')
    run()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["d__madde_1", "d__madde_2", "d__madde_3"]


def test_variants_of_the_graph(spark):
    m = spark.createDataFrame([("c1", 1, "İclas", "A", "d1"), ("c2", 2, "iclas", "B", "d2"), ("c2", 3, "iclas", "B", "d1"), ("c1", 4, None, "A", "x"), ("c1", 5, " ", "A", "x")], "chunk_id string, ord long, name string, type string, description string")
    n = {r.key: r for r in G.resolve_entities(m).collect()}
    assert set(n) == {"iclas"} and (n["iclas"].name, n["iclas"].type, n["iclas"].description, n["iclas"].source_chunks) == ("iclas", "B", "d1 | d2", ["c1", "c2"])
    assert G.resolve_entities(m, "entity").count() == 2
    r = spark.createDataFrame([("c1", 1, "İclas", "iclas", "özü", 3), ("c1", 2, "iclas", "yad", "x", 3)], "chunk_id string, ord long, source string, target string, relation string, strength int")
    assert G.aggregate_edges(r, G.resolve_entities(m)).count() == 0
    own = m.filter("ord > 1")
    assert [x.src for x in G.aggregate_edges(r.filter("source = 'iclas'").unionByName(spark.createDataFrame([("c1", 3, "iclas", "iclas", "özü", 3)], r.schema)), G.resolve_entities(own, "entity"), "entity").collect()] == ["iclas"]
    with pytest.raises(ValueError):
        G.key_of("name", "other")


def test_vector_topk_in_blocks(spark, monkeypatch):
    from loomgraph.operators import search

    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    rows = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(20)] + [(99, None)], "id long, vec array<double>").repartition(4)
    q = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(5)], "query_id long, query_vec array<double>")
    got = {(r.query_id, r.rank): r.id for r in vector_topk(rows, q, 3).collect()}
    assert all(got[(k, j + 1)] == 2 + 3 * j for k in range(5) for j in range(3))


def test_unknown_mode_finds_nothing(spark):
    q = spark.createDataFrame([("q", [1.0])], "query_id string, query_vec array<double>")
    n = spark.createDataFrame([("a", "A", "T", "d", ["c"], [1.0])], "key string, name string, type string, description string, source_chunks array<string>, vec array<double>")
    e = spark.createDataFrame([], "src string, tgt string, description string, strength int, source_chunks array<string>, vec array<double>")
    c = spark.createDataFrame([("c", 1, "t", [1.0])], "id string, ord long, text string, vec array<double>")
    f = R.dual_search(q, n, e, c, "other")
    assert f.chunks.count() == f.entities.count() == f.relations.count() == 0
    assert R.dual_search(q, n, e, c, "hybrid").chunks.count() == 1


def test_map_reduce_failures(spark):
    class Broken(P.OfflineGenerator):
        def map(self, query, reports):
            if any(r["title"] == "bad" for r in reports):
                raise RuntimeError("x")
            return True, " part "

        def reduce(self, query, partials):
            raise RuntimeError("y")

    q = spark.createDataFrame([("q", "sual", [1.0])], "query_id string, query_text string, query_vec array<double>")
    reps = spark.createDataFrame([(i, "bad" if i == 0 else f"t{i}", "s", [f"Maddə {i}"], [float(9 - i)]) for i in range(7)], "community int, title string, summary string, articles array<string>, vec array<double>")
    r = R.map_reduce(q, reps, Broken()).first()
    assert (r.answer, r.articles_used, len(r.communities_used)) == ("part", ["Maddə 3", "Maddə 4", "Maddə 5"], 6)


def test_budgets_keys_and_pauses():
    now, slept = [0.0], []
    sleep = lambda s: (slept.append(s), now.__setitem__(0, now[0] + s))
    budgets = [K.Budget("calls", 2, 60), K.Budget("tokens", 100, 60), K.Budget("calls", 3, 86_400, final=True)]
    call = K.Caller(["a", "b"], budgets, clock=lambda: now[0], sleep=sleep)
    assert [call(lambda k: k, 10) for _ in range(3)] == ["a"] * 3 and slept == [60.0]
    assert call(lambda k: k, 10) == "b"  # the day of the first key is over
    with pytest.raises(ValueError):
        call(lambda k: k, 101)
    assert [call(lambda k: k, 10) for _ in range(2)] == ["b"] * 2
    with pytest.raises(K.QuotaSpent):
        call(lambda k: k, 10)
    with pytest.raises(ValueError):
        K.Caller([])
    calls, waits = [], []

    def flaky(_):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("429 retryDelay: '7s'")
        return "ok"

    assert K.Caller(sleep=waits.append)(flaky) == "ok" and waits == [10.0, 10.0]
    assert K.QUESTION.after(RuntimeError("Timeout"), 1) == 20.0 and K.QUESTION.after(RuntimeError("429"), 2) == 60.0
    assert K.MODEL.after(RuntimeError("Timeout"), 0) is None and K.EMBED.after(RuntimeError("429"), 4) == 30.0 and K.EMBED.after(RuntimeError("429"), 5) is None
    used = []

    def daily(k):
        used.append(k)
        if k == "a":
            raise RuntimeError("429 quota per day")
        return k

    assert K.Caller(["a", "b"])(daily) == "b" and used == ["a", "b"]
    assert K.shared(K.EMBEDDING, 4)[1].limit == 7500


def test_merge_and_settings():
    merged, n = P.merge_extraction({"entities": [{"name": "A"}, {"name": "a"}]}, {"entities": [{"name": "a "}, {"name": "b"}]}, lambda s: s.strip().lower())
    assert n == 1 and [e["name"] for e in merged["entities"]] == ["A", "a", "b"]
    assert io.Settings.from_env({"SEARCH_TOP_K": "9", "TRUST_LEGACY_INDEX": "1"}).search_top_k == 9


def _failing():
    # a local class travels to the workers by value
    class Failing(P.OfflineGenerator):
        def extract(self, chunk_id, text):
            if chunk_id == "bad":
                raise RuntimeError("x")
            return super().extract(chunk_id, text)

        def summarise(self, subject, descriptions):
            if subject == "bad":
                raise RuntimeError("x")
            return super().summarise(subject, descriptions)

        def route(self, query):
            raise RuntimeError("x")

        def keywords(self, query):
            if query == "bad":
                raise RuntimeError("x")
            return super().keywords(query)

        def answer(self, question, context):
            if question == "bad":
                raise RuntimeError("no answer")
            return super().answer(question, context)

        def judge(self, *a):
            if a[0] == "odd":
                raise RuntimeError("x")
            return super().judge(*a)

    return Failing


def test_failing_model_calls(spark):
    Failing = _failing()
    got = D.extractions(spark.createDataFrame([("bad", "Uca Divan"), ("c", "Uca Divan və Palata, sonra Uca Divan. Heyət"), ("e", None)], "id string, text string"), Failing)
    e, r = D.extracted_mentions(got)
    assert [(x.chunk_id, x.ord, x.name) for x in e.orderBy("ord").collect()] == [("c", 0, "Uca Divan"), ("c", 1, "Palata"), ("c", 2, "Heyət")]
    assert [(x.source, x.target) for x in r.orderBy("ord").collect()] == [("Uca Divan", "Palata"), ("Palata", "Heyət")]
    items = spark.createDataFrame([("1", "s", "a | b"), ("2", "bad", "a | c"), ("3", "t", "a"), ("4", "u", "x | y | z")], "id string, subject string, description string")
    first = D.summaries(items, spark.createDataFrame([], "id string, hash string, description string"), Failing)
    assert {x.id: x.description for x in first.collect()} == {"1": "a (+1)", "4": "x (+2)"}
    again = D.summaries(items, first, Failing)
    assert again.count() == 0
    assert {x.id: x.description for x in D.summarised(items, first).collect()} == {"1": "a (+1)", "2": "a | c", "3": "a", "4": "x (+2)"}
    q = spark.createDataFrame([("q", "bad", [1.0, 0.0]), ("r", "Divan", [1.0, 0.0])], "query_id string, query_text string, query_vec array<double>")
    assert {x.mode for x in D.routed(q, Failing).collect()} == {"local"}
    v = {x.query_id: x for x in D.seeded(q, Failing, lambda: P.OfflineEmbedder(2)).collect()}
    assert v["q"].local_vec == v["q"].global_vec == v["r"].global_vec == [1.0, 0.0] != v["r"].local_vec
    ctx = D.tool_output(spark.createDataFrame([("a", "local"), ("b", "global"), ("c", "global")], "query_id string, mode string"), spark.createDataFrame([("a", "")], "query_id string, context string"), spark.createDataFrame([("b", "x")], "query_id string, context string"))
    assert {x.query_id: x.context for x in ctx.collect()} == {"a": D.NO_ARTICLE, "b": "x", "c": D.NO_TOPIC}
    ask = D.asked(spark.createDataFrame([("1", "bad", "c"), ("2", "ok", "first\nsecond"), ("3", "odd", "z")], "id string, question string, context string"), Failing)
    runs = D.experiment(spark.createDataFrame([("1", "bad", ["e"]), ("2", "ok", ["first", "none"]), ("3", "odd", [])], "id string, question string, elements array<string>"), ask, Failing)
    by = {x.id: x for x in runs.collect()}
    assert by["1"].error == "no answer" and by["1"].overall is None and (by["2"].answer, by["2"].overall, by["2"].coverage) == ("first", 5.0, 0.5) and by["3"].overall is None
    assert D.failures(runs).first() == (3, 1)
    assert '"error":"no answer"' in D.export_json(runs.filter("id = '1'")).first().value


def test_embedding_batches_and_quota(spark):
    class Half(P.OfflineEmbedder):
        def embed(self, texts):
            if "bad" in texts:
                raise RuntimeError("x")
            return super().embed(texts)

    df = spark.createDataFrame([(i, "bad" if i == 5 else f"söz {i}") for i in range(25)], "id long, text string").coalesce(1)
    got = D.embedded(df, "text", "vec", lambda: Half(4), batch=4)
    assert sorted(x.id for x in got.collect()) == [i for i in range(25) if i not in (4, 5, 6, 7)]
    few = D.embedded(df.filter("id <> 5"), "text", "vec", lambda: Half(4), batch=4, keys=("a", "b"), budgets=(K.Budget("calls", 2, 86_400, final=True),), tasks=1)
    assert few.count() == 16
    assert all(abs(sum(a * a for a in x.vec) - 1) < 1e-12 for x in got.collect())


def test_last_append_wins(spark, tmp_path):
    at = str(tmp_path / "s")
    for n in range(4):
        io.append(spark.createDataFrame([("a", "h", str(n)), (f"only{n}", "h", "x")], io.SUMMARY).repartition(3), at)
    got = {r.id: r.description for r in io.read_summaries(spark, at).collect()}
    assert got == {"a": "3", **{f"only{n}": "x" for n in range(4)}}
    (tmp_path / "f.jsonl").write_text('{"community_id":1,"title":"old"}\n\n{"community_id":2,"title":"b"}\n{"community_id":1,"title":"new"}\n')
    assert {r.community_id: r.title for r in io.read_reports(spark, str(tmp_path / "f.jsonl")).collect()} == {1: "new", 2: "b"}


def test_caches_and_communities(spark, tmp_path):
    from loomgraph.session import Lazy, drop_written, materialize

    at = str(tmp_path / "cache")
    assert io.load_cache(spark, at).count() == 0
    for n in range(4):
        io.save_cache(spark.createDataFrame([(str(n), [1.0])], io.VECTOR), at)
    assert [r.key for r in io.load_cache(spark, at).collect()] == ["3"] and len(list((tmp_path / "cache").iterdir())) == 2
    (tmp_path / "cache" / "v-99999999999999999999").mkdir()  # begun, never finished
    assert [r.key for r in io.load_cache(spark, at).collect()] == ["3"]
    c = spark.createDataFrame([(2, 1, 1, ["a"]), (1, 0, None, None)], io.COMMUNITY)
    (tmp_path / "c.json").write_text(io.export_communities(c).first().value)
    assert sorted(map(tuple, io.read_communities(spark, str(tmp_path / "c.json")).collect())) == [(1, 0, None, None), (2, 1, 1, ["a"])]
    ext = '{"chunk_id":"c","entities":[{"name":"A","type":"T","description":"d"}],"relations":[]}\n'
    (tmp_path / "e.jsonl").write_text(ext)
    e, r = D.extracted_mentions(io.read_extractions(spark, str(tmp_path / "e.jsonl")))
    assert [tuple(x) for x in e.collect()] == [("c", 0, "A", "T", "d")] and r.count() == 0
    materialize(c, "x").count()
    assert drop_written(spark) >= 1 and drop_written(spark) == 0
    made = []
    lazy = Lazy(lambda: made.append(1) or len(made))
    assert (lazy.get(), lazy.get(), lazy.reload(), lazy.get()) == (1, 1, 2, 2)


def test_tool_messages(spark):
    m = spark.createDataFrame([("1", [("user", None, "q"), ("tool", "search_constitution", "a"), ("tool", "other", "b"), ("tool", "search_constitution", "c")]), ("2", None)], "id string, messages array<struct<role:string,name:string,text:string>>")
    assert {x.id: x.contexts for x in D.tool_contexts(m).collect()} == {"1": ["a", "c"], "2": []}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
    assert F is not None
