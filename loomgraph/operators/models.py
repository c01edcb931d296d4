"""Model calls as steps of a plan: rows go to a provider in Arrow batches and come back as rows.

A provider is given by a function without arguments that makes it in the worker. Every step says what a failing call does to
its row. ``tasks`` bounds how many tasks call at the same time, so that their shares of a quota add up to it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from loomgraph.control import EMBED, MODEL, Budget, Caller, QuotaSpent, shared
from loomgraph.functions.textops import token_estimate
from loomgraph.operators.tables import summaries_due
from loomgraph.providers import Embedder, Generator, extract_with_gleaning

# What the search tool says when it finds nothing.
NO_ARTICLE, NO_TOPIC = "Heç bir uyğun maddə tapılmadı.", "Heç bir uyğun mövzu tapılmadı."
EMBED_BATCH = 10


def step(df: DataFrame, one: Callable[[dict], dict | None], schema: str, tasks: int | None = None) -> DataFrame:
    """``one(row)`` for every row of ``df``; rows for which it gives None are left out. Empty gives empty."""
    fields = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for r in map(one, b.to_pylist()) if r is not None]
            yield from pa.Table.from_pylist(rows, fields).to_batches()

    return (df if tasks is None else df.repartition(tasks)).mapInArrow(run, schema)


def _or(call: Callable[[], dict], otherwise: dict | None) -> dict | None:
    try:
        return Caller(pauses=MODEL)(lambda _: call())
    except Exception:  # noqa: BLE001 any error of a service
        return otherwise


def name_key(s: str) -> str:
    """The key of a name as :func:`loomgraph.functions.textops.name_key_az` has it."""
    return " ".join(unicodedata.normalize("NFC", s).replace("İ", "i").replace("I", "ı").lower().split())


EXTRACTION = "chunk_id string, entities array<struct<name:string,type:string,description:string>>, relations array<struct<source:string,target:string,relation:string,strength:int>>"


def extractions(chunks: DataFrame, make: Callable[[], Generator], rounds: int = 1, tasks: int | None = None) -> DataFrame:
    """(``chunk_id``, ``entities``, ``relations``) per chunk (``id``, ``text``): extraction and up to ``rounds`` gleanings. A failed chunk is left out."""
    return step(chunks.select("id", "text"), lambda r: _or(lambda: {"chunk_id": r["id"], **extract_with_gleaning(make(), r["id"], r["text"], name_key, rounds)}, None), EXTRACTION, tasks)


def extracted_mentions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entity and relation mentions of extraction rows, with ``ord``, their place in the chunk's list. Null lists have none."""
    e = rows.select("chunk_id", F.posexplode("entities").alias("ord", "e")).select("chunk_id", "ord", "e.name", "e.type", "e.description")
    r = rows.select("chunk_id", F.posexplode("relations").alias("ord", "r")).select("chunk_id", "ord", "r.source", "r.target", "r.relation", "r.strength")
    return e, r


def embedded(df: DataFrame, text: str, out: str, make: Callable[[], Embedder], batch: int = EMBED_BATCH, keys: tuple[str, ...] = ("",), budgets: tuple[Budget, ...] = (), tasks: int | None = None) -> DataFrame:
    """``df`` with the vector of ``text``: texts go in batches, vectors come back by place. A batch that fails is left out, so a later run finds its rows still to do.

    When all keys are used up the step ends with what it has. ``budgets`` are those of a service for one key; with ``tasks`` each task has its share.
    """
    schema = StructType([*df.schema.fields, StructField(out, ArrayType(DoubleType()))])
    mine = shared(budgets, tasks or 1)
    marked = df.withColumn("_tokens", token_estimate(F.coalesce(text, F.lit(""))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caller, service = Caller(keys, mine, EMBED), make()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                texts = part.column(text).to_pylist()
                try:
                    vectors = caller(lambda _, texts=texts: service.embed(texts), sum(part.column("_tokens").to_pylist()))
                except QuotaSpent:
                    return
                except Exception:  # noqa: BLE001 any error of a service
                    continue
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(vectors, pa.list_(pa.float64()))], [*part.schema.names[:-1], out])

    return (marked if tasks is None else marked.repartition(tasks)).mapInArrow(run, schema)


def summaries(items: DataFrame, cache: DataFrame, make: Callable[[], Generator], most: int = 20) -> DataFrame:
    """New cache rows (``id``, ``hash``, ``description``) of the items whose summary is due (:func:`loomgraph.operators.tables.summaries_due`). A failed call gives none."""
    return step(summaries_due(items, cache, most), lambda r: _or(lambda: {"id": r["id"], "hash": r["hash"], "description": make().summarise(r["subject"], r["descriptions"])}, None), "id string, hash string, description string")


def summarised(items: DataFrame, cache: DataFrame, most: int = 20) -> DataFrame:
    """``items`` (``id``, ``subject``, ``description``) with the cached summary of the same hash in place of the description; without one it stays as it is."""
    now = summaries_due(items, cache.limit(0), most).select("id", "hash")
    found = now.join(cache.select("id", "hash", F.col("description").alias("_d")), ["id", "hash"]).select("id", "_d")
    return items.join(found, "id", "left").withColumn("description", F.coalesce("_d", "description")).drop("_d")


def community_reports(inputs: DataFrame, make: Callable[[], Generator], by: str = "community") -> DataFrame:
    """(``by``, ``title``, ``summary``) from (``by``, ``entities``, ``relations``). A failed report is left out."""
    kind = dict(inputs.dtypes)[by]
    return step(inputs.select(by, "entities", "relations"), lambda r: _or(lambda: dict(zip((by, "title", "summary"), (r[by], *make().report(r["entities"], r["relations"])))), None), f"{by} {kind}, title string, summary string")


def keywords(queries: DataFrame, make: Callable[[], Generator]) -> DataFrame:
    """(``query_id``, ``local``, ``global``) keyword lists per query; both empty where the call fails."""
    kind = dict(queries.dtypes)["query_id"]
    none: tuple[list, list] = ([], [])

    def one(r: dict) -> dict:
        got = _or(lambda: {"k": make().keywords(r["query_text"])}, {"k": none})
        return {"query_id": r["query_id"], "local": got["k"][0], "global": got["k"][1]}

    return step(queries.select("query_id", "query_text"), one, f"query_id {kind}, local array<string>, global array<string>")


def seeded(queries: DataFrame, make: Callable[[], Generator], make_embedder: Callable[[], Embedder]) -> DataFrame:
    """``queries`` with ``local_vec`` and ``global_vec``: the vectors of the keywords joined by blanks; of a list that is empty, the query's own."""
    words = keywords(queries, make)
    out = queries.join(words, "query_id", "left")
    for side in ("local", "global"):
        text = F.array_join(side, " ")
        out = embedded(out.withColumn("_text", text), "_text", f"{side}_vec", make_embedder).withColumn(f"{side}_vec", F.when(F.col("_text") != "", F.col(f"{side}_vec")))
        out = out.withColumn(f"{side}_vec", F.coalesce(f"{side}_vec", "query_vec")).drop("_text")
    return out.drop("local", "global")


def routed(queries: DataFrame, make: Callable[[], Generator]) -> DataFrame:
    """(``query_id``, ``mode``) per query: 'local' or 'global'; 'local' where the call fails or says anything else."""

    def one(r: dict) -> dict:
        mode = _or(lambda: {"m": make().route(r["query_text"])}, {"m": "local"})["m"]
        return {"query_id": r["query_id"], "mode": mode if mode in ("local", "global") else "local"}

    return step(queries.select("query_id", "query_text"), one, f"query_id {dict(queries.dtypes)['query_id']}, mode string")


def tool_output(routes: DataFrame, local: DataFrame, over_all: DataFrame) -> DataFrame:
    """(``query_id``, ``mode``, ``context``): the search that the route names, from both searches' contexts (``query_id``, ``context``); a fixed line where it found nothing."""
    a, b = local.select("query_id", F.col("context").alias("_l")), over_all.select("query_id", F.col("context").alias("_g"))
    both = routes.join(a, "query_id", "left").join(b, "query_id", "left")
    text = F.when(F.col("mode") == "global", F.coalesce(F.nullif("_g", F.lit("")), F.lit(NO_TOPIC))).otherwise(F.coalesce(F.nullif("_l", F.lit("")), F.lit(NO_ARTICLE)))
    return both.select("query_id", "mode", text.alias("context"))


def asked(questions: DataFrame, make: Callable[[], Generator]) -> DataFrame:
    """(``id``, ``answer``, ``tool_queries``, ``contexts``, ``error``) per question (``id``, ``question``, ``context``): one search and one answer. A failed question has its error and no answer."""

    def one(r: dict) -> dict:
        base = {"id": r["id"], "answer": None, "tool_queries": [r["question"]], "contexts": [r["context"]], "error": None}
        try:
            return base | {"answer": Caller()(lambda _: make().answer(r["question"], r["context"]))}
        except Exception as e:  # noqa: BLE001
            return base | {"tool_queries": [], "contexts": [], "error": str(e)}

    return step(questions.select("id", "question", "context"), one, "id string, answer string, tool_queries array<string>, contexts array<string>, error string")


def tool_contexts(messages: DataFrame, tool: str = "search_constitution") -> DataFrame:
    """``messages`` (``id``, ``messages`` array of structs with ``role``, ``name``, ``text``) with ``contexts``: the texts of that tool's answers, in order."""
    mine = F.filter("messages", lambda m: (m["role"] == "tool") & (m["name"] == tool))
    return messages.select("id", F.transform(F.coalesce(mine, F.array().cast(messages.schema["messages"].dataType)), lambda m: m["text"]).alias("contexts"))


def judged(items: DataFrame, make: Callable[[], Generator], most: int = 60_000) -> DataFrame:
    """(``id``, ``chunks_used_correctly``, ``answers_question``, ``overall``, ``coverage``) of items (``id``, ``question``, ``contexts``, ``answer``, ``elements``).

    ``coverage`` is the share of expected elements that the verdicts cover, null without elements or verdicts. A failed call leaves all
    scores null. The model sees at most ``most`` characters of the contexts, a limit of the judge.
    """

    def one(r: dict) -> dict:
        elements = r["elements"] or []
        context = "\n\n=====\n\n".join(r["contexts"] or [])[:most]
        got = _or(lambda: make().judge(r["question"], context, r["answer"] or "", elements), None)
        if got is None:
            return {"id": r["id"]}
        said = got["verdicts"]
        share = min(sum(map(bool, said)), len(elements)) / len(elements) if elements and said else None
        return {"id": r["id"], "chunks_used_correctly": float(got["chunks_used_correctly"]), "answers_question": float(got["answers_question"]), "overall": float(got["overall"]), "coverage": share}

    return step(items.select("id", "question", "contexts", "answer", "elements"), one, "id string, chunks_used_correctly double, answers_question double, overall double, coverage double")


def experiment(items: DataFrame, answers: DataFrame, make: Callable[[], Generator], judge: bool = True, first: int | None = None) -> DataFrame:
    """One row per item: (``id``, ``question``, ``answer``, ``contexts``, ``error``) and the judge's scores; ``first`` items in order of their id if given (a feature of trial runs).

    Items that failed keep their error and have no scores.
    """
    chosen = items if first is None else items.orderBy("id").limit(first)
    run = chosen.join(answers.drop("question"), "id", "left")
    if not judge:
        return run.select("id", "question", "answer", "contexts", "error")
    return run.select("id", "question", "answer", "contexts", "error").join(judged(run.filter("error is null"), make), "id", "left")


def failures(runs: DataFrame) -> DataFrame:
    """One row ``n_items``, ``n_failed``."""
    return runs.agg(F.count(F.lit(1)).alias("n_items"), F.count("error").alias("n_failed"))


def export_json(runs: DataFrame) -> DataFrame:
    """One row ``value`` per item: its JSON object, fields without a value left out."""
    return runs.select(F.to_json(F.struct(*sorted(runs.columns))).alias("value"))
