"""Sources and sinks of the pipeline: JSON lines, JSON documents, parquet tables, PDF, uploads.

Data files are read FAILFAST with a fixed schema; checkpoints skip malformed lines.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.textops import slug
from loomgraph.operators.tables import last_wins

CHUNK = "id string, text string"
EMBEDDED = f"{CHUNK}, embedding array<float>"
EXTRACTION = "chunk_id string, entities array<struct<name:string,type:string,description:string>>, relations array<struct<source:string,target:string,relation:string,strength:int>>"
NODE = "id string, name string, type string, description string, source_chunks array<string>, community int"
EDGE = "source string, target string, description string, strength int, weight int, source_chunks array<string>"
COMMUNITY = "id int, level int, parent int, members array<string>"
REPORT = "community_id int, title string, summary string, size int, entity_keys array<string>, articles array<string>"
SUMMARY = "id string, hash string, description string"
VECTOR = "key string, vec array<double>"


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; ``strict`` fails on a malformed line, otherwise such lines are left out. Blank lines are left out."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    raw = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return raw.filter("_bad is null").drop("_bad")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks without their vectors, which are not read."""
    return read_jsonl(spark, path, CHUNK)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Embedded chunks; an empty file is an error."""
    df = read_jsonl(spark, path, EMBEDDED)
    if df.isEmpty():
        raise ValueError(f"{path} holds no chunk")
    return df


def done_ids(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """Distinct keys of a checkpoint; malformed lines are ignored, a missing file has none."""
    try:
        return read_jsonl(spark, path, f"{key} string", strict=False).select(key).filter(F.col(key).isNotNull()).distinct()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], f"{key} string")
        raise


def append(df: DataFrame, path: str, form: str = "json") -> None:
    """Finished rows added to a checkpoint, with ``_seq``, which grows from one call to the next: readers order lines by it."""
    df.withColumn("_seq", F.lit(time.time_ns())).write.mode("append").format(form).save(path)


def _last(raw: DataFrame, key: str) -> DataFrame:
    # lines without a number, as others write them, come first, in the order of their file
    at = F.struct("_seq", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"))
    return last_wins(raw.withColumn("_at", at).drop("_seq"), key, "_at").drop("_at")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports by community; a later line overrides."""
    return _last(read_jsonl(spark, path, f"{REPORT}, _seq bigint"), "community_id")


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Cached summaries by id; the last line counts, malformed lines are ignored."""
    return _last(read_jsonl(spark, path, f"{SUMMARY}, _seq bigint", strict=False), "id")


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """Extraction lines, all of them; :func:`loomgraph.operators.models.extracted_mentions` makes mentions of them."""
    return read_jsonl(spark, path, EXTRACTION)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as two tables."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What :func:`write_graph` wrote."""
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def import_node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one node-link JSON document."""
    doc = spark.read.schema(f"nodes array<struct<{_struct(NODE)}>>, edges array<struct<{_struct(EDGE)}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return doc.select(F.inline("nodes")), doc.select(F.inline("edges"))


def export_node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row ``value``: the graph as a node-link JSON document. For graphs that one document can hold."""
    n = nodes.agg(F.collect_list(F.struct(*nodes.columns)).alias("nodes"))
    e = edges.agg(F.collect_list(F.struct(*edges.columns)).alias("edges"))
    return n.crossJoin(e).select(F.to_json(F.struct(F.lit(True).alias("directed"), F.lit(False).alias("multigraph"), "nodes", "edges")).alias("value"))


def _struct(ddl: str) -> str:
    return ", ".join(f"{name}:{kind}" for name, kind in (c.strip().split(" ", 1) for c in ddl.split(", ")))


def read_communities(spark: SparkSession, path: str) -> DataFrame:
    """Communities of one JSON list."""
    return spark.read.schema(COMMUNITY).option("multiLine", True).option("mode", "FAILFAST").json(path)


def export_communities(communities: DataFrame) -> DataFrame:
    """One row ``value``: the communities as one JSON list by id, which :func:`read_communities` reads. For lists that one document can hold."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("id", "level", "parent", "members"))), lambda x: x)
    return communities.select(*[F.col(c) for c in ("id", "level", "parent", "members")]).agg(F.to_json(rows, {"ignoreNullFields": "false"}).alias("value"))


def _versions(spark: SparkSession, path: str) -> tuple[object, list[str]]:
    """The file system of a cache and its complete versions, oldest first."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return fs, []
    names = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory())
    done = lambda n: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return fs, [n for n in names if n.startswith("v-") and done(n)]


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of a vector cache; one that is missing or unreadable is empty."""
    try:
        df = spark.read.schema(VECTOR).parquet(f"{path}/{_versions(spark, path)[1][-1]}")
        df.limit(1).count()
        return df
    except Exception:  # noqa: BLE001
        return spark.createDataFrame([], VECTOR)


def save_cache(cache: DataFrame, path: str, keep: int = 2) -> None:
    """Writes a new version, which counts once it is complete, and deletes all but the ``keep`` newest. Readers always find a whole cache."""
    spark = cache.sparkSession
    cache.write.parquet(f"{path}/v-{time.time_ns():020d}")
    fs, names = _versions(spark, path)
    for n in names[:-keep]:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}"), True)


def uploaded_chunks(df: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """(``id``, ``text``) of uploaded JSON documents: a list of texts, of objects with a text, or an object whose ``chunks`` is one.

    Objects without text are left out; a missing id is the position. Ids are prefixed with the file's slug.
    """
    c = F.col(content)
    body = F.when(F.get_json_object(c, "$.chunks").isNotNull(), F.get_json_object(c, "$.chunks")).otherwise(c)
    stem = F.regexp_replace(F.regexp_replace(F.col(name), r"^.*/", ""), r"\.[^.]*$", "")
    each = df.select(slug(stem).alias("_s"), F.posexplode(F.from_json(body, "array<string>")).alias("pos", "item"))
    obj = F.col("item").startswith("{")
    text = F.when(obj, F.get_json_object("item", "$.text")).otherwise(F.col("item"))
    key = F.coalesce(F.when(obj, F.get_json_object("item", "$.id")), F.col("pos").cast("string"))
    return each.select(F.concat("_s", F.lit("__"), key).alias("id"), text.alias("text")).filter(F.col("text").isNotNull() & ((F.col("text") != "") | ~obj))


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """(``path``, ``text``): pages with text in order, a line break after each. Needs a PDF parser (pdfplumber or pypdf) on the workers."""

    @F.pandas_udf("string")
    def pages(content: pd.Series) -> pd.Series:
        import io

        try:
            import pdfplumber

            opened: Callable = lambda b: [p.extract_text() for p in pdfplumber.open(io.BytesIO(b)).pages]
        except ImportError:
            try:
                import pypdf
            except ImportError as e:
                raise RuntimeError("reading PDF needs pdfplumber or pypdf") from e
            opened = lambda b: [p.extract_text() for p in pypdf.PdfReader(io.BytesIO(b)).pages]
        return content.map(lambda b: "".join(f"{t}\n" for t in opened(b) if t))

    return spark.read.format("binaryFile").load(path).select("path", pages("content").alias("text"))


@dataclass
class Settings:
    """Parameters with their defaults; :meth:`from_env` reads upper-case variables of the same names."""

    embed_model: str = "gemini-embedding-001"
    embed_output_dim: int = 768
    embed_batch_size: int = 10
    embed_rpm_limit: int = 100
    embed_tpm_limit: int = 30_000
    embed_rpd_limit: int = 1_000
    embed_checkpoint_path: str = "embeddings_checkpoint.jsonl"
    pdf_path: str = ""
    max_chunk_chars: int = 1_500
    min_chunk_chars: int = 10
    gleaning_rounds: int = 1
    max_descriptions: int = 20
    max_cluster_size: int = 15
    report_max_items: int = 40
    search_top_k: int = 5
    max_entities: int = 10
    max_relations: int = 10
    top_communities: int = 6
    rrf_k: int = 60
    trust_legacy_index: bool = False

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        got = {}
        for f in fields(cls):
            v = env.get(f.name.upper())
            if v is not None:
                kind = type(f.default)
                got[f.name] = v == "1" if kind is bool else kind(v)
        return cls(**got)


def import_legacy_index(vectors: DataFrame, keys: DataFrame, dim: int, same_time: bool, trust: bool = False) -> DataFrame | None:
    """``vectors`` (``key``, ``vec``) if they may be used: the same keys as ``keys``, one each, of the right width, and as old as the graph unless trusted; else None."""
    if not (same_time or trust):
        return None
    bad = vectors.filter((F.size("vec") != dim) | F.col("vec").isNull()).limit(1).count()
    diff = vectors.select("key").exceptAll(keys.select("key")).unionByName(keys.select("key").exceptAll(vectors.select("key"))).limit(1).count()
    return None if bad or diff else vectors
