"""Readers and writers: JSON lines with row numbers, typed checks, CSV, marked HTML, registries and manifests."""

from __future__ import annotations

import html as _html
import json
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from quern.sources.batches import small_batches


def numbered(df: DataFrame, name: str = "row_number") -> DataFrame:
    """Adds row numbers from 1 in the input's order, by counts of partitions rather than one task for all rows."""
    place = F.monotonically_increasing_id()
    marked = df.withColumn("_part", F.shiftright(place, 33)).withColumn("_at", place.bitwiseAND((1 << 33) - 1))
    counts = marked.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = counts.select(F.col("_part").alias("_before"), "_n").join(F.broadcast(counts.select("_part")), F.col("_before") < F.col("_part"), "right").groupBy("_part").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_ahead"))
    return marked.join(F.broadcast(ahead), "_part").withColumn(name, F.col("_ahead") + F.col("_at") + 1).drop("_part", "_at", "_ahead")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(row_number, record_number, value): the objects of a file's non-blank lines. `row_number` is the file's line, which names a line that is no object and
    stops the job; `record_number` counts without blank lines, as preprocessed records are numbered."""
    lines = numbered(numbered(spark.read.text(path)).where(F.trim("value") != ""), "record_number")
    kept = F.when(F.json_object_keys("value").isNotNull(), F.col("value")).otherwise(F.raise_error(F.concat(F.lit(f"{path}: row "), F.col("row_number").cast("string"), F.lit(" must be an object"))).cast("string"))
    return lines.select("row_number", "record_number", kept.alias("value"))


#: What inference rows may have besides their own fields, and text fields of a protocol that default to blank.
INFERENCE_FIELDS = ("query_id", "text", "language", "source_group_id", "split", "jurisdiction", "as_of_date", "query_date", "target_population")
PROTOCOL_TEXTS = (
    "source_id", "title", "source_url", "jurisdiction", "target_population", "version", "effective_date", "expiry_date", "status_detail", "source_tier", "content_review_status", "license_status",
    "redistribution_status", "file_sha256", "parent_source_id", "parent_file_sha256", "source_locator", "derivation_method", "derivation_rule_reason",
)


def _get(field: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.parse_json("value"), f"$.{field}", kind)


def _trimmed(field: str, default: str | None = "") -> Column:
    """A text without white space around it; the default where it is missing, or an error if there is none."""
    text = F.regexp_replace(_get(field), "(?U)^\\s+|\\s+$", "")
    return F.coalesce(text, F.raise_error(F.lit(f"{field} is missing")).cast("string") if default is None else F.lit(default)).alias(field)


def _texts(field: str) -> Column:
    return F.coalesce(_get(field, "array<string>"), F.array().cast("array<string>")).alias(field)


def typed_protocols(rows: DataFrame) -> DataFrame:
    """Protocol rows from JSON objects in `value`."""
    level = F.coalesce(_get("authority_level", "int"), F.lit(0)).alias("authority_level")
    return rows.select(*[_trimmed(c, None) for c in ("evidence_id", "text", "source_org")], *[_trimmed(c) for c in PROTOCOL_TEXTS], level, _texts("hazard_types"), _texts("applicability"), F.coalesce(_get("status"), F.lit("current")).alias("status"))


def typed_queries(rows: DataFrame) -> DataFrame:
    """Annotated queries from JSON objects in `value`; a risk level is a number or one of L0 to L3, other fields go to `metadata` as JSON."""
    level = F.upper(F.trim(_get("risk_level")))
    risk = F.when(level.isin("L0", "L1", "L2", "L3"), F.substring(level, 2, 1)).otherwise(level).cast("int").alias("risk_level")
    lists = ("gold_evidence_ids", "required_actions", "prohibited_actions")
    known = ("query_id", "text", "disaster_type", "query_type", "risk_level", "language", "should_fallback", *lists, "source_group_id", "split")
    extra = F.to_json(F.map_filter(F.expr("cast(parse_json(value) as map<string, variant>)"), lambda k, _: ~k.isin(*known)))
    return rows.select(*[_trimmed(c, None) for c in ("query_id", "text", "disaster_type", "query_type")], risk, _trimmed("language", "unknown"), F.coalesce(_get("should_fallback", "boolean"), F.lit(False)).alias("should_fallback"), *map(_texts, lists), _trimmed("source_group_id"), _trimmed("split"), extra.alias("metadata"))


def typed_inference_queries(rows: DataFrame, gold: tuple[str, ...] = ("disaster_type", "query_type", "risk_level", "should_fallback", "gold_evidence_ids", "required_actions", "prohibited_actions")) -> DataFrame:
    """Queries as inference may see them; a row with an annotated field, or one that is not allowed, stops the job and names it."""
    keys = F.json_object_keys("value")
    listed = lambda found: F.array_join(F.array_sort(found), ", ")
    leaked, unknown = F.filter(keys, lambda k: k.isin(*gold)), F.filter(keys, lambda k: ~k.isin(*INFERENCE_FIELDS))
    fault = F.when(F.size(leaked) > 0, F.concat(F.lit("inference query contains gold-only fields: "), listed(leaked))).when(F.size(unknown) > 0, F.concat(F.lit("inference query contains fields that are not allowed: "), listed(unknown)))
    sure = rows.withColumn("value", F.when(fault.isNull(), F.col("value")).otherwise(F.raise_error(fault).cast("string")))
    return sure.select(_trimmed("query_id", None), _trimmed("text", None), _trimmed("language", "unknown"), *[_trimmed(c) for c in ("source_group_id", "split")], *[_get(c).alias(c) for c in INFERENCE_FIELDS[5:]])


def configured_data(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame]:
    """Protocols and queries of a configuration; its role says whether queries are annotated or for inference."""
    data = config.get("data", {})
    loaders = {"annotated": typed_queries, "inference": typed_inference_queries}
    role = str(data.get("query_role", "annotated"))
    if role not in loaders:
        raise ValueError("data.query_role must be 'annotated' or 'inference'")
    read = lambda name: read_jsonl(spark, str(project_path(config, data[name])))
    return typed_protocols(read("protocols")), loaders[role](read("queries"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of a folder's text and Markdown files, each as a whole."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike("\\.(txt|md)$"))
    return files.select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("text"))


def write_preprocessed(result: dict[str, DataFrame], folder: str) -> DataFrame:
    """Writes records, quarantine, events and report as JSON lines below a folder, and returns the manifests of the files; an empty output has none."""
    spark, parts = next(iter(result.values())).sparkSession, []
    for name, df in result.items():
        write_jsonl(df, f"{folder}/{name}")
        parts.append(manifest(spark, f"{folder}/{name}").withColumn("output", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("output", "file", "length", "sha256")


def json_type(value: Column, path: str) -> Column:
    """The type that a JSON value has by itself, such as BIGINT, DECIMAL(1,0), BOOLEAN or STRING; VOID if it is missing."""
    return F.coalesce(F.schema_of_variant(F.variant_get(F.parse_json(value), path, "variant")), F.lit("VOID"))


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """Rows as JSON objects with sorted keys; refuses to overwrite."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("append" if append else "errorifexists").text(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header; a byte order mark is dropped, quotes may hold line breaks."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])


def read_json(path: str) -> dict:
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, dict):
        raise ValueError(f"{path}: the root must be an object")
    return value


def write_json(path: str, value: dict) -> None:
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n", encoding="utf-8")


def load_config(path: str) -> dict:
    """A configuration file's object, with the folder that its relative paths start from."""
    config, file = read_json(path), Path(path).resolve()
    root = config.get("project_root")
    return config | {"_root": str((file.parent / root).resolve() if root else file.parent.parent)}


def project_path(config: dict, value: str) -> Path:
    return Path(value) if Path(value).is_absolute() else Path(config["_root"]) / value


@pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else _html.unescape(t))


def marked_text(html: Column, start: str | None = None, end: str | None = None) -> Column:
    """A page's text between two markers, without scripts, styles, menus and footers."""
    t = F.regexp_replace(html, "(?is)<(script|style|nav|footer|noscript)\\b.*?</\\1\\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(F.regexp_replace(t, "(?is)<(br|/p|/div|/li|/h[1-6]|/tr)\\b[^>]*>", "\n"), "(?s)<[^>]*>", "")
    small_batches()
    t = unescaped(t)
    if start:
        t = F.when(F.contains(t, F.lit(start)), F.substring(t, F.instr(t, F.lit(start)), F.length(t))).otherwise(t)
    if end:
        t = F.substring_index(t, end, 1)
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, "(?U)\\s+", " "))), lambda x: x != "")
    return F.array_join(lines, "\n")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 if they are valid, else as Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def verified_files(spark: SparkSession, path: str, registry: DataFrame) -> DataFrame:
    """(file, sha256, state) of each registered file: verified, mismatch or missing."""
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))
    state = F.when(F.col("sha256").isNull(), "missing").when(F.lower("file_sha256") == F.col("sha256"), "verified").otherwise("mismatch")
    return registry.join(found, "file", "left").select("file", "sha256", state.alias("state"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, sha256) of what was written to a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def split_write(df: DataFrame, path: str, column: str = "split") -> DataFrame:
    """Writes one folder for each value and returns (value, n)."""
    df.write.mode("errorifexists").partitionBy(column).parquet(path)
    return df.sparkSession.read.parquet(path).groupBy(column).agg(F.count("*").alias("n"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, or a temporary one where that is unset; gone when the driver's JVM ends."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='quern-')}"
    path = f"{root.rstrip('/')}/quern-{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def append_batch(df: DataFrame, path: str, batch: int) -> None:
    """Writes one batch of results once: what is there stays, and an interrupted run keeps its earlier batches."""
    df.write.mode("errorifexists").parquet(f"{path}/batch={batch}")


def write_template(df: DataFrame, path: str, blank: list[str]) -> None:
    """A CSV file with a byte order mark and empty columns to fill in."""
    names = [*df.columns, *blank]
    out = df.select(*df.columns, *[F.lit("").alias(c) for c in blank])
    out.toDF("\ufeff" + names[0], *names[1:]).coalesce(1).write.mode("errorifexists").option("header", True).option("emptyValue", "").csv(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to a scratch folder: for results that several branches of a plan read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
