"""Queries of sources, chunking, answering plans and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.chunks import chunk_rows
from quern.functions.schemas import checked
from quern.operators import retrieval as R
from quern.plans import answers as A
from quern.plans.measures import _AREA, CLOCK
from quern.plans.retrieval import asked, corpus, table
from quern.sources.digests import lineage
from quern.sources.files import json_type, marked_text, scratch
from quern.streaming import lines, meter, runs

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: Each chunk from the one before: it ends at the last mark in its second half, or after 600 characters; the next begins 80 before, but further on than this one.
_CHUNKS = r"""
WITH RECURSIVE b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS body FROM documents),
k(doc_id, pos, stop) AS (SELECT doc_id, 0::BIGINT, CUT0 FROM b WHERE length(body) > 0
  UNION ALL SELECT k.doc_id, greatest(k.stop - 80, k.pos + 1), CUT1 FROM k JOIN b ON b.doc_id = k.doc_id WHERE k.stop < length(body)),
p AS (SELECT k.doc_id, pos, regexp_replace(substring(body, pos + 1, stop - pos), '^\s+|\s+$', '', 'g') AS chunk FROM k JOIN b USING (doc_id))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS place, length(chunk) AS length, md5(chunk) AS digest FROM p WHERE chunk <> ''
"""


def _cut(at: str) -> str:
    """Where a chunk that begins at `at` ends, in SQL."""
    half = f"substring(body, {at} + 301, 300)"
    last = lambda mark: f"(CASE WHEN contains({half}, {mark}) THEN 301 - strpos(reverse({half}), reverse({mark})) - length({mark}) + 1 ELSE 0 END)"
    marks = ["chr(10) || chr(10)", "'。'", "'；'", "';'", "'. '"]
    # an end mark's place in the half, from 1; a blank line takes one character more along
    best = "greatest(" + ", ".join(last(m) for m in marks) + ")"
    return f"(CASE WHEN {at} + 600 >= length(body) OR {best} = 0 THEN {at} + 600 ELSE {at} + 300 + {best} + (CASE WHEN substring({half}, {best}, 2) = chr(10) || chr(10) THEN 1 ELSE 0 END) END)"


_CHUNKS = _CHUNKS.replace("CUT0", _cut("0")).replace("CUT1", _cut("greatest(k.stop - 80, k.pos + 1)"))


@query(_CHUNKS)
def chunk_text(spark, sf_dir):
    """Each document's chunks by number, length and digest, from a table function."""
    d = chunk_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "place", F.length("chunk").alias("length"), F.md5("chunk").alias("digest"))


@query()
def marked_html(spark, sf_dir):
    """Pages' text without scripts, menus and footers; character references have no SQL."""
    t = marked_text(F.coalesce("html", F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", F.length(t).alias("length"), F.md5(t).alias("digest"))


@query("SELECT event_id, 'BIGINT' AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_types(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", json_type(F.col("props"), "$.k").alias("kind"), F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT item_id AS query_id, 'C3' AS configuration, true AS fallback, 'safe_fallback_configuration' AS fallback_reason, 0 AS steps FROM benchmark UNION ALL SELECT item_id, 'C0', false, NULL, 0 FROM benchmark")
def plain_answers(spark, sf_dir):
    c, q = corpus(spark, sf_dir), asked(spark, sf_dir)
    return A.answered(c, q, "C0").unionByName(A.answered(c, q, "C3")).select("query_id", "configuration", "fallback", "fallback_reason", "steps")


@query()
def configured_answers(spark, sf_dir):
    """Answers from fused evidence."""
    got = A.answered(corpus(spark, sf_dir), asked(spark, sf_dir), "C1")
    return got.select("query_id", "configuration", F.md5("answer").alias("digest"), F.transform("evidence", lambda e: e["evidence_id"]).alias("evidence"), "fallback")


@query()
def conflict_pairs(spark, sf_dir):
    """Conflicts among the documents found for an item, with every second one's sentences turned negative."""
    found = R.bm25(corpus(spark, sf_dir), asked(spark, sf_dir), 5).join(corpus(spark, sf_dir), "evidence_id")
    sentence = F.when(F.col("rank") % 2 == 0, F.lit(", 不得\n")).otherwise(F.lit("\n"))
    return R.conflicts(found.withColumn("text", F.regexp_replace(F.col("text"), F.lit("\\.\\s*"), sentence)))


def stream(spark, sf_dir):
    """The events as a stream."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


@query("SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Daily windows of a stream under a watermark, drained into Parquet; the last state of each window."""
    path = scratch(spark, "windows")
    s = stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    meter.drain(meter.windowed(s, "ts", "40 days", "1 day", "event_type"), path, "update")
    out = spark.read.parquet(f"{path}/out").groupBy("event_type", "start").agg(F.max(F.struct("batch", "n", "total")).alias("b"))
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "b.n", F.round("b.total", 4).alias("total"))


@query(_AREA + " SELECT user_id, count(*) AS samples, round(coalesce(sum(CASE WHEN dt > 0 AND dt <= 20000 THEN area END), 0), 3) AS energy_j FROM s GROUP BY ALL")
def stream_energy(spark, sf_dir):
    """Energy accumulated by a stateful stream."""
    path = scratch(spark, "energy")
    s = stream(spark, sf_dir).where("value is not null").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("t"), F.col("value").alias("p"))
    meter.drain(meter.running_energy(s, "user_id", 20000.0), path, "update")
    out = spark.read.parquet(f"{path}/out").groupBy("user_id").agg(F.max(F.struct("batch", "samples", "energy_j")).alias("b"))
    return out.select("user_id", "b.samples", F.round("b.energy_j", 3).alias("energy_j"))


@query(f"SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(max({CLOCK}), 3) AS last FROM events WHERE value > 10 GROUP BY ALL")
def stream_append(spark, sf_dir):
    """A filtered stream, durably appended, then read as a table."""
    path = scratch(spark, "append")
    s = stream(spark, sf_dir).where("value > 10").select("event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("t"))
    meter.drain(s, path)
    return spark.read.parquet(f"{path}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.max("t"), 3).alias("last"))


@query()
def run_state_machine(spark, sf_dir):
    """Answers of each user's device to commands that its events stand for."""
    path = scratch(spark, "states")
    command = F.when(F.col("event_type") == "signup", "ARM").when(F.col("event_type") == "click", "START").otherwise("STOP")
    s = stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("device"), F.col("event_id").alias("seq"), command.alias("command"), F.lit("run").alias("run_id"))
    meter.drain(meter.run_states(s), path)
    return spark.read.parquet(f"{path}/out")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total, CAST(max(event_id) AS BIGINT) AS last FROM events GROUP BY ALL")
def meter_lines(spark, sf_dir):
    """The events as lines that a meter appends to files, read as a stream in parts of a few kilobytes."""
    path = scratch(spark, "lines")
    table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "event_type", "value")).alias("value")).write.text(f"{path}/in")
    spark.dataSource.register(lines.MeterLines)
    read = spark.readStream.format("meter_lines").option("part_bytes", 1 << 18).load(f"{path}/in")
    parsed = read.select(F.from_json("line", "event_id bigint, event_type string, value double").alias("e")).select("e.*")
    meter.drain(parsed, path)
    return spark.read.parquet(f"{path}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("event_id").alias("last"))


@query()
def timed_runs(spark, sf_dir):
    """Answers to commands by event time, with arms that expire after a day and runs rejected for lost numbers."""
    path, (key, store) = scratch(spark, "runs"), runs.STORE
    command = F.when(F.col("event_type") == "signup", "ARM").when(F.col("event_type") == "click", "START").otherwise("STOP")
    s = stream(spark, sf_dir).select((F.col("user_id") % 50).cast("string").alias("device"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), command.alias("command"), F.lit("run").alias("run_id"))
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        meter.drain(runs.timed_runs(s, "0 seconds", 86_400.0), path)
    finally:
        spark.conf.set(key, before)
    return spark.read.parquet(f"{path}/out")


@query(
    f"""WITH e AS (SELECT *, {CLOCK} AS t FROM events), s AS (SELECT user_id, event_id AS session, t + 1 AS a, t + 20000 AS b FROM e WHERE event_type = 'purchase')
SELECT s.session, count(e.t) AS samples, round(sum(value), 4) AS total FROM s LEFT JOIN e ON s.user_id = e.user_id AND e.t BETWEEN a AND b GROUP BY ALL"""
)
def stream_sessions(spark, sf_dir):
    """Samples in the hours behind each purchase of their user, by a join of two streams; also purchases with none."""
    path = scratch(spark, "sessions")
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "event_id", "event_type", "ts", "value")
    # a last row of both streams, long after the others, lets the watermarks pass these
    last = e.agg(F.lit(-1).cast("bigint").alias("user_id"), F.lit(-1).cast("bigint").alias("event_id"), F.lit("purchase").alias("event_type"), (F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(0.0).alias("value"))
    e.unionByName(last).write.parquet(f"{path}/in")
    kind = spark.read.parquet(f"{path}/in").schema
    read = lambda: spark.readStream.schema(kind).parquet(f"{path}/in")
    markers = read().where("event_type = 'purchase'").select(F.concat_ws(":", "user_id", "event_id").alias("session"), F.col("user_id").alias("run_key"), (F.col("ts") + F.expr("INTERVAL 1 SECOND")).alias("started"), (F.col("ts") + F.expr("INTERVAL 20000 SECONDS")).alias("ended"))
    joined = meter.marker_join(read().select(F.col("user_id").alias("run_key"), "ts", F.col("value").alias("power_w")), markers, "0 seconds", 20_000)
    meter.drain(joined, path)
    out = spark.read.parquet(f"{path}/out").groupBy("session").agg(F.count("ts").alias("samples"), F.round(F.sum("power_w"), 4).alias("total"))
    return out.select(F.split("session", ":")[1].cast("bigint").alias("session"), "samples", "total").where("session >= 0")


#: What a turn must be like; a user's is shorter, and one after the first has a number above 0.
TURN_SCHEMA = {
    "type": "object",
    "required": ["conv_id", "turn", "role", "text"],
    "properties": {
        "conv_id": {"type": ["string", "integer"]},
        "turn": {"type": "integer", "minimum": 0, "maximum": 4},
        "role": {"enum": ["user", "assistant"]},
        "text": {"type": "string", "minLength": 40},
        "tags": {"type": "array", "items": {"type": "string"}, "uniqueItems": True},
    },
    "additionalProperties": False,
    "allOf": [{"if": {"properties": {"role": {"const": "user"}}, "required": ["role"]}, "then": {"properties": {"text": {"maxLength": 120}}}, "else": {"properties": {"turn": {"exclusiveMinimum": 0}}}}],
}


@query(
    """WITH r AS (SELECT conv_id, turn, unnest([CASE WHEN turn > 4 THEN 'maximum:$.turn' END, CASE WHEN turn < 0 THEN 'minimum:$.turn' END, CASE WHEN role NOT IN ('user', 'assistant') THEN 'enum:$.role' END, CASE WHEN text IS NULL THEN 'type:$.text' END,
CASE WHEN length(text) < 40 THEN 'minLength:$.text' END, CASE WHEN role = 'user' AND length(text) > 120 THEN 'maxLength:$.text' END, CASE WHEN role <> 'user' AND turn <= 0 THEN 'exclusiveMinimum:$.turn' END,
CASE WHEN turn % 3 = 1 THEN 'additionalProperties:$.extra' END, CASE WHEN turn % 2 = 1 THEN 'uniqueItems:$.tags' END]) AS fault FROM conversations)
SELECT fault, count(*) AS n FROM r WHERE fault IS NOT NULL GROUP BY ALL"""
)
def schema_faults(spark, sf_dir):
    """Turns as JSON, some with repeated tags or a field too many, against a schema."""
    c = table(spark, sf_dir, "conversations")
    tags = F.when(F.col("turn") % 2 == 1, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    plain = F.struct("conv_id", "turn", "role", "text", tags.alias("tags"))
    extra = F.struct("conv_id", "turn", "role", "text", tags.alias("tags"), F.lit(1).alias("extra"))
    keep = {"ignoreNullFields": "false"}
    value = F.when(F.col("turn") % 3 == 1, F.to_json(extra, keep)).otherwise(F.to_json(plain, keep))
    return c.select(F.explode(checked(value, TURN_SCHEMA)).alias("fault")).groupBy("fault").agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT lang, count(*) AS n FROM documents GROUP BY ALL) SELECT 'input' AS role, 'input' AS name, count(*) AS n, true AS same FROM documents
UNION ALL SELECT 'output', 'rows', count(*), true FROM documents UNION ALL SELECT 'split', concat('rows/', coalesce(lang, '')), n, true FROM s"""
)
def lineage_digests(spark, sf_dir):
    """Digests of documents, of what is read again after they were written by language, and of each language; an output is the same if its digest is
    the input's, a split if it is that of the input's rows."""
    d, path = table(spark, sf_dir, "documents"), scratch(spark, "lineage")
    d.repartition("source").write.parquet(f"{path}/rows")
    back = spark.read.parquet(f"{path}/rows")
    found, again = lineage(d, {"rows": back}, "lang"), lineage(d, {"rows": d}, "lang").withColumnRenamed("digest", "wanted").drop("n")
    return found.join(again, ["role", "name"]).select("role", "name", "n", (F.col("digest") == F.col("wanted")).alias("same"))
