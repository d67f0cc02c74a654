"""Registered queries: sources, sinks, resumable runs and the streaming ingest.

Each writes data that Spark derives from the input tables into a fresh folder
under the shared checkpoint directory, then reads it back through the operator.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import contains_any, normalize_message
from ..operators import codemetrics as G
from ..session import scratch_path
from ..sources import buckets as B
from ..sources import csv_io as CSV
from ..sources import resume as RS
from ..sources.union import multi_source_union
from ..streaming.incremental import incremental_ingest
from ..streaming.stateful import stateful_ingest
from . import views as V
from .q_metrics import _G4_SQL
from .registry import register
from .sqlfrag import quote_terms

EVENT_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()),
                             T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def _ragged_events_csv(t) -> str:
    """Event rows as raw CSV lines: 'error' rows carry one field too many, 'view' rows two too few."""
    e = t.events
    quoted = F.concat(F.lit('"'), F.replace(F.col("props"), F.lit('"'), F.lit('""')), F.lit('"'))
    full = F.concat_ws(",", F.col("event_id").cast("string"), "event_type", F.col("value").cast("string"), quoted)
    line = (F.when(F.col("event_type") == "error", F.concat(full, F.lit(",extra")))
             .when(F.col("event_type") == "view", F.concat_ws(",", F.col("event_id").cast("string"), "event_type"))
             .otherwise(full))
    path = scratch_path(t.spark, "ragged-csv")
    e.select(line.alias("value")).write.text(path)
    return path


def _events_csv(t) -> str:
    path = scratch_path(t.spark, "events-csv")
    CSV.table_sink(t.events.select("event_id", "event_type", "value", "props"), path, fmt="csv")
    return path


@register("csv_lenient_scan", sql="""
SELECT event_id, event_type, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS value,
       CASE WHEN event_type = 'view' THEN NULL ELSE props END AS props FROM events WHERE event_type <> 'error'""")
def csv_lenient_scan_q(t):
    """Good side of a lenient read (short rows kept and padded)."""
    good, _ = CSV.csv_lenient_scan(t.spark, _ragged_events_csv(t), EVENT_SCHEMA, header=False)
    return good


@register("csv_quarantine", sql="""
SELECT event_id, event_type, '"' || replace(props, '"', '""') || '"' AS props_raw, ',extra' AS tail, 'extra' AS extra FROM events WHERE event_type = 'error'""")
def csv_quarantine_q(t):
    """Quarantined side (rows with too many fields), with the raw record and the extra fields."""
    _, bad = CSV.csv_lenient_scan(t.spark, _ragged_events_csv(t), EVENT_SCHEMA, header=False)
    head = F.regexp_extract("raw", r"^[^,]*,[^,]*,[^,]*,(.*),extra\s*$", 1)
    return bad.select("event_id", "event_type", head.alias("props_raw"), F.regexp_extract("raw", r"(,extra)\s*$", 1).alias("tail"),
                      F.array_join("extra", ",").alias("extra"))


@register("csv_strict_scan", sql="SELECT event_id, event_type, value, props FROM events")
def csv_strict_scan_q(t):
    """A well-formed CSV passes the strict read."""
    return CSV.csv_strict_scan(t.spark, _events_csv(t), EVENT_SCHEMA, header=True)


@register("csv_named_scan", sql="SELECT CAST(value AS VARCHAR) AS value, CAST(event_id AS VARCHAR) AS event_id FROM events")
def csv_named_scan_q(t):
    """S3: columns picked by header name (text, as a header-keyed row reader gives them)."""
    return CSV.csv_named_scan(t.spark, _events_csv(t), ["value", "event_id"])


@register("multi_source_union", sql="SELECT o_orderkey, o_totalprice, 'repo_' || o_orderstatus AS repo FROM orders")
def multi_source_union_q(t):
    """One extraction over three sources (orders split by status), concatenated."""
    o = t.orders
    srcs = {f"repo_{s}": o.where(F.col("o_orderstatus") == s) for s in ("F", "O", "P")}
    return multi_source_union(srcs, lambda d: d.select("o_orderkey", "o_totalprice"))


@register("table_sink", sql="SELECT doc_id, lang, n_chars, text FROM documents")
def table_sink_q(t):
    """Parquet hand-off between stages, read back."""
    path = CSV.table_sink(t.documents.select("doc_id", "lang", "n_chars", "text"), scratch_path(t.spark, "sink"))
    return t.spark.read.parquet(path)


@register("subset_sink", sql="SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def subset_sink_q(t):
    """Only the rows of a chosen id set (labels flagged toxic), written beside the full output."""
    ids = t.labels.where(F.col("toxic") == 1)
    path = CSV.subset_sink(t.documents.select("doc_id", "lang"), ids, "doc_id", scratch_path(t.spark, "subset"))
    return t.spark.read.parquet(path)


@register("dead_letter_sink", views=("v_code",), sql=f"SELECT hash, 'metrics' AS stage, error FROM ({_G4_SQL}) g WHERE error IS NOT NULL")
def dead_letter_sink_q(t):
    """Failed metric rows recorded as (key, stage, error); the run goes on."""
    _, dead = RS.split_dead_letters(G.code_change_metrics(V.v_code(t)), "error", ["hash"], "metrics", scratch_path(t.spark, "metrics"))
    return dead


@register("dead_letter_good", views=("v_code",), sql=f"SELECT hash, mi_change, loc_change FROM ({_G4_SQL}) g WHERE error IS NULL")
def dead_letter_good_q(t):
    """The good side of the same split."""
    good, _ = RS.split_dead_letters(G.code_change_metrics(V.v_code(t)), "error", ["hash"], "metrics", scratch_path(t.spark, "metrics"))
    return good.select("hash", F.round("mi_change", 6).alias("mi_change"), "loc_change")


@register("resume_append", views=("v_file",), sql="SELECT hash, path, file_pos FROM v_file")
def resume_append_q(t):
    """A first run wrote early commits; the rerun appends only the missing keys."""
    out = scratch_path(t.spark, "resume")
    files = V.v_file(t).join(V.v_commit(t).select("hash", "committed_at"), "hash")
    first = files.where(F.col("committed_at") < F.lit("1998-01-01").cast("timestamp_ntz")).select("hash", "path", "file_pos")
    RS.resume_append(first, out, ["hash", "path"])
    RS.resume_append(files.select("hash", "path", "file_pos"), out, ["hash", "path"])
    return t.spark.read.parquet(out)


@register("resume_append_pruned", views=("v_file",), sql="SELECT hash, path, file_pos FROM v_file")
def resume_append_pruned_q(t):
    """S8 by buckets: a first run wrote early commits; the rerun reads only the buckets that its keys may be in, and they are compacted."""
    out = scratch_path(t.spark, "resume-buckets")
    files = V.v_file(t).join(V.v_commit(t).select("hash", "committed_at"), "hash")
    first = files.where(F.col("committed_at") < F.lit("1998-01-01").cast("timestamp_ntz")).select("hash", "path", "file_pos")
    B.pruned_append(first, out, ["hash", "path"], n_buckets=16)
    B.pruned_append(files.select("hash", "path", "file_pos"), out, ["hash", "path"], n_buckets=16)
    B.compact_buckets(t.spark, out, most_files=1)
    return B.read_buckets(t.spark, out)


@register("batch_checkpoint", views=("v_file",), sql="SELECT hash, path, file_pos FROM v_file")
def batch_checkpoint_q(t):
    """Results written in hash batches; a rerun adds the rows that arrived late."""
    out = scratch_path(t.spark, "batches")
    files = V.v_file(t).select("hash", "path", "file_pos")
    RS.batch_checkpoint(files.where("hash % 3 != 0"), out, ["hash", "path"], 16)
    return RS.batch_checkpoint(files, out, ["hash", "path"], 16).drop("batch_id")


@register("nested_column_io", views=("v_commit",), sql="""
SELECT hash, to_json(parents)::VARCHAR AS parents_json, json_array_length(to_json(parents)) AS n_parents FROM v_commit""")
def nested_column_io_q(t):
    """List column to JSON text and back."""
    j = CSV.to_json_columns(V.v_commit(t).select("hash", "parents"), ["parents"])
    back = CSV.from_json_columns(j.withColumn("p2", F.col("parents")), {"p2": "array<bigint>"})
    return back.select("hash", F.col("parents").alias("parents_json"), F.size("p2").alias("n_parents"))


@register("tri_state_parse", sql="""
SELECT event_id, CASE WHEN (CASE WHEN json_valid(p) THEN json_type(p) = 'OBJECT' ELSE false END) THEN 'Ok' ELSE 'Error' END AS parse_status,
       CASE WHEN (CASE WHEN json_valid(p) THEN json_type(p) = 'OBJECT' ELSE false END) THEN CAST(json_extract(p, '$.k') AS BIGINT) END AS k
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN substring(props, 2) ELSE props END AS p FROM events) s""")
def tri_state_parse_q(t):
    """Parse JSON props; truncated text on error events gives 'Error'."""
    e = t.events.select("event_id", F.when(F.col("event_type") == "error", F.substring("props", 2, 1 << 30))
                        .otherwise(F.col("props")).alias("p"))
    r = CSV.tri_state_parse(e, "p", "struct<k:bigint>", "parsed")
    return r.select("event_id", "parse_status", F.col("parsed.k").alias("k"))


@register("run_counters", views=("v_commit",), sql=f"""
SELECT count(*) AS rows, count_if(regexp_matches(translate(regexp_replace(regexp_replace(lower(message), '^\\s+', ''), '\\s+$', ''),
       chr(10) || chr(13), '  '), '{quote_terms()}')) AS bug_fix,
       count_if(len(parents) > 1) AS merges FROM v_commit""")
def run_counters_q(t):
    """Commits seen, bug-fixing commits and merges, counted in one pass."""
    c = V.v_commit(t)
    return RS.counters_table(c, bug_fix=contains_any(normalize_message("message")), merges=F.size("parents") > 1)


@register("incremental_ingest", sql="SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem")
def incremental_ingest_q(t):
    """Streaming file source, availableNow trigger, anti-join append per micro-batch."""
    spark = t.spark
    schema = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").schema
    out, ck = scratch_path(spark, "ingest-out"), scratch_path(spark, "ingest-ckpt")
    # the table may be one file or a folder of part files
    source = scratch_path(spark, "ingest-in")
    t.lineitem.select(*schema.names).write.parquet(source)
    incremental_ingest(spark, source, schema, out, ck, ["l_orderkey", "l_linenumber", "l_partkey"])
    return spark.read.parquet(out)


@register("stateful_ingest", sql="""
WITH first AS (SELECT * FROM events WHERE event_id % 3 <> 0 AND event_id % 10 < 7),
mark AS (SELECT max(ts) - INTERVAL 10 DAY AS late FROM first)
SELECT event_id, user_id, CASE WHEN event_id % 3 <> 0 AND event_id % 10 < 7 THEN 'kept' WHEN ts < late THEN 'late' ELSE 'kept' END AS side
FROM events, mark
UNION ALL
SELECT event_id, user_id, 'late' FROM first, mark WHERE ts < late""")
def stateful_ingest_q(t):
    """S12 with state: a first delivery, then all events; repeats are dropped, events over ten days behind the first delivery are set aside."""
    spark = t.spark
    events = t.events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    source, out, late, ck = (scratch_path(spark, f"stateful-{x}") for x in ("in", "out", "late", "ckpt"))

    def run():
        stateful_ingest(spark, source, events.schema, out, late, ck, ["event_id"], "ts", "10 days")

    events.where("event_id % 3 <> 0 AND event_id % 10 < 7").write.mode("append").parquet(source)
    run()
    events.write.mode("append").parquet(source)
    run()
    run()  # nothing new
    kept, aside = spark.read.parquet(out), spark.read.parquet(late)
    return kept.select("event_id", "user_id", F.lit("kept").alias("side")).unionByName(aside.select("event_id", "user_id", F.lit("late").alias("side")))
