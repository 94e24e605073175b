"""Request screening as a stream (W5, W6) and decision rollups.

Requests arrive as JSON lines in a folder.  Each line goes through the strict intake;
rejected lines go to a quarantine table with their reasons.  A request id that was
seen within the watermark's delay is dropped, in whatever batch it comes again, and
lines that are later than the watermark are dropped and counted in a side output.
What is left of each micro-batch is screened by ``analyze`` with the policy
table re-read at the start of the batch (edits take effect on the next batch), and
its hash-only audit rows are appended to the audit table.
"""
from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsieve.plans import analyze as AN
from textsieve.session import cut, ensure_checkpoint_dir
from textsieve.sources import requests as RQ


def write_policy(spark: SparkSession, path: str, overrides: dict) -> None:
    rows = [(k, int(b), int(t)) for k, (b, t) in overrides.items()]
    spark.createDataFrame(rows, "tenant_id string, block int, transform int").write.mode("overwrite").parquet(path)


DELAY = "1 hour"


def screen_batch(parsed: DataFrame, policy_path: str, audit_path: str, paraphrase: bool = True,
                 similarity: bool = True, batch_id: int = 0) -> None:
    """Screen the requests of a micro-batch (valid rows of `sources.requests.parse_requests`)."""
    parsed = cut(parsed)          # the state behind it is stepped once, however often the batch is read
    docs_path = os.path.join(audit_path + "_docs", f"batch={batch_id}")
    if parsed.isEmpty():          # as where Spark only moves the watermark: no plan of all rules for no rows
        parsed.sparkSession.createDataFrame([], "request_id string, pos int, doc_hash string").write.mode("overwrite").parquet(docs_path)
        return
    requests, docs = RQ.flatten_requests(parsed.select("req.*"))
    policy = parsed.sparkSession.read.parquet(policy_path)
    decisions, doc_rows = AN.analyze(requests, docs, paraphrase=paraphrase, similarity=similarity,
                                     policy=policy, with_docs=True, stored="hashes")
    # written per batch id with overwrite: a micro-batch re-run after a failure
    # replaces its own output instead of appending duplicates
    audit = AN.audit_records(decisions).withColumn("date", F.substring("timestamp", 1, 10))
    audit.write.mode("overwrite").partitionBy("date").parquet(os.path.join(audit_path, f"batch={batch_id}"))
    AN.audit_doc_hashes(doc_rows).write.mode("overwrite").parquet(docs_path)


def taken_in(lines: DataFrame, event_time: str = "received_at") -> DataFrame:
    """Streaming text lines -> intake rows with their event time ``ts``: the line's ``received_at`` (a valid line
    without one is rejected for that), or with ``event_time="arrival"`` the time of its file."""
    parsed = RQ.parse_requests(lines.select("value", F.col("_metadata.file_modification_time").alias("_arrived")), extra=("_arrived",))
    parsed = parsed.withColumn("ts", F.col("_arrived" if event_time == "arrival" else "received_at")).drop("_arrived")
    timeless = F.col("valid") & F.col("ts").isNull()
    return parsed.withColumns({"valid": F.col("valid") & F.col("ts").isNotNull(), "reasons": F.when(
        timeless, F.array(F.lit("received_at: missing"))).otherwise(F.col("reasons"))})


def run_screen_stream(spark: SparkSession, requests_dir: str, policy_path: str, run_dir: str,
                      paraphrase: bool = True, similarity: bool = True, files_per_batch: int = 1,
                      delay: str = DELAY, event_time: str = "received_at") -> DataFrame:
    """Screen the files that have arrived; returns the audit table.

    Rejected lines need no state and go to ``run_dir``/quarantine in a query of their own, so that they cannot move
    the watermark; `late_rows` counts the requests that came after it."""
    audit_path = os.path.join(run_dir, "audit")
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(requests_dir)
    rows = taken_in(lines, event_time)
    aside = (rows.where("not valid").select("request_id", "reasons", "line").writeStream.format("parquet")
             .option("path", os.path.join(run_dir, "quarantine"))
             .option("checkpointLocation", os.path.join(run_dir, "quarantine_checkpoint")).trigger(availableNow=True).start())
    once = (rows.where("valid").withWatermark("ts", delay).withColumn("_id", F.col("request_id"))
            .dropDuplicatesWithinWatermark(["_id"]).drop("_id"))
    q = (once.writeStream
         .foreachBatch(lambda b, i: screen_batch(b, policy_path, audit_path, paraphrase, similarity, i))
         .option("checkpointLocation", os.path.join(run_dir, "checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    aside.awaitTermination()
    late = [(p["batchId"], sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"])) for p in q.recentProgress]
    if late:
        (spark.createDataFrame([(int(b), int(n)) for b, n in late], "batch_id long, n_late long").coalesce(1)
         .write.mode("overwrite").parquet(os.path.join(run_dir, "late", f"since={late[0][0]}")))
    return spark.read.parquet(audit_path)


def late_rows(spark: SparkSession, run_dir: str) -> DataFrame:
    """(batch_id, n_late): rows of each micro-batch that were later than the watermark."""
    rows = spark.read.parquet(os.path.join(run_dir, "late"))
    return rows.groupBy("batch_id").agg(F.max("n_late").alias("n_late"))


def stage_requests(spark: SparkSession, sf_dir: str, out_dir: str, parts: int = 2) -> list[str]:
    """Serialize the seeded requests as JSON-line files (one folder per part, all in one pass)."""
    rid = F.get_json_object("value", "$.metadata.request_id")
    j = RQ.request_json(spark, sf_dir).withColumn("_part", F.split(rid, "-")[0].cast("long") % parts)
    (j.where(F.col("_part").between(0, parts - 1)).select("value", F.col("_part").alias("part"))
     .write.mode("overwrite").partitionBy("part").text(out_dir))
    dirs = [os.path.join(out_dir, f"part={p}") for p in range(parts)]
    for d in dirs:
        try:
            spark.read.text(d)
        except AnalysisException:                       # a part without requests
            spark.createDataFrame([], "value string").write.text(d)
    return dirs


def n_files(spark: SparkSession, folder: str) -> int:
    """Number of files in a folder of lines, 1 at least."""
    return max(1, len(spark.read.text(folder).inputFiles()))


def new_run_dir(spark: SparkSession, name: str) -> str:
    import uuid
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def window_rollup(verdicts: DataFrame, size: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    """Decisions per sliding (or tumbling, slide == size) event-time window."""
    w = F.window(F.col("ts"), size, slide)
    return (verdicts.groupBy(w.alias("w"), "app_id", "allowed").agg(F.count("*").alias("n"))
            .select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "app_id",
                    "allowed", F.col("n").cast("long").alias("n")))
