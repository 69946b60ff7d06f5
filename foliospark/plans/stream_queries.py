"""Queries that run as streams: jobs with states and time-outs, and uploads that fail on their own."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import records
from ..storage import scratch
from ..streaming import counters, intake, job_machine, jobs
from .queries import CONFIG, query, read

LIMIT_HOURS, DELAY_DAYS = 3, 5
MOST_FILES = 2**31 - 1
STATUS = ["processing", "review", "done", "error", "draft"]


@query(f"""WITH e AS (SELECT user_id AS job_id, ts, CASE WHEN event_id % 35 = 34 THEN 'confirmed' ELSE ['{"', '".join(STATUS)}'][event_id % 5 + 1] END AS status FROM events),
    m AS (SELECT *, epoch_us((SELECT max(ts) FROM events)) // 1000 - {DELAY_DAYS * 86_400_000} AS passed FROM e),
    d AS (SELECT *, coalesce(count(*) FILTER (status = 'confirmed') OVER (PARTITION BY job_id ORDER BY ts, status ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m WHERE epoch_us(ts) // 1000 < passed),
    k AS (SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, status) AS following, ts + INTERVAL {LIMIT_HOURS} HOUR AS until FROM d WHERE before = 0),
    t AS (SELECT job_id, ts AS moment, 1 AS part, status, false AS timed_out FROM k
        UNION ALL SELECT job_id, until, 0, 'error', true FROM k WHERE status = 'processing' AND (following > until OR following IS NULL AND epoch_us(until) // 1000 < passed))
    SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY moment, part, status) AS number, strftime(moment, '%Y-%m-%d %H:%M:%S.%f') AS "at", status, timed_out FROM t""")
def job_transitions(spark, sf):
    """Events as changes of jobs, which come in four parts, up to three days out of order; the stream ends after each and goes on from its checkpoint."""
    base = scratch(spark, "jobs")
    s = F.when(F.col("event_id") % 35 == 34, "confirmed").otherwise(F.element_at(F.array(*[F.lit(x) for x in STATUS]), (F.col("event_id") % 5 + 1).cast("int")))
    changes = read(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("at"), s.alias("status"), F.floor((F.dayofmonth("ts") + F.pmod(F.xxhash64("event_id"), F.lit(4))) / 9).alias("part"))

    def run():
        stream = jobs.document_stream(spark, f"{base}/in", changes.drop("part").schema, files_per_batch=MOST_FILES)
        jobs.run_jobs(job_machine.job_transitions(stream, f"{LIMIT_HOURS} hours", f"{DELAY_DAYS} days"), lambda b: b, f"{base}/out", f"{base}/checkpoint").awaitTermination()

    for k in range(4):
        changes.where(F.col("part") == k).drop("part").write.mode("append").parquet(f"{base}/in")  # as many files as there are tasks, which are one batch
        run()
    return spark.read.parquet(f"{base}/out").select("job_id", "number", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "status", "timed_out")


BROKEN = "page 99999999999 of 1\n"


@query("""SELECT 'file ' || doc_id AS filename,
        CASE WHEN doc_id % 17 = 3 OR coalesce(text, '') = '' THEN 'empty file' WHEN doc_id % 13 = 5 THEN 'not UTF-8' WHEN doc_id % 400 = 7 THEN 'bad number' END AS error,
        CASE WHEN doc_id % 17 = 3 OR coalesce(text, '') = '' OR doc_id % 13 = 5 OR doc_id % 400 = 7 THEN NULL ELSE len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda t: t <> '')) END AS n_words
    FROM documents""")
def failing_uploads(spark, sf):
    """Documents as uploads in a spool: some are empty, no UTF-8, or break the process; every eleventh is sent twice. Records, and errors by upload."""
    base = scratch(spark, "uploads")
    i, raw = F.col("doc_id"), F.encode(F.coalesce("text", F.lit("")), "utf-8")
    content = F.when(i % 17 == 3, F.lit(b"")).when(i % 13 == 5, F.concat(raw, F.lit(b"\xff"))).when((i % 400 == 7) & (F.octet_length(raw) > 0), F.concat(F.lit(BROKEN.encode()), raw)).otherwise(raw)
    sent = read(spark, sf, "documents").select(i.alias("upload_id"), F.concat(F.lit("file "), i).alias("filename"), F.expr("timestamp'2024-05-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, doc_id % 600)").alias("sent_at"), content.alias("content"))
    again = sent.where("upload_id % 11 = 0").withColumn("upload_id", -1 - F.col("upload_id"))
    for k in range(2):
        sent.where(F.col("upload_id") % 2 == k).write.mode("append").parquet(f"{base}/spool")
    again.write.mode("append").parquet(f"{base}/spool")

    def process(uploads):
        words = [sum(t != "" for t in re.split("[ \t\n\r]+", text)) for text in uploads["text"]]
        pages = [re.match("page ([0-9]+) of", text) for text in uploads["text"]]
        return pd.DataFrame({"upload_id": uploads["upload_id"], "n_words": words, "page_no": pd.array([np.int32(int(p[1])) if p else None for p in pages], dtype="Int32")})

    files = len(spark.read.parquet(f"{base}/spool").inputFiles())
    uploads = intake.upload_stream(spark, f"{base}/spool", "1 day", max(1, files // 3))
    intake.take_in(uploads, process, base, f"{base}/checkpoint", "upload_id long, n_words long, page_no int").awaitTermination()
    intake.clear_spool(spark, base)
    named = sent.select("upload_id", "filename")
    done = spark.read.parquet(f"{base}/records").join(named, "upload_id").select("filename", F.lit(None).cast("string").alias("error"), "n_words", "page_no")
    failed = spark.read.parquet(f"{base}/errors").select("filename", F.when(F.col("error").contains("99999999999"), "bad number").otherwise(F.col("error")).alias("error"), F.lit(None).cast("long").alias("n_words"))
    return done.drop("page_no").unionByName(failed)


@query("""WITH s AS (SELECT count(*) AS docs, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(turn), 0) AS BIGINT) AS tokens_out FROM conversations),
    c AS (SELECT *, tokens_in / 1e6::DOUBLE * 0.27::DOUBLE + tokens_out / 1e6::DOUBLE * 1.10::DOUBLE AS usd FROM s)
    SELECT docs, tokens_in, tokens_out, CAST(floor(tokens_in / docs + 0.5) AS BIGINT) AS avg_in, CAST(floor(tokens_out / docs + 0.5) AS BIGINT) AS avg_out,
        CASE WHEN usd < 0.01 THEN printf('~$%.5f  (~%.5f €)', usd, usd * 0.93) ELSE printf('~$%.4f  (~%.4f €)', usd, usd * 0.93) END AS cost, 3 AS batches FROM c""")
def token_counters(spark, sf):
    """Turns as calls that come in three batches of a stream; their tokens are counted while they are written."""
    base = scratch(spark, "calls")
    calls = read(spark, sf, "conversations").select("conv_id", "turn", F.char_length("text").cast("long").alias("tokens_in"), F.col("turn").cast("long").alias("tokens_out"))
    for k in range(3):
        calls.where(F.pmod("conv_id", F.lit(3)) == k).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = counters.counted_stream(jobs.document_stream(spark, f"{base}/in", calls.schema, files_per_batch=1))
    total = counters.logged(spark, lambda: stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    row = [(total["docs"], total["tokens_in"], total["tokens_out"], total["batches"])]
    return records.with_costs(spark.createDataFrame(row, "docs long, tokens_in long, tokens_out long, batches int"), CONFIG)
