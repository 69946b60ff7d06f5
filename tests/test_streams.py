"""Streams: transitions of jobs for any cut into batches, and uploads that fail on their own."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foliospark.storage import clear_scratch, scratch
from foliospark.streaming import intake, job_machine, jobs

START = datetime(2024, 1, 1)
CHANGES = "job_id long, at timestamp, status string"


def plain_transitions(changes, limit, passed):
    """Jobs followed one change at a time, in order, up to the watermark."""
    out = []
    for job in {j for j, _, _ in changes}:
        state, since, number = None, None, 0
        mine = sorted((at, s) for j, at, s in changes if j == job and at < passed)

        def step(at, status, timed_out):
            nonlocal state, since, number
            state, since, number = status, at, number + 1
            out.append((job, number, at, status, timed_out))

        for at, s in mine:
            if state == "confirmed":
                break
            if state == "processing" and at > since + limit:
                step(since + limit, "error", True)
            step(at, s, False)
        if state == "processing" and since + limit < passed:
            step(since + limit, "error", True)
    return sorted(out)


@pytest.mark.parametrize("cuts", [1, 3])
def test_transitions_do_not_depend_on_batches(spark, cuts):
    rng = random.Random(8)
    changes = [(rng.randrange(12), START + timedelta(seconds=60 * k + rng.randrange(-1500, 1500)), rng.choice(["processing"] * 3 + ["review", "done", "draft"] + ["confirmed"] * (k % 25 == 0))) for k in range(400)]
    changes[9:9] = changes[5:9]  # told twice
    base = scratch(spark, "jobs")

    def run():
        stream = jobs.document_stream(spark, f"{base}/in", spark.createDataFrame([], CHANGES).schema, files_per_batch=1)
        jobs.run_jobs(job_machine.job_transitions(stream, "10 minutes", "1 hour"), lambda b: b, f"{base}/out", f"{base}/checkpoint").awaitTermination()

    for k in range(cuts):  # each run ends and the next goes on from the checkpoint
        some = changes[k * len(changes) // cuts : (k + 1) * len(changes) // cuts]
        spark.createDataFrame([*some, (None, START, "done"), (3, None, "done"), (3, START, None)], CHANGES).coalesce(1).write.mode("append").parquet(f"{base}/in")
        run()
    out = spark.read.parquet(f"{base}/out")
    assert sorted((r.job_id, r.number, r["at"], r.status, r.timed_out) for r in out.drop("batch").collect()) == plain_transitions(changes, timedelta(minutes=10), max(at for _, at, _ in changes) - timedelta(hours=1))
    final = {r.job_id: r for r in job_machine.final_states(out).collect()}
    assert any(r.time_outs for r in final.values()) and {r.status for r in final.values()} > {"confirmed"}
    with_one = next(j for j, r in final.items() if r.status == "confirmed")
    spark.createDataFrame([(with_one, START + timedelta(days=1), "draft"), (99, START + timedelta(days=2), "done")], CHANGES).coalesce(1).write.mode("append").parquet(f"{base}/in")
    run()
    assert {r.job_id: r.status for r in job_machine.final_states(spark.read.parquet(f"{base}/out")).collect()}[with_one] == "confirmed"


def _parse(uploads):
    return uploads.select("upload_id", F.col("text").cast("int").alias("n"))


def test_uploads_fail_on_their_own(spark):
    base = scratch(spark, "uploads")
    rows = [(k, f"f{k}", START + timedelta(seconds=k), str(k).encode()) for k in range(40)]
    rows[3] = (3, "f3", rows[3][2], b"x\xff")
    rows[4] = (4, "f4", rows[4][2], b"")
    rows[5] = (5, "f5", rows[5][2], None)
    rows[6] = (6, "f6", rows[6][2], b"six")
    rows[30] = (30, "f30", rows[30][2], "dreißig".encode())
    for some in (rows[:20], rows[20:] + [(100, "f1", START, b"1"), (101, "g1", START, b"1")]):  # f1 is sent again; g1 is another file
        spark.createDataFrame(some, intake.UPLOAD).coalesce(1).write.mode("append").parquet(f"{base}/spool")
    for _ in range(2):  # the second run finds nothing new
        intake.take_in(intake.upload_stream(spark, f"{base}/spool", "1 day", 1), _parse, base, f"{base}/checkpoint").awaitTermination()
    errors = {r.upload_id: r.error for r in spark.read.parquet(f"{base}/errors").collect()}
    assert set(errors) == {3, 4, 5, 6, 30} and errors[3] == "not UTF-8" and errors[4] == errors[5] == "empty file" and "six" in errors[6] and "dreißig" in errors[30]
    records = {r.upload_id: r.n for r in spark.read.parquet(f"{base}/records").collect()}
    assert records == {k: k for k in range(40) if k not in errors} | {101: 1}
    intake.clear_spool(spark, base)
    left = [f.getPath().getName() for f in _files(spark, f"{base}/spool") if f.getPath().getName().endswith(".parquet")]
    assert left == []


def _files(spark, path):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)


def test_isolated_rows_of_python_functions(spark):
    @F.udf("long")
    def picky(text):
        if text in ("7", "11"):
            raise ValueError(f"no page {text}")
        return len(text)

    def process(rows):
        return rows.select("upload_id", picky("text").alias("n"))

    rows = spark.createDataFrame([(k, str(k)) for k in range(16)] + [(7, "twin of seven")], "upload_id long, text string")
    made, failed = intake.isolated(rows, process, "upload_id")
    assert sorted(r.upload_id for r in made.collect()) == [k for k in range(16) if k not in (7, 11)]
    assert {r.upload_id: r.error for r in failed.collect()} == {7: "ValueError: no page 7", 11: "ValueError: no page 11"}
    made, failed = intake.isolated(rows.limit(0), process, "upload_id")
    assert made.count() == 0 and failed is None


def test_a_broken_process_ends_the_run(spark, monkeypatch):
    monkeypatch.setattr(intake, "MOST_FAILED", 2)
    rows = spark.createDataFrame([(k, "x") for k in range(8)], "upload_id long, text string")
    with pytest.raises(intake.ROW_ERRORS):
        intake.isolated(rows, lambda r: r.select("upload_id", F.raise_error(F.lit("never works")).cast("int").alias("n")), "upload_id")
    with pytest.raises(ZeroDivisionError):  # no fault of a row
        intake.isolated(rows, lambda r: 1 / 0, "upload_id")


def test_scratch_can_be_cleared(spark):
    from foliospark.storage import materialize

    path = scratch(spark, "x").rsplit("/", 2)[0]
    assert materialize(spark.range(3), "three").count() == 3 and _files(spark, path)
    clear_scratch(spark)
    with pytest.raises(Exception, match="(?i)not exist"):
        _files(spark, path)
    clear_scratch(spark)  # nothing there


def test_failing_rows_cost_no_jobs(spark):
    """Many failing rows are told apart within the tasks of one job, more of them than MOST_FAILED too."""
    import pandas as pd

    n = intake.MOST_FAILED + 500
    rows = spark.range(2 * n).selectExpr("id as upload_id", "if(id % 2 = 0, 'x', string(id)) as text")
    made, failed = intake.isolated_in_tasks(rows, lambda b: pd.DataFrame({"upload_id": b["upload_id"], "n": [int(t) for t in b["text"]]}), "upload_id long, n long", "upload_id")
    assert made.count() == failed.count() == n and made.where("upload_id <> n").count() == 0
    assert failed.where("upload_id % 2 = 0 and error like 'ValueError: invalid literal%'").count() == n
