"""Steps whose cost has to grow no faster than their input."""

from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_answers_are_parsed_once(spark):
    from foliospark.operators.answers import free_answer, suggested

    raw = spark.createDataFrame([('{"tipo_documento": "a", "datos": {"k": 1}}',)], "raw string")
    for of, most in ((free_answer, 6), (suggested, 4)):
        plan = plan_of(raw.select(of(F.col("raw")).alias("f")))
        assert plan.count("from_json") + plan.count("parse_json") <= most and plan.count("regexp_replace") == 2


def test_queries_are_sent_to_few_lists(spark):
    import random

    from foliospark.operators import retrieval_index

    rng = random.Random(3)
    rows = [(i, str(i % 3), [rng.gauss(0, 1) for _ in range(8)]) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id long, template string, vector array<double>")
    asked = frame.where("id % 30 = 0")
    found, read = retrieval_index.top_examples_indexed(asked, frame, 3)
    assert read.count() <= 32 * 100 and found.count() == 300


def test_a_table_streams_as_a_file_and_as_a_folder(spark, sf):
    from foliospark.storage import scratch
    from foliospark.streaming import jobs

    events = spark.read.parquet(f"{sf}/events.parquet")
    folder = scratch(spark, "events.parquet")
    events.repartition(3).write.parquet(folder)
    for path in (f"{sf}/events.parquet", folder):
        base = scratch(spark, "stream")
        jobs.run_jobs(jobs.table_stream(spark, path, events.schema, files_per_batch=2), lambda b: b, f"{base}/out", f"{base}/checkpoint").awaitTermination()
        assert spark.read.parquet(f"{base}/out").count() == events.count()


def test_words_of_a_text_are_gathered_without_a_shuffle(spark):
    from foliospark.operators.layout import document_text, words_from_text

    docs = spark.createDataFrame([(i, " ".join(["word"] * 700)) for i in range(5)], "doc_id long, text string")
    pages = document_text(words_from_text(docs))
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and "REPARTITION_BY_NUM" in plan
    assert pages.count() == 10


def test_pages_cut_from_texts_hold_the_same_words(spark):
    """Pages are lists of the words that are rows elsewhere, made without sorting or gathering them."""
    from foliospark.operators.layout import pages_from_text, words_from_text
    from foliospark.operators.lines import group_lines, line_texts

    docs = spark.createDataFrame([(1, "a  b\nc"), (2, " ".join(f"w{i}" for i in range(1250))), (3, " \n"), (4, None), (5, "é " * 600)], "doc_id long, text string")
    pages = pages_from_text(docs)
    columns = ["doc_id", "page", "word_no", "text", "conf", "x", "y", "w", "h"]
    assert sorted(pages.selectExpr("doc_id", "page", "inline(ws)").select(columns).collect()) == sorted(words_from_text(docs).select(columns).collect())
    texts = line_texts(group_lines(pages))
    assert "Aggregate" not in texts._jdf.queryExecution().executedPlan().toString()
    assert sorted(texts.collect()) == sorted(line_texts(group_lines(words_from_text(docs))).collect())


def test_a_phrase_is_normalised_once(spark):
    """The look-up of a label's kind doesn't repeat what is looked up for each kind."""
    from foliospark.functions.text import label_kind, normal_label

    plan = plan_of(spark.createDataFrame([("Nº Expediente",)], "t string").select(label_kind(normal_label(F.col("t"))).alias("k")))
    assert plan.count("lower(") == 1


def test_a_page_is_searched_once_for_all_values(spark):
    from foliospark.operators.anchors import find_values
    from foliospark.operators.layout import pages_from_text

    pages = pages_from_text(spark.createDataFrame([(1, "one two three four"), (2, "two")], "doc_id long, text string"))
    values = spark.createDataFrame([(1, 0, "two three"), (1, 0, "four"), (2, 0, "two"), (2, 0, "seven")], "doc_id long, page long, value string")
    found = find_values(pages, values)
    assert sorted((r.doc_id, r.value, r.score) for r in found.collect()) == [(1, "four", 1.0), (1, "two three", 1.0), (2, "two", 1.0)]
    assert "Aggregate" in found._jdf.queryExecution().executedPlan().toString() and "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_reading_is_chosen_where_its_page_is(spark):
    from foliospark.operators.layout import ensemble

    ws = "array(named_struct('conf', {}L), named_struct('conf', {}L))"
    rows = spark.range(1).selectExpr("id as doc_id", "0L as page", "array(" + ", ".join(f"named_struct('variant', {v}, 'ws', {ws.format(a, b)})" for v, a, b in ((0, 1, 2), (1, 5, 4), (2, 4, 5))) + ") as readings")
    best = ensemble(rows)
    assert best.first().variant == 1 and "Exchange" not in best._jdf.queryExecution().executedPlan().toString()


def test_second_readings_beside_their_values_are_not_joined(spark, sf):
    from foliospark.operators.extract import better_readings, better_values
    from foliospark.plans.queries import QUERIES

    rows = [(1, 0, "a", "x", 50.0, "y", 60.0), (1, 0, "b", " ", 90.0, "z", 1.0), (1, 1, "a", "x", 70.0, "y", 60.0), (2, 0, "a", "x", 90.0, None, None), (2, 0, "b", "", 0.0, " ", 99.0)]
    both = spark.createDataFrame(rows, "doc_id long, page long, key string, value string, confidence double, new_value string, new_confidence double")
    joined = better_values(both.drop("new_value", "new_confidence"), both.drop("value", "confidence").where("new_value is not null"))
    assert sorted(better_readings(both).collect()) == sorted(joined.collect())
    plan = QUERIES["weak_fields"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and "SortMergeJoin" not in plan


def test_signatures_are_made_once_for_a_match(spark, sf):
    from foliospark.plans.process import match_pages
    from foliospark.plans.queries import _pages, _templates, words

    found = match_pages(_pages(words(spark, sf)), _templates(spark, sf))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "REPARTITION_BY_NUM" not in plan and found.count() > 0


def test_changes_of_jobs_are_written_by_all_tasks(spark, sf, tmp_path, monkeypatch):
    """No part of the changes goes through one task, and a part of several files is one batch."""
    from foliospark.plans import all_queries  # noqa: F401
    from foliospark.plans import stream_queries
    from foliospark.plans.queries import QUERIES

    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(stream_queries, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    got = sorted(map(tuple, QUERIES["job_transitions"](spark, str(tmp_path)).collect()))
    files = list((tmp_path / "jobs/in").glob("part-*.parquet"))
    assert len(files) > 4
    monkeypatch.undo()
    assert got == sorted(map(tuple, QUERIES["job_transitions"](spark, sf).collect()))
