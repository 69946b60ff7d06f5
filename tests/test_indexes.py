"""Indexes against full comparison: nearest examples, templates in groups; consensus among anchors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators import matching, retrieval, retrieval_index, template_index, transforms

VECTORS = "id long, template long, vector array<double>"


def plain_top(queries, examples, k, by_template):
    out = []
    for q, t, x in queries:
        scored = []
        for e, s, y in examples:
            if not y or (by_template and (t is None or s != t)):
                continue
            nx, ny = np.linalg.norm(x), np.linalg.norm(y)
            scored.append((-(round(float(np.dot(x, y) / (nx * ny)), 6) if len(x) == len(y) and nx * ny > 0 else 0.0), e))
        out += [(q, e, -s, n + 1) for n, (s, e) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("by_template", [True, False])
@pytest.mark.parametrize("sample,block", [(20_000, 2048), (5, 7)])
def test_indexed_examples_equal_plain_loops(spark, monkeypatch, by_template, sample, block):
    monkeypatch.setattr(retrieval_index, "SAMPLE", sample)
    monkeypatch.setattr(retrieval_index, "BLOCK", block)
    rng = random.Random(3)
    near = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    vector = lambda: rng.choice([[round(v + rng.gauss(0, 0.1), 2) for v in rng.choice(near)]] * 6 + [[0.0] * 6, [1.0, -2.0], [3.0], []])
    rows = [(i, rng.choice([1, 1, 2, 3, None]), vector()) for i in range(160)]
    rows += [(200 + i, 1, list(rows[0][2])) for i in range(20)]  # ties
    queries = rows[::3]
    found, read = retrieval_index.top_examples_indexed(spark.createDataFrame(queries, VECTORS), spark.createDataFrame(rows, VECTORS), 4, by_template)
    assert sorted(map(tuple, found.select("query_id", "example_id", "score", "rank").collect())) == plain_top(queries, rows, 4, by_template)
    assert read.groupBy("query", "list").count().where("count > 1").isEmpty()


def test_most_lists_are_skipped_where_vectors_cluster(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 16))
    rows = [(i, 1, (centres[i % 30] + 0.05 * rng.standard_normal(16)).tolist()) for i in range(1200)]
    frame = spark.createDataFrame(rows, VECTORS)
    found, read = retrieval_index.top_examples_indexed(frame.where("id % 4 = 0"), frame, 3)
    lists = read.select("list").distinct().count()
    assert lists > 20 and read.count() < 0.2 * lists * 300
    assert found.count() == 900 and found.where("rank = 1 and query_id <> example_id").where("score < 1").isEmpty()


def test_no_cross_join_beyond_the_queries_that_tasks_hold(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 3)
    frame = spark.createDataFrame([(i, 1, [float(i), 1.0]) for i in range(20)], VECTORS)
    plan = retrieval.top_examples(frame, frame, 2)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert retrieval.top_examples(frame, frame, 2).where(F.col("rank") == 1).count() == 20


PAGE = "doc_id long, page long, aspect long, colour array<long>, density array<long>"
TEMPLATE = "template_id long, aspect long, colour array<long>, density array<long>"


def _signature(rng, near):
    density = [max(0, v + rng.randint(-300, 300)) for v in rng.choice(near)]
    return (rng.choice([None, 0, 7000, 7071, 14142, 9000]), rng.choice([None, [], [255, 255, 255], [250, 248, 240], [10, 20, 30]]), rng.choice([density] * 12 + [None, [], [0] * 64, [1, 2]]))


@pytest.mark.parametrize("angles", [False, True])
@pytest.mark.parametrize("sample,block", [(20_000, 2048), (9, 11)])
def test_templates_in_groups_win_as_in_pairs(spark, monkeypatch, angles, sample, block):
    monkeypatch.setattr(template_index, "SAMPLE", sample)
    monkeypatch.setattr(template_index, "BLOCK", block)
    rng = random.Random(6)
    near = [[rng.choice((0, 0, 3000, 10_000)) for _ in range(64)] for _ in range(9)]
    templates = [(i, *_signature(rng, near)) for i in range(150)]
    templates += [(300 + i, *templates[i][1:]) for i in range(20)] + [(None, *templates[0][1:])]  # ties
    pages = spark.createDataFrame([(i, i % 2, *_signature(rng, near)) for i in range(90)], PAGE)
    frame = spark.createDataFrame(templates, TEMPLATE)
    found, read = template_index.best_of_many_templates(pages, frame, angles)
    want = matching.best_template(matching.score_pairs(pages, frame.where("template_id is not null"), angles))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and want.count() > 60
    assert read.groupBy("doc_id", "page", "grp").count().where("count > 1").isEmpty()
    if not angles and sample > 9:
        assert read.count() < 0.7 * 90 * read.select("grp").distinct().count()
    assert not template_index.best_of_many_templates(pages.limit(0), frame, angles)[0].count() and not template_index.best_of_many_templates(pages, frame.limit(0), angles)[0].count()


def test_pairs_in_several_rounds(spark, monkeypatch):
    rng = random.Random(7)
    near = [[rng.choice((0, 5000)) for _ in range(64)] for _ in range(3)]
    pages = spark.createDataFrame([(i, 0, *_signature(rng, near)) for i in range(8)], PAGE)
    templates = spark.createDataFrame([(i, *_signature(rng, near)) for i in range(13)], TEMPLATE)
    once = sorted(map(tuple, matching.score_pairs(pages, templates, True).collect()))
    monkeypatch.setattr(matching, "MOST_TEMPLATES", 5)
    assert sorted(map(tuple, matching.score_pairs(pages, templates, True).collect())) == once and len(once) == 8 * 13 * 6
    plan = matching.best_of_templates(pages, templates, True)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_consensus_with_two_fifths_off(spark):
    rng, rows, want = random.Random(12), [], {}
    for doc in range(120):
        n = rng.choice((7, 8, 9, 10, 15, 25, 40))
        turn, scale = rng.uniform(-3, 3), rng.uniform(0.4, 3.5)
        a, b = float(scale * np.cos(turn)), float(scale * np.sin(turn))
        stretch = rng.choice((1.0, 1.0, 1.3))
        m = [[a, -b * stretch, rng.uniform(-500, 500)], [b, a * stretch, rng.uniform(-500, 500)]]
        want[doc] = (m, n - int(0.4 * n))
        off = set(rng.sample(range(n), int(0.4 * n)))
        for i in range(n):
            x, y = rng.uniform(0, 1000), rng.uniform(0, 1400)
            u, v = (m[k][0] * x + m[k][1] * y + m[k][2] for k in range(2))
            rows.append((doc, 0, x, y, u + (rng.uniform(200, 3000) if i in off else rng.uniform(-0.5, 0.5)), v - (rng.uniform(200, 3000) if i in off else 0.0)))
    rows += [(500, 0, 1.0, 2.0, 4.0, 7.0), (501, 0, 0.0, 0.0, 1.0, 1.0), (501, 0, 10.0, 0.0, 21.0, 1.0), (502, 0, 0.0, 0.0, 0.0, 0.0), (502, 0, 1.0, 1.0, 2.0, 2.0), (502, 0, 2.0, 2.0, 4.0, 4.0), (503, 0, 1.0, 1.0, 5.0, 5.0), (503, 0, 1.0, 1.0, 5.0, 5.0)]
    pairs = spark.createDataFrame(rows, "doc_id long, page long, src_x double, src_y double, dst_x double, dst_y double").repartition(3)
    got = {r.doc_id: r for r in transforms.consensus_fit(pairs).collect()}
    for doc, (m, n_in) in want.items():
        assert got[doc].kind == "affine" and got[doc].n_used >= n_in, (doc, got[doc])
        assert np.allclose([row[:2] for row in got[doc].matrix], [row[:2] for row in m], atol=0.02), doc
    assert (got[500].kind, got[500].matrix) == ("translation", [[1.0, 0.0, 3.0], [0.0, 1.0, 5.0]])
    assert got[501].kind == "similarity" and got[501].scale == pytest.approx(2) and got[502].kind == "similarity" and got[502].n_used == 3
    assert got[503].kind in ("none", "similarity") and got[503].n == 2
    assert not transforms.consensus_fit(pairs.limit(0)).count()


def test_consensus_tries_all_samples_of_large_pages(spark, tmp_path):
    """Pages of ten pairs and more end as in SQL, which compares all samples."""
    import duckdb

    rng, rows = random.Random(5), []
    for doc in range(150):
        turn = rng.choice((0.0, 0.5))
        for i in range(rng.choice((10, 11, 14))):
            x, y = float(rng.randrange(1000)), float(rng.randrange(1400))
            far = 0.0 if rng.random() < 0.3 else float(rng.randrange(3000))  # most pairs are off
            rows.append((doc, 0, i, x, y, 1.5 * x - turn * y + far, turn * x + 1.5 * y - far))
    frame = spark.createDataFrame(rows, "doc_id long, page long, i long, src_x double, src_y double, dst_x double, dst_y double")
    frame.write.parquet(f"{tmp_path}/points")
    sql = f"{transforms.consensus_sql(f'SELECT * FROM read_parquet(' + chr(39) + str(tmp_path) + '/points/*.parquet' + chr(39) + ')')} SELECT doc_id, n, n_used, kind FROM fitted"
    got = transforms.consensus_fit(frame.drop("i")).select("doc_id", "n", "n_used", "kind").collect()
    assert sorted(map(tuple, got)) == sorted(duckdb.sql(sql).fetchall())


def test_a_query_is_sent_to_bundles_of_lists(spark, monkeypatch):
    """However many lists a query reads, it is sent once to those that a task holds together."""
    rng = np.random.default_rng(4)
    frame = spark.createDataFrame([(i, i % 3, rng.standard_normal(8).tolist()) for i in range(1500)], VECTORS)
    sent, plain = [], retrieval_index._compared

    def counted(q, e, visits, *more):
        out = plain(q, e, visits, *more)
        sent.append((visits.count(), out.count()))
        return out

    monkeypatch.setattr(retrieval_index, "_compared", counted)
    for by_template in (False, True):
        sent.clear()
        found, read = retrieval_index.top_examples_indexed(frame, frame, 4, by_template)
        assert found.count() == 6000 and sent[1][0] > 10 * 1500
        assert sent[0][1] == 6000 and sent[1][1] <= 6000  # the best four of all lists that a query reads, not of each of them
