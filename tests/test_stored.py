"""What is stored: files in two phases, and changes applied to tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from foliospark.operators import change_feed
from foliospark.sources import image_sink
from foliospark.storage import scratch

ROWS = "key string, suffix string, content binary"


def _names(path):
    return sorted(os.listdir(path.removeprefix("file://")))


def test_files_read_back(spark):
    path = scratch(spark, "files")
    rows = [("a", "png", b"\x00\x01"), ("a", "png", b"again"), ("../odd/name", None, b""), (None, "tif", b"x" * 100_000), ("none", "png", None)]
    image_sink.write_files(spark.createDataFrame(rows, ROWS).repartition(3), path)
    got = image_sink.read_files(spark, path).collect()
    assert sorted((r.key or "", bytes(r.content)) for r in got) == sorted((k or "", c) for k, _, c in rows if c is not None)
    assert all(r.n_bytes == len(r.content) and r.file.endswith((".png", ".tif", ".bin")) for r in got)
    assert all(n.startswith("part-") for n in _names(path))
    image_sink.write_files(spark.createDataFrame([("b", "png", b"new")], ROWS), path)
    assert image_sink.references(spark, path).count() == 5
    image_sink.write_files(spark.createDataFrame([("c", "png", b"only")], ROWS), path, "overwrite")
    assert [r.key for r in image_sink.references(spark, path).collect()] == ["c"]
    image_sink.write_files(spark.createDataFrame([], ROWS), path)
    assert [bytes(r.content) for r in image_sink.read_files(spark, path).collect()] == [b"only"]


def test_a_failing_task_leaves_nothing(spark):
    path = scratch(spark, "files")
    image_sink.write_files(spark.createDataFrame([("first", "png", b"1")], ROWS), path)
    before = _names(path)

    @F.udf("binary")
    def broken(key):
        if key == "k37":
            raise ValueError("no such page")
        return key.encode()

    bad = spark.range(60).repartition(6).select(F.concat(F.lit("k"), "id").alias("key"), F.lit("png").alias("suffix")).withColumn("content", broken("key"))
    with pytest.raises(Exception, match="no such page"):
        image_sink.write_files(bad, path)
    assert _names(path) == before and [r.key for r in image_sink.references(spark, path).collect()] == ["first"]


def _plain(table, events):
    """Events applied one by one to a dictionary."""
    table = {k: list(v) for k, v in table.items()}
    for k, _, op, *values in sorted(events, key=lambda e: e[1]):
        if op == "insert":
            table[k] = list(values)
        elif op == "delete":
            table.pop(k, None)
        elif k in table:
            table[k] = [n if n is not None else o for o, n in zip(table[k], values)]
    return {k: tuple(v) for k, v in table.items()}


EVENTS = "k long, seq long, op string, a long, b string"


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_equal_events_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows = {k: (rng.randrange(100), rng.choice(["x", "y", None])) for k in range(0, 60, 2)}
    start = spark.createDataFrame([(k, *v) for k, v in rows.items()], "k long, a long, b string")
    table = change_feed.StoredTable(spark, scratch(spark, "table"), start.schema, "k", 16).create(start)
    for n in range(3):
        events = [(rng.randrange(70) if n else 4, 1000 * n + i, rng.choice(["insert", "update", "update", "update", "delete"]), rng.choice([None, rng.randrange(100)]), rng.choice([None, "new", "z"])) for i in range(120)]
        odd = [(None, 1, "insert", 1, "x"), (3, None, "insert", 1, "x"), (3, 5, "other", 1, "x")]
        table.apply(spark.createDataFrame(rng.sample(events, len(events)) + odd, EVENTS))
        rows = _plain(rows, events)
        assert {r.k: (r.a, r.b) for r in table.read().collect()} == rows and table.read().count() == len(rows)


def test_untouched_partitions_stay(spark):
    start = spark.range(200).select(F.col("id").alias("k"), F.col("id").alias("a"), F.lit("x").alias("b"))
    table = change_feed.StoredTable(spark, scratch(spark, "table"), start.schema, "k", 16).create(start)

    def listed():
        root = table.path.removeprefix("file://")
        return {p: _names(f"{root}/{p}") for p in _names(root) if p.startswith("_bucket")}

    before = listed()
    touched = table.apply(spark.createDataFrame([(7, 1, "update", 70, None), (8, 2, "delete", None, None)], EVENTS))
    after = listed()
    assert len(touched) <= 2 and {p for p in before if before[p] != after.get(p)} == {f"_bucket={b}" for b in touched}
    assert table.read().where("k = 7").first() == (7, 70, "x") and table.read().count() == 199
    gone = [r.k for r in table._stored().where(F.col("_bucket") == touched[0]).collect()]
    table.apply(spark.createDataFrame([(k, i, "delete", None, None) for i, k in enumerate(gone)], EVENTS))
    assert f"_bucket={touched[0]}" not in listed() and table.read().count() == 199 - len(gone)
    assert table.apply(spark.createDataFrame([], EVENTS)) == []
    table.reset()
    assert table.read().count() == 0 and table.read().dtypes == start.dtypes
    table.apply(spark.createDataFrame([(1, 1, "insert", 5, "new")], EVENTS))
    assert table.read().collect() == [(1, 5, "new")]
