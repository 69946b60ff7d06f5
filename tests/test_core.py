"""The core queries against SQL, and small cases with known values."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from foliospark.functions import sequences, text
from foliospark.functions.geometry import same_region
from foliospark.operators import lines, matching, records
from foliospark.plans import queries
from foliospark.sources import files, providers

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sorted_rows(names, rows):
    at = [names.index(c) for c in sorted(names)]
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = queries.QUERIES[name](spark, sf), duck.execute(queries.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = [tuple(r.asDict(True) if hasattr(r, "asDict") else r for r in row) for row in got.collect()]
    assert sorted_rows(got.columns, rows) == sorted_rows(names, want.fetchall())


def test_entry_can_be_imported_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True, timeout=300)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Some

    from foliospark import storage

    conf = Some(get=lambda *_: None)
    with pytest.raises(ValueError):
        storage.shared_dir(Some(conf=conf, sparkContext=Some(master="spark://host:7077", getConf=lambda: conf)))


def test_back_end_of_a_configuration():
    from foliospark.config import EngineConfig, generation_backend

    assert generation_backend(EngineConfig()) == ("local", "http://localhost", {})
    assert generation_backend(EngineConfig(remote_url="http://r/", remote_key="k")) == ("remote", "http://r", {"Authorization": "Bearer k"})
    hosted = EngineConfig(hosted_enabled=True, hosted_key="h", hosted_url="http://h/", remote_url="http://r")
    assert generation_backend(hosted)[:2] == ("hosted", "http://h") and generation_backend(EngineConfig(hosted_enabled=True, remote_url="http://r"))[0] == "remote"


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, v string").orderBy("i").select(column).collect()]


def test_types_of_values(spark):
    known = {
        "a@b.es": "email", "27/05/2021": "date", "12.05.21": "date", "2021-05-27": "phone", "12345678Z": "dni", "12345678": "phone", "600 123 456": "phone", "1.234.567": "phone",
        "1.234,56 €": "currency", "€ 12": "currency", "1.234,56": "number", "1998": "number", "Juan Pérez": "text", "": "text",
    }
    assert values(spark, list(known), text.guess_type(F.col("v"))) == list(known.values())


def test_names_and_matrices_leave_no_row_out(spark, sf, duck):
    q, name = queries.QUERIES, lambda v: spark.createDataFrame([(v,)], "v string").select(text.label_to_name(F.col("v"))).first()[0]
    assert q["label_to_name_all"](spark, sf).count() == q["name_to_key"](spark, sf).count() == duck.execute(f"WITH {queries.VALUES_SQL} SELECT count(*) FROM vals WHERE v IS NOT NULL").fetchone()[0]
    assert name("ßa_ßb") == "SSa SSb"
    assert q["affine_params_all"](spark, sf).count() == duck.execute("SELECT count(*) FROM lineitem").fetchone()[0]


def test_keys_of_names(spark):
    assert values(spark, ["Fecha de emisión", "***", "a" * 40], text.name_to_key(F.col("v"))) == ["fecha_de_emision", "campo", "a" * 30]


def test_sequence_ratio_depends_on_the_order(spark):
    pair = spark.createDataFrame([("tide", "diet"), (None, "x")], "a string, b string")
    assert pair.select(sequences.sequence_ratio(F.col("a"), F.col("b")), sequences.sequence_ratio(F.col("b"), F.col("a"))).collect() == [(0.25, 0.5), (None, None)]


def test_best_window_ties_go_to_the_smaller_size():
    assert sequences.best_window("total", ["a", "total", "total"], [0, 0, 0], [1, 2], " ", None, True) == (1.0, 1, 1)
    assert sequences.best_window("total", [], [], [1], " ", None, True) == (0.0, 0, 0)


def words(spark, rows):
    return spark.createDataFrame([(1, 0, i, t, 90, x, y, 100, 100) for i, (t, x, y) in enumerate(rows)], "doc_id long, page long, word_no long, text string, conf long, x long, y long, w long, h long")


def test_lines_are_measured_from_their_first_word(spark):
    got = lines.group_lines(words(spark, [("a", 0, 10_000), ("b", 0, 10_600), ("c", 0, 11_200), ("d", 0, 11_800)])).collect()
    assert sorted((r["line"], [w["text"] for w in r["ws"]]) for r in got) == [(0, ["a", "b"]), (1, ["c", "d"])]


@pytest.mark.parametrize(("line", "want"), [("F.1 1927 M.4 655", [("f_1", "1927", "number"), ("m_4", "655", "number")]), ("A DE", []), ("G --- 12", []), ("E 12", [])])
def test_codes_and_values(spark, line, want):
    page = lines.group_lines(words(spark, [(t, 1000 * i, 5000) for i, t in enumerate(line.split())]), lines.TABLE_TOLERANCE)
    assert [(r["key"], r["sample_text"], r["data_type"]) for r in lines.code_values(page).orderBy("ordinal").collect()] == want


def test_templates_of_any_number_have_fields(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(400))
    for i in (602, 700_000):
        spark.createDataFrame([(i, text)], "doc_id long, text string").write.mode("append").parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([(i, text)], "item_id long, text string").write.mode("append").parquet(f"{tmp_path}/benchmark.parquet")
    got = [r for r in queries.QUERIES["process_pages"](spark, str(tmp_path)).collect() if r["page"] == 0]
    assert {r["doc_id"]: r["template_id"] for r in got} == {602: 602, 700_000: 700_000}
    assert {r["doc_id"]: {x.partition("=")[0] for x in r["data"].split("; ")} for r in got} == {602: {"date"}, 700_000: {"name", "code"}}


def test_combined_and_accepted_scores(spark):
    one = spark.range(1)
    assert one.select(matching.combined(F.lit(0.6), F.lit(0.0)), matching.combined(F.lit(0.6), F.lit(1.0))).first() == (0.6, 0.84)
    cases = [(0.84, 0.0, False), (0.85, 0.0, True), (0.56, 0.06, True), (0.54, 0.06, False), (0.84, 0.05, False)]
    got = spark.createDataFrame([c[:2] for c in cases], "s double, v double").select(matching.accepted(F.col("s"), F.col("v"))).collect()
    assert [r[0] for r in got] == [c[2] for c in cases]


def test_rotated_grid(spark):
    grid = spark.range(1).select(F.array(*[F.lit(float(i)) for i in range(64)]).alias("d"))
    a, b, c = grid.select(*[matching.rotated(F.col("d"), k) for k in (1, 2, 3)]).first()
    assert (a[0], a[7], b[0], c[0], c[7]) == (7, 63, 63, 56, 0)


def test_regions_are_the_same_from_half_their_union(spark):
    box = lambda x, w: F.struct(F.lit(x).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(w).cast("long").alias("w"), F.lit(20_000).cast("long").alias("h"))
    assert spark.range(1).select(same_region(box(0, 20_000), box(10_000, 20_000)), same_region(box(0, 20_000), box(5_000, 20_000))).first() == (False, True)


def test_new_rows_get_the_next_identifiers(spark):
    table = spark.createDataFrame([(3, "a")], "id long, name string")
    new = spark.createDataFrame([("c",), ("b",)], "name string")
    assert sorted(map(tuple, records.append_with_ids(table, new, ["name"]).collect())) == [(3, "a"), (4, "b"), (5, "c")]


def test_files_are_told_apart_by_suffix_and_magic(spark, tmp_path):
    for name, content in (("a.png", b"\x89PNG"), ("b.png", b"%PDF-1"), ("c.pdf", b"x"), ("d.txt", b"x"), ("e.png", b"")):
        (tmp_path / name).write_bytes(content)
    found = files.binary_files(spark, f"file://{tmp_path}")
    assert sorted((r["path"][-5:], r["kind"]) for r in found.collect()) == [("a.png", "image"), ("b.png", "pdf"), ("c.pdf", "pdf")]
    assert [r["path"][-5:] for r in files.rejected(found).collect()] == ["c.pdf"]


def test_failed_answers_keep_their_rows(spark):
    class Failing(providers.OfflineProvider):
        def answer(self, prompts):
            raise ValueError("no model")

    asked = spark.createDataFrame([("p",), (None,)], "prompt string")
    got = {r["prompt"]: (r["answer"], r["error"]) for r in providers.answer(asked, Failing()).collect()}
    assert got == {"p": (None, "no model"), None: (None, None)}


def test_free_answers_are_one_value_and_the_last_of_repeated_keys_counts(spark):
    from foliospark.operators.answers import free_answer, suggested

    unknown = ("desconocido", {})
    cases = {
        '{"tipo_documento":"a","tipo_documento":"b","datos":{"k":1},"datos":{"k":"x","k":2,"l":"0","m":0,"n":null}}': ("b", {"k": "2", "l": "0", "m": "", "n": ""}),
        '{"tipo_documento":"a"} and more': unknown, '{"tipo_documento":"a"}{"datos":{}}': unknown, '{"tipo_documento":"a"}]': unknown, '{"tipo_documento":"a"}}': unknown, '{"tipo_documento":"a"},{"b":1}': unknown,
        ' {"tipo_documento":"a","datos":{"o":{"x":1,"x":2},"k":3}} ': ("a", {"o": '{"x":1,"x":2}', "k": "3"}), "[1]": unknown, "": unknown, "x": unknown, '{"datos":[1]}': unknown, '```json\n{"tipo_documento":"f"}\n```': ("f", {}),
    }
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cases)] + [(99, None)], "i int, c string").select("i", free_answer(F.col("c")).alias("f"), F.size(suggested(F.col("c"))).alias("n")).orderBy("i").collect()
    assert [(r.f.kind, r.f.data) for r in got] == [*cases.values(), unknown] and {r.n for r in got} == {0}
    assert spark.sql("select '[{\"label\":\"a\",\"value\":\"b\"}] tail' as c").select(F.size(suggested(F.col("c")))).first()[0] == 0
