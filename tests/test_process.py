"""The whole chain on moved, turned and incomplete pages."""

import json
import math

import pytest
from pyspark.sql import functions as F

from foliospark.operators.layout import words_from_text
from foliospark.plans.process import process_whole, rectify

SAMPLE = {"Invoice": (10_000, 10_000), "Date": (70_000, 12_000), "Total": (10_000, 80_000), "Signature": (65_000, 88_000)}
VALUES = {"Paid": (24_000, 80_000), "2024": (80_000, 12_000)}


def _words(doc, move, words, conf=90):
    out = []
    for n, (text, (x, y)) in enumerate(words.items()):
        w, h = 600 * len(text), 1500
        cx, cy, scale = move(x + w / 2, y + h / 2)
        out.append((doc, 0, n, text, conf, round(cx - w * scale / 2), round(cy - h * scale / 2), round(w * scale), round(h * scale)))
    return out


def turned(angle, scale, dx, dy):
    a, b = scale * math.cos(math.radians(angle)), scale * math.sin(math.radians(angle))
    return lambda x, y: (a * x - b * y + dx, b * x + a * y + dy, scale)


@pytest.fixture(scope="module")
def case(spark):
    rows = _words(1, turned(0, 1, 0, 0), SAMPLE | VALUES) + _words(2, turned(0, 1, 6000, -5000), SAMPLE | VALUES) + _words(3, turned(4, 0.9, 9000, 2000), SAMPLE | VALUES)
    rows += _words(4, turned(0, 1, 0, 0), {k: v for k, v in SAMPLE.items() if k != "Total"} | VALUES)  # a required anchor is missing
    rows += _words(5, turned(0, 1, 0, 0), {"Name:": (2_000, 2_000), "Ana": (10_000, 2_000)}) + _words(6, turned(0, 1, 0, 0), SAMPLE | VALUES, 10)
    words = spark.createDataFrame(rows, "doc_id long, page long, word_no long, text string, conf long, x long, y long, w long, h long")
    dense = [5000] * 64
    page = "doc_id long, page long, aspect long, colour array<long>, density array<long>"
    pages = spark.createDataFrame([(i, 0, 7071, [250, 250, 250], dense) for i in (1, 2, 3, 4, 6)] + [(5, 0, 20_000, [0, 0, 0], [0] * 63 + [9])], page)
    templates = spark.createDataFrame([(7, 7071, [250, 250, 250], dense)], "template_id long, aspect long, colour array<long>, density array<long>")
    fields = spark.createDataFrame([(7, 0, "status", "Status", 22_000, 79_000, 8_000, 4_000), (7, 1, "year", "Year", 79_000, 11_000, 6_000, 4_000)], "template_id long, ord long, key string, name string, fx long, fy long, fw long, fh long")
    box = lambda t: (SAMPLE[t][0], SAMPLE[t][1], 600 * len(t), 1500)
    anchors = spark.createDataFrame([(7, n, t, 1.0, t == "Total", box(t)) for n, t in enumerate(SAMPLE)], "template_id long, anchor_id long, anchor_text string, weight double, required boolean, source struct<x:long,y:long,w:long,h:long>")
    return words, pages, templates, fields, anchors


def test_words_move_into_the_frame_of_the_sample(case):
    words, _, _, _, anchors = case
    moved, told = rectify(words.where("doc_id < 5").withColumn("template_id", F.lit(7).cast("long")), anchors)
    told = {r.doc_id: r for r in told.collect()}
    assert {i: r.aligned for i, r in told.items()} == {1: True, 2: True, 3: True, 4: False} and told[3].angle == pytest.approx(-4, abs=0.2) and told[3].scale == pytest.approx(1 / 0.9, abs=0.01)
    for r in moved.where("doc_id < 4").collect():
        x, y = (SAMPLE | VALUES)[r.text]
        assert abs(r.x + r.w / 2 - x - 300 * len(r.text)) < 300 and abs(r.y + r.h / 2 - y - 750) < 300, r
    before = {(r.doc_id, r.word_no): (r.x, r.y, r.w, r.h) for r in words.where("doc_id = 4").collect()}
    assert before == {(r.doc_id, r.word_no): (r.x, r.y, r.w, r.h) for r in moved.where("doc_id = 4").collect()}


def test_the_whole_chain(spark, case):
    words, pages, templates, fields, anchors = case
    got = {r.doc_id: r for r in process_whole(words, pages, templates, fields, anchors).collect()}
    for i in (1, 2, 3):
        assert (got[i].template_id, got[i].aligned, got[i].data, got[i].status) == (7, True, {"status": "Paid", "year": "2024"}, "done"), got[i]
    assert not got[4].aligned and got[4].status == "review" and got[4].anchor_score == 0.75
    assert got[5].template_id is None and got[5].data == {} and got[5].status == "review" and got[5].aligned is None
    assert got[6].avg_confidence == 10 and got[6].status == "review"

    def again(weak):  # a better reading of what was read with little confidence
        return weak.select("doc_id", "page", "key", F.concat("value", F.lit("!")).alias("new_value"), F.lit(95.0).alias("new_confidence"))

    class Model:
        def embed(self, texts):
            return [[1.0, float(len(t))] for t in texts]

        def answer(self, prompts):
            return [json.dumps({"tipo_documento": "card", "datos": {"name": "Ana"}} if "kind of this document" in p else {"year": "1999", "status": ""}) for p in prompts]

    examples = spark.createDataFrame([(1, 7, "Invoice Paid", {"status": "Paid"})], "id long, template long, text string, values map<string,string>")
    got = {r.doc_id: r for r in process_whole(words, pages, templates, fields, anchors, again, Model(), examples).collect()}
    assert got[6].data == {"status": "Paid!", "year": "1999"} and got[6].status == "done"
    assert got[2].data == {"status": "Paid", "year": "1999"}
    assert got[5].data == {"_tipo_documento": "card", "name": "Ana"} and got[5].status == "done" and len(got) == 6


def test_pages_without_anchors_and_no_pages(spark, case):
    words, pages, templates, fields, anchors = case
    plain = {r.doc_id: r for r in process_whole(words, pages, templates, fields, anchors.limit(0)).collect()}
    assert plain[1].data == {"status": "Paid", "year": "2024"} and plain[1].status == "done" and plain[3].data["year"] == ""
    assert process_whole(words.limit(0), pages.limit(0), templates, fields, anchors).count() == 0
    assert words_from_text(spark.createDataFrame([], "doc_id long, text string")).count() == 0
