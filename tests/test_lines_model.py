"""Lines, labelled values, code values and their fusion against plain models, over random pages."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as tx
from foliospark.operators import answers, extract, lines, matching, transforms
from foliospark.plans import process
from foliospark.sources.providers import OfflineProvider

SCHEMA = "doc_id long, page long, word_no long, text string, conf long, x long, y long, w long, h long"
VOCABULARY = ["Nombre", "Nombre:", "DNI", "Fecha", "fecha:", "Nº", "Importe", "Total:", "a", "pagar", "Ref", "E-mail", "ciudad:", "x:y", ":", "12/03/1999", "1927", "12,5", "€", "María", "de", "la", "F.1", "M.4", "CL", "DE", "A", "---", "|", "..", "algunas", "palabras", "Ñu", "importe", "iban", "FIRMA:", "a.b", "P.1.2", "ZZZZ", "7"]


def random_words(seed, pages=60):
    rng = random.Random(seed)
    out = []
    for doc in range(pages):
        for n in range(rng.randint(0, 60)):
            t = rng.choice(VOCABULARY)
            out.append((doc, 0, n, t, rng.randint(0, 100), rng.randrange(0, 90_000, 1500), rng.randrange(0, 12_000, 300), 600 * len(t), 1500))
    return out


def split_lines(words, tolerance):
    out, start = [], None
    for w in sorted(words, key=lambda w: (w[6], w[5], w[7], w[8], w[4], w[3])):
        if start is None or abs(w[6] - start) >= tolerance:
            out.append([])
            start = w[6]
        out[-1].append(w)
    return out


def pages_of(words):
    pages = {}
    for w in words:
        pages.setdefault(w[0], []).append(w)
    return pages


def bare(t, keep=""):
    import unicodedata

    t = "".join(c for c in unicodedata.normalize("NFD", t.lower()) if unicodedata.category(c) != "Mn")
    return "".join(c for c in t if c.isalnum() or c in keep)


def free_key(base, used):
    key, n = base, 1
    while key in used:
        n += 1
        key = f"{base}_{n}"
    used.add(key)
    return key


def around(ws):
    x, y = min(w[5] for w in ws), min(w[6] for w in ws)
    return (x, y, max(w[5] + w[7] for w in ws) - x, max(w[6] + w[8] for w in ws) - y)


def joined(ws):
    return " ".join(w[3] for w in ws)


def key_of(label):
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", label.lower()) if unicodedata.category(c) != "Mn")
    return re.sub("[^a-z0-9]+", "_", plain).strip("_")[:30] or "campo"


def labelled(words):
    """key, name, value, label, rule and box of each value, in order."""
    found, used = [], set()
    for line in split_lines(words, 1000):
        if len(line) < 2:
            continue
        phrase = [tx.KEYWORDS.get(bare("".join(w[3] for w in line[:n]), ".:")) for n in (2, 3)] if len(line) > 2 else []
        for j in range(len(line) - 1):
            word = bare(line[j][3], ".:").rstrip(":")
            kind = tx.KEYWORDS.get(word) or (next((p for p in phrase if p), None) if j == 0 else None)
            if kind:
                found.append((free_key(kind, used), word[:1].upper() + word[1:], joined(line[j + 1 :]), joined(line[: j + 1]).rstrip(":").strip(), "keyword", around(line[j + 1 :])))
                break
        if found and found[-1][3] and joined(line).startswith(found[-1][3]):
            continue
        for j in range(len(line) - 1):
            label = joined(line[: j + 1]).rstrip(":").strip()
            if ":" in line[j][3] and len(label) >= 2:
                found.append((free_key(key_of(label), used), label[:50], joined(line[j + 1 :]), label, "colon", around(line[j + 1 :])))
                break
    return found


def coded(words):
    """key, name, value and box of each code value, in order."""
    is_code = lambda t: len(t) <= 6 and re.fullmatch(r"[A-Za-z]{1,3}(\.[A-Za-z0-9]{1,3}){0,3}", t) and t.upper() not in tx.STOPWORDS
    found, used = [], set()
    for line in split_lines(words, 1200):
        line = sorted(line, key=lambda w: (w[5], w[6], w[7], w[8], w[4], w[3]))
        for i, w in enumerate(line):
            if not is_code(w[3]):
                continue
            value = []
            for v in line[i + 1 :]:
                if is_code(v[3]) or re.fullmatch(r"[\s\-/_.|·•…¥*]+", v[3]) or len(value) == 8:
                    break
                value.append(v)
            text = joined(value)
            if not any(c.isalnum() for c in text) or sum(len(t) >= 3 and t[0].isalpha() and t == t.lower() for t in text.split()) >= 2:
                continue
            found.append((free_key(key_of(w[3].upper()), used), w[3].upper(), text[:120], around(value)))
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_and_values_of_random_pages(spark, seed):
    words = random_words(seed)
    df = spark.createDataFrame(words, SCHEMA)
    pages = pages_of(words)
    for tolerance in (1000, 1200):
        got = {(r.doc_id, r.line): [(w.x, w.y, w.text) for w in r.ws] for r in lines.group_lines(df, tolerance).collect()}
        assert got == {(d, i): [(w[5], w[6], w[3]) for w in line] for d, ws in pages.items() for i, line in enumerate(split_lines(ws, tolerance))}
    box = lambda b: (b.x, b.y, b.w, b.h)
    got = {}
    for r in sorted(lines.labelled_values(lines.group_lines(df)).collect(), key=lambda r: r.ordinal):
        got.setdefault(r.doc_id, []).append((r.key, r.name, r.sample_text, r.label_text, r.rule, box(r.box)))
    want = {d: found for d, ws in pages.items() if (found := labelled(ws))}
    assert got == want and {r[4] for f in want.values() for r in f} == {"keyword", "colon"}
    got = {}
    for r in sorted(lines.code_values(lines.group_lines(df, lines.TABLE_TOLERANCE)).collect(), key=lambda r: r.ordinal):
        got.setdefault(r.doc_id, []).append((r.key, r.name, r.sample_text, box(r.box)))
    want = {d: found for d, ws in pages.items() if (found := coded(ws))}
    assert got == want and any(k.endswith("_2") for f in want.values() for k, *_ in f)


def test_fusion_of_random_pages(spark):
    """Of the code values those stay that overlap by half with none before; taken keys get numbers."""
    words = random_words(3)
    got = {}
    for r in sorted(process.suggest_fields(spark.createDataFrame(words, SCHEMA)).collect(), key=lambda r: r.place):
        got.setdefault(r.doc_id, []).append((r.key, (r.box.x, r.box.y, r.box.w, r.box.h), r.origin))
        assert r.source in ("rules", "rules+table")

    def same(a, b):
        i = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        return i > 0 and i / (a[2] * a[3] + b[2] * b[3] - i) >= 0.5

    for d, ws in pages_of(words).items():
        out = [(k, b, 0) for k, *_, b in labelled(ws)]
        for k, *_, b in coded(ws):
            if not any(same(m[1], b) for m in out):
                out.append((free_key(k, {m[0] for m in out}), b, 1))
        assert got.get(d, []) == out


def test_values_of_random_regions(spark):
    rng, words = random.Random(4), random_words(5, 25)
    fields = [(t, f"k{n}", rng.randrange(60_000), rng.randrange(9000), rng.randrange(1000, 40_000), rng.randrange(300, 5000)) for t in range(3) for n in range(4)]
    df = spark.createDataFrame([(*w, w[0] % 4) for w in words], SCHEMA + ", template_id long")
    got = {(r.doc_id, r.key): r for r in extract.extract_fields(df, spark.createDataFrame(fields, "template_id long, key string, fx long, fy long, fw long, fh long")).collect()}
    pages = pages_of(words)
    assert set(got) == {(d, k) for d in pages for t, k, *_ in fields if t == d % 4}
    for t, k, fx, fy, fw, fh in fields:
        for d in (d for d in pages if d % 4 == t):
            px, py = max(0.08 * fw, 600), max(0.15 * fh, 1000)
            hits = [w for w in pages[d] if fx - px <= w[5] + w[7] / 2 <= fx + fw + px and fy - py <= w[6] + w[8] / 2 <= fy + fh + py]
            hits.sort(key=lambda w: (round(w[6] / 100_000, 2), w[5], w[2]))
            r = got[d, k]
            assert (r.value, r.n_words) == (joined(hits), len(hits))
            assert r.confidence == pytest.approx(sum(w[4] for w in hits) / len(hits) if hits else 0, abs=0.0501)
            assert ((r.x, r.y, r.w, r.h) == around(hits)) if hits else r.x is None


def test_best_templates_by_matrices_and_by_pairs(spark, monkeypatch):
    rng = random.Random(6)
    density = lambda: rng.choice([[rng.randrange(0, 10_001) for _ in range(64)], [0] * 64])
    colour = lambda: rng.choice([[rng.randrange(256) for _ in range(3)], []])
    pages = spark.createDataFrame([(i, 0, rng.choice([0, 7071, 14_142]), colour(), density()) for i in range(60)], "doc_id long, page long, aspect long, colour array<long>, density array<long>")
    templates = [(i, rng.choice([0, 7071, 9000]), colour(), density()) for i in range(12)]
    templates += [(i + 20, *t[1:]) for i, t in enumerate(templates[:4])]  # ties
    templates = spark.createDataFrame(templates, "template_id long, aspect long, colour array<long>, density array<long>")
    for angles in (False, True):
        direct = sorted(map(tuple, matching.best_of_templates(pages, templates, angles).collect()))
        assert direct == sorted(map(tuple, matching.best_template(matching.score_pairs(pages, templates, angles)).collect())) and len(direct) > 40
        with monkeypatch.context() as m:
            m.setattr(matching, "MOST_TEMPLATES", 3)
            assert direct == sorted(map(tuple, matching.best_of_templates(pages, templates, angles).collect()))
    assert not matching.best_of_templates(pages, templates.limit(0)).count() and not matching.best_of_templates(pages.limit(0), templates).count()


def test_fits_of_anchors(spark):
    points = [(0.0, 0.0), (100.0, 10.0), (20.0, 300.0), (250.0, 280.0), (130.0, 90.0), (40.0, 170.0)]
    affine = [(x, y, 2 * x + 0.1 * y + 5, 0.2 * x + 1.1 * y - 3) for x, y in points]
    rows = [(1, *p) for p in affine] + [(2, *p) for p in affine[:5]] + [(2, 40.0, 170.0, 900.0, -400.0)] + [(3, *affine[0])] + [(4, x, y, 0.5 * x - 3, 0.5 * y) for x, y in points[:2]]
    rows += [(5, x, y, 9 * x, 9 * y) for x, y in points] + [(6, 1.0, 1.0, 2.0, 2.0)] * 3 + [(7, x, y, -x, y) for x, y in points]
    df = spark.createDataFrame([(d, 0, *p) for d, *p in rows], "doc_id long, page long, src_x double, src_y double, dst_x double, dst_y double")
    got = {r.doc_id: r for r in transforms.fit_anchors(df).collect()}
    assert {d: r.kind for d, r in got.items()} == {1: "affine", 2: "affine", 3: "translation", 4: "similarity", 5: "none", 6: "none", 7: "none"}
    for d in (1, 2):
        assert [v for row in got[d].matrix for v in row] == pytest.approx([2, 0.1, 5, 0.2, 1.1, -3]) and got[d].residual == pytest.approx(0, abs=1e-9)
    assert (got[1].n_used, got[2].n, got[2].n_used) == (6, 6, 5)
    assert got[3].matrix[0][2] == 5 and got[4].scale == pytest.approx(0.5)
    assert not transforms.fit_anchors(df.limit(0)).count()


def test_failing_models_lose_no_page(spark):
    class Broken(OfflineProvider):
        def answer(self, prompts):
            raise RuntimeError("no model" * 100)

    words = spark.createDataFrame([(1, 0, 0, "Nombre", 50, 0, 0, 100, 100), (1, 0, 1, "Ana", 50, 200, 0, 100, 100)], SCHEMA)
    texts = spark.createDataFrame([(1, 0, 7, "Nombre Ana"), (2, 0, 7, None)], "doc_id long, page long, template long, text string")
    fields = spark.createDataFrame([(7, 0, "nombre", "Nombre")], "template long, ord int, key string, name string")
    none = spark.createDataFrame([], "id long, template long, text string, values map<string,string>")
    got = {r.doc_id: r for r in answers.extract_with_examples(texts, words, fields, none, Broken()).collect()}
    assert len(got) == 2 and got[1].value == "" and len(got[1].error) == 300 and got[1].box is None
    assert [(r.doc_id, r.kind, r.key, r.value) for r in answers.extract_free(texts, words, Broken()).collect()] == [(1, "detectado", "nombre", "Ana")]
    assert not answers.model_suggestions(words, Broken()).count()
    assert {r.source for r in process.suggest_fields(words, Broken()).collect()} == {"rules"}


def test_unmarked_letters(spark):
    import unicodedata

    every = [chr(i) for i in range(0x20, 0x250)] + list("ệờǖšőžйΐ") + ["é"]
    got = [r[0] for r in spark.createDataFrame([(i, c) for i, c in enumerate(every)], "i int, v string").orderBy("i").select(tx.unmarked(F.col("v"))).collect()]
    assert got == ["".join(c for c in unicodedata.normalize("NFD", v) if unicodedata.category(c) != "Mn") for v in every]


@pytest.mark.parametrize("by_template", [True, False])
def test_nearest_examples_in_tasks_and_by_joins(spark, monkeypatch, by_template):
    from foliospark.operators import retrieval

    rng = random.Random(8)
    vector = lambda: rng.choice([[rng.choice([-1.0, 0.0, 1.0, 0.5]) for _ in range(4)], [1.0, 2.0], []])
    table = lambda n: spark.createDataFrame([(i, rng.choice([1, 2, None]), vector()) for i in range(n)], "id long, template long, vector array<double>")
    queries, examples = table(25), table(90)
    direct = sorted(map(tuple, retrieval.top_examples(queries, examples, 3, by_template).collect()))
    monkeypatch.setattr(retrieval, "AT_ONCE", 7)
    assert direct == sorted(map(tuple, retrieval.top_examples(queries, examples, 3, by_template).collect()))
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 3)
    assert direct == sorted(map(tuple, retrieval.top_examples(queries, examples, 3, by_template).collect())) and len(direct) > 30
    assert not retrieval.top_examples(queries.limit(0), examples, 3, by_template).count() and not retrieval.top_examples(queries, examples.limit(0), 3, by_template).count()


def test_keys_of_one_list(spark):
    """Repeats are numbered; a key that stands as a base too takes the next free number, as when one key is chosen after another."""
    rng = random.Random(5)
    lists = [[], ["a"], ["a", "a", "a"], ["a_2", "a", "a"], ["a", "a", "a_2"], ["a", "a_2", "a_2", "a", "a_2_2"]] + [[rng.choice(["a", "a_2", "a_3", "b", "a_2_2", "ab"]) for _ in range(rng.randint(1, 12))] for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(lists)), "i long, bases array<string>")
    for r in df.withColumn("keys", lines.unique_keys(F.col("bases"))).collect():
        used = []
        for base in r.bases:
            used.append(free_key(base, set(used)))
        assert r["keys"] == used


def test_fused_keys_are_free(spark):
    """A second suggestion under a taken key gets the first free number, beside keys that stand for themselves."""
    rng = random.Random(6)
    row = lambda i, key, n: (i, 0, n, key, (9000 * n, 0, 500, 500))
    first, second = [], []
    for i in range(40):
        first += [row(i, rng.choice(["a", "b", "a_2"]), n) for n in range(rng.randint(0, 3))]
        second += [row(i, rng.choice(["a", "c", "a_2", "a_3", "b"]), 10 + n) for n in range(rng.randint(0, 5))]
    schema = "doc_id long, page long, ordinal long, key string, box struct<x:long,y:long,w:long,h:long>"
    got = {}
    for r in sorted(lines.merge_suggestions(spark.createDataFrame(first, schema), spark.createDataFrame(second, schema)).collect(), key=lambda r: r.place):
        got.setdefault(r.doc_id, []).append((r.key, r.origin))
    for i in range(40):
        out = [(key, 0) for d, _, _, key, _ in first if d == i]
        for d, _, _, key, _ in second:
            if d == i:
                out.append((free_key(key, {k for k, _ in out}), 1))
        assert got.get(i, []) == out


def test_words_with_line_breaks(spark):
    """Words of a line are normalised together; one that holds a line break itself doesn't move the others."""
    words = [(0, 0, n, t, 90, 8000 * n, 0, 3000, 1500) for n, t in enumerate(["Fe\ncha", "\n", "x", "DNI:", "1", "Σ\n"])]
    (r,) = lines.labelled_values(lines.group_lines(spark.createDataFrame(words, SCHEMA))).where("rule = 'keyword'").collect()
    assert (r.key, r.sample_text) == ("fecha", "\n x DNI: 1 Σ\n")


def test_lists_are_made_once(spark, sf):
    """No list of words is made for a filter, below the shuffle or anywhere, and no word is tested again for each word of its line."""
    from foliospark.plans import queries

    lined = lines.group_lines(queries.pages(spark, sf), lines.TABLE_TOLERANCE)
    for df in (queries.words(spark, sf), lined, lines.labelled_values(lined), lines.code_values(lined)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        made = [x for x in plan.splitlines() if re.match(r"[\s:+-]*Filter ", x) and re.search("lambdafunction|split\\(", x)]
        assert not made, made[0][:300]
    plan = lines.code_values(lined)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"filter\(sequence\([^()]*(\([^()]*\))?[^()]*\), lambdafunction\(transform", plan)
