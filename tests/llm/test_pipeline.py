"""The pipeline against the same decisions made by plain Python."""

from pyspark.sql import functions as F

from foliospark.llm import language, quality
from foliospark.llm.common import table

from test_operators import check_packing, components, shingles


def test_pipeline_brute_force(spark, sf):
    import corpus_pipeline

    docs = table(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality.score_quality(docs, quality.fit(docs, table(spark, sf, "labels"))).where("predicted = 1").collect()}
    known = {r.doc_id for r in language.identify_language(docs, language.fit(docs)).where(f"lang_pred <> 'und' and score >= {language.THRESHOLD}").collect()}
    groups = {}
    for i in sorted(good & known, key=lambda i: (-len(texts[i]), i)):
        groups.setdefault("".join(c for c in texts[i] if c not in " \t\n\v\f\r"), i)
    left = sorted(groups.values())
    sets = {i: shingles(texts[i]) for i in left}
    near = components(left, [(a, b) for a in left for b in left if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    check_packing([(i, texts[i]) for i in left if near[i] == i], [r.asDict() for r in corpus_pipeline.run(spark, sf).collect()])


def test_stages_keep_the_columns_of_documents(spark, sf):
    import corpus_pipeline

    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


ROWS = [
    (None, None), (None, None), (1, None), (2, ""), (3, " \t\n"), (4, "a"), (4, "a"), (None, "quite alone"), (None, "the same words again and again"), (None, "the same words again and again"),
    (7, "The house on the hill is old and the river runs below it."), (8, "The house on  the hill is old and the river runs below it."), (8, "The house on the hill is old and the river runs below it, still."),
    (9, "word " * 60_000), (10, "x" * 200_000), (11, "é ß Σ 한국어 \U0001f600"), (12, "The house on the hill is old and the river runs below it."),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_with_odd_rows(spark, sf):
    """Nulls in any column, empty and very long texts, repeated rows and columns with clashing names."""
    import corpus_pipeline

    known = dict(corpus_pipeline.STAGES)
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in ROWS], SCHEMA)
    clash = df
    for name in ("sig", "size", "norm", "sha", "payload", "kept", "mark", "root", "place", "letter", "score", "component_id", "hot", "salt", "kept_id", "kept_mark"):
        clash = clash.withColumn(name, F.lit("x"))
    rows = lambda d: sorted(((r.doc_id, r.text) for r in d.collect()), key=repr)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for some in (df, clash):
            out = stage(spark, some, sf)
            assert out.columns == some.columns
            kept = rows(out)
            assert all(r in ROWS for r in kept)
            if name == "quality":
                model = quality.fit(table(spark, sf, "documents"), table(spark, sf, "labels"))
                assert kept == sorted(((r.doc_id, r.text) for r, s in zip(df.collect(), model.scores([(t or "").encode() for _, t in ROWS])) if s >= quality.THRESHOLD), key=repr)
            elif name == "language":
                assert all(any(c.isalpha() for c in t or "") for _, t in kept) and len(kept) >= 6
            elif name == "exact_dedup":
                norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\v\f\r")
                assert len(kept) == len({norm(t) for _, t in ROWS}) == len({norm(t) for _, t in kept})
                assert (7, ROWS[10][1]) not in kept and (8, ROWS[11][1]) in kept  # the longest stays
            else:
                assert [r for r in kept if not (r[1] or "").split()] == sorted([r for r in ROWS if not (r[1] or "").split()], key=repr)
                assert kept.count((4, "a")) == 1 and kept.count((None, ROWS[8][1])) == 1 and (None, "quite alone") in kept
                assert [r for r in kept if (r[1] or "").startswith("The house")] == [(7, ROWS[10][1]), (8, ROWS[12][1])]
        empty = stage(spark, clash.limit(0), sf)
        assert empty.columns == clash.columns and not empty.count()
    packed = known["packing"](spark, clash, sf)
    check_packing(ROWS, [r.asDict() for r in packed.collect()])
    assert not known["packing"](spark, clash.limit(0), sf).count()


def test_language_of_a_very_long_text(monkeypatch):
    """A text is looked up piece by piece, n-grams across pieces included, so that a very long one takes memory for a piece."""
    import tracemalloc

    import numpy as np

    texts = [(w * 40).encode() for w in ("the house on the hill ", "das Haus auf dem Berg ", "la maison sur la colline ", "the river and the boat ", "der Fluss und das Boot ", "le fleuve et le bateau ")]
    model = language.KernelLanguages(texts, ["en", "de", "fr"] * 2)
    want = model._presence(texts)
    tracemalloc.start()
    found, _ = model.predict([b"das Boot und der Berg " * 1_000_000])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == ["de"] and most < 200e6
    for size in (1, 7, 1000):
        monkeypatch.setattr(language, "BYTES", size)
        assert np.array_equal(model._presence(texts), want)
