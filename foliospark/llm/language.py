"""Language identification with string kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast, is_held_out

#: Documents of each language that the regression learns from; the first LANDMARKS of them are landmarks too, fewer where there would be
#: over MOST_LANDMARKS of all languages (but one of each), so that the dense matrix of landmarks by n-grams stays at a few hundred MB.
FIT_ROWS, LANDMARKS, MOST_LANDMARKS = 400, 50, 400
#: Documents of all languages together that are learned from (but one of each): with FIT_BYTES at most 250 MB go to the driver, however many languages there are.
MOST_ROWS = 4000
#: Longer documents are not used to learn from; every document is scored whole.
FIT_BYTES = 1 << 16
#: The spectrum: n-grams of 1 to 4 bytes of UTF-8.
LENGTHS = (1, 2, 3, 4)
RIDGE = 1e-2
#: Documents and bytes whose presence matrix is made at a time.
ROWS, BYTES = 64, 1 << 20
#: A filter keeps documents with at least this score.
THRESHOLD = 0.3
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_HASH = np.uint64(0x9E3779B97F4A7C15)


def _grams(raw: np.ndarray, n: int) -> np.ndarray:
    """The n-gram that starts at each byte, tagged with its length."""
    m = len(raw) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    g = raw[:m].astype(np.uint64)
    for k in range(1, n):
        g = g << np.uint64(8) | raw[k : m + k].astype(np.uint64)
    return g | np.uint64(n << 32)


class KernelLanguages:
    """One-versus-rest kernel ridge regression over a presence kernel.

    k(x, z) counts the n-grams present in both x and z, over the square root of the
    product of the n-grams present in each. Nyström: the n-grams are those of the
    landmark documents, and the regression works in the space that the landmarks span.
    Its weights, taken back through the landmarks' presence matrix, are one
    matrix of n-grams by languages, so a batch is scored by a single product with
    its presence matrix.
    """

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.langs = sorted(set(langs))
        if not self.langs:
            return
        seen: dict[str, int] = {}
        marks, most = [], max(1, min(LANDMARKS, MOST_LANDMARKS // len(self.langs)))
        for t, lang in zip(texts, langs):
            if seen.setdefault(lang, 0) < most:
                marks.append(t)
                seen[lang] += 1
        own = [np.unique(np.concatenate([_grams(_LOWER[np.frombuffer(t, np.uint8)], n) for n in LENGTHS])) for t in marks]
        grams, docs = np.unique(np.concatenate([*own, np.zeros(0, np.uint64)]), return_counts=True)
        self.grams = grams[docs >= min(2, len(marks))]
        if not len(self.grams):
            self.langs = []
            return
        self._index()
        y = np.where(np.array(langs)[:, None] == np.array(self.langs)[None], 1.0, -1.0)
        z = np.vstack([p for p in self._normal(marks)])
        kmm, knm = z @ z.T, np.vstack([p @ z.T for p in self._normal(texts)])
        values, vectors = np.linalg.eigh(kmm.astype(float))
        good = values > 1e-8 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])  # landmarks to the space that they span
        phi = knm @ root
        weight = np.sqrt(1 / np.maximum(1, (y > 0).sum(0)))[np.argmax(y, 1)][:, None]  # languages count alike
        beta = np.linalg.solve((phi * weight**2).T @ phi + RIDGE * np.eye(phi.shape[1]), (phi * weight**2).T @ y)
        self.matrix = (z.T @ (root @ beta)).astype(np.float32)

    def _index(self) -> None:
        """An open table of the n-grams; a slot holds the number of an n-gram."""
        bits = int(np.ceil(np.log2(len(self.grams)))) + 3
        self.shift = np.uint64(64 - bits)
        self.slot = np.full(1 << bits, -1, np.int32)
        for i, s in enumerate(((self.grams * _HASH) >> self.shift).tolist()):
            while self.slot[s] >= 0:
                s = (s + 1) & ((1 << bits) - 1)
            self.slot[s] = i
        self.key = np.where(self.slot >= 0, self.grams[self.slot], np.uint64(0))

    def _find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of known n-grams in g, and their numbers."""
        s = ((g * _HASH) >> self.shift).astype(np.int64)
        key = self.key[s]
        hit = key == g
        at, num = [np.flatnonzero(hit)], [self.slot[s[hit]]]
        rest = np.flatnonzero(~hit & (key != 0))
        while len(rest):
            s[rest] = (s[rest] + 1) & (len(self.slot) - 1)
            key = self.key[s[rest]]
            hit = key == g[rest]
            at.append(rest[hit])
            num.append(self.slot[s[rest[hit]]])
            rest = rest[~hit & (key != 0)]
        return np.concatenate(at), np.concatenate(num)

    def _presence(self, texts: list) -> np.ndarray:
        p = np.zeros((len(texts), len(self.grams)), np.float32)
        raw = _LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        end = np.cumsum([len(t) for t in texts])
        for begin in range(0, len(raw), BYTES):  # a longer text than that is looked up piece by piece
            for n in LENGTHS:
                at, num = self._find(_grams(raw[begin : begin + BYTES + n - 1], n))
                at += begin
                doc = np.searchsorted(end, at, side="right")
                whole = at + n <= end[doc]
                p[doc[whole], num[whole]] = 1
        return p

    def _batches(self, texts: list) -> Iterator[list]:
        held, size = [], 0
        for t in texts:
            if held and (len(held) == ROWS or size + len(t) > BYTES):
                yield held
                held, size = [], 0
            held.append(t)
            size += len(t)
        if held:
            yield held

    def _normal(self, texts: list) -> Iterator[np.ndarray]:
        for part in self._batches(texts):
            p = self._presence(part)
            yield p / np.sqrt(np.maximum(1, p.sum(1)))[:, None]

    def predict(self, texts: list) -> tuple[list, np.ndarray]:
        """The best language of each text and its score, 0 to 1."""
        if not texts or not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        f = np.vstack([p @ self.matrix for p in self._normal(texts)])
        best = f.argmax(1)
        return [self.langs[i] for i in best], np.clip((f[np.arange(len(f)), best].astype(float) + 1) / 2, 0, 1)


def fit(docs: DataFrame) -> KernelLanguages:
    """Learn from FIT_ROWS documents of each language, fewer where there would be over MOST_ROWS in all, chosen by a hash of doc_id, none of them held out."""
    named = docs.select("doc_id", "text", "lang").where("doc_id is not null and lang is not null and text rlike '\\\\p{L}'").where(~is_held_out(F.col("doc_id"))).where(F.octet_length("text") <= FIT_BYTES)
    of_each = named.groupBy("lang").count().collect()  # a row a language
    most = max(1, min(FIT_ROWS, MOST_ROWS // max(1, len(of_each))))
    counts = docs.sparkSession.createDataFrame([(r["lang"], r["count"]) for r in of_each], "l string, n long")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    some = named.join(F.broadcast(counts), F.col("lang") == F.col("l")).where(draw * F.col("n") < F.lit(3 * most << 30))
    first = Window.partitionBy("lang").orderBy(draw, "doc_id", "text")
    rows = some.withColumn("place", F.row_number().over(first)).where(F.col("place") <= most).select("lang", "text", "place").orderBy("place", "lang").collect()
    return KernelLanguages([r.text.encode() for r in rows], [r.lang for r in rows])


def identify_language(docs: DataFrame, model: KernelLanguages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predict the language of every whole text: doc_id, held_out, lang_pred, score (0 to 1).

    A text that is null or has no letter is ``und`` with score 0. A null identifier is
    never held out. Repeated rows get one prediction each, ties go to the first
    language in alphabetical order, other columns are not read and an empty table
    gives an empty result. With nothing to learn from every text is ``und``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)).alias("letter"))
    shared = broadcast(docs, model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = _predict(shared.value, batch.column(2), batch.column(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(predicted, "doc_id long, held_out boolean, lang_pred string, score double")


def _predict(model: KernelLanguages, texts: pa.Array, letter: pa.Array) -> tuple[list, np.ndarray]:
    has = np.array(letter.to_pylist(), bool)
    raw = [x.as_buffer() for x in texts.filter(pa.array(has)).cast(pa.binary())]
    lang, score = ["und"] * len(has), np.zeros(len(has))
    found, f = model.predict(raw)
    score[has] = f
    for i, x in zip(np.flatnonzero(has), found):
        lang[i] = x
    return lang, score


def drop_unknown_language(docs: DataFrame, model: KernelLanguages) -> DataFrame:
    """The rows of ``docs`` in a learned language with a score of THRESHOLD or more, with all their columns, whatever these are called.

    A text that is null or has no letter goes. Repeated rows stay or go together; an empty table gives an empty result.
    """
    shared = broadcast(docs, model)
    names = docs.columns
    at = names.index("text")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letter"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = _predict(shared.value, batch.column(at), batch.column(batch.num_columns - 1))
            keep = pa.array((np.array(lang, object) != "und") & (score >= THRESHOLD))
            part = batch.filter(keep)
            yield pa.RecordBatch.from_arrays(part.columns[:-1], names=names)

    return rows.mapInArrow(kept, docs.schema)
