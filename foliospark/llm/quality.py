"""Quality classifier by compression against dictionaries of good and bad text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast, is_held_out

#: Labelled documents of each class in either half; each half builds dictionaries that the other half is measured with.
FIT_ROWS = 1500
#: Longer documents are not used to fit, so at most 2 * FIT_ROWS * FIT_BYTES (98 MB) of a class go to the driver; every document is scored whole.
FIT_BYTES = 1 << 15
DICTIONARY_BYTES = 112_640
LEVEL = 3
#: A text is compressed in pieces of so many bytes, so that the dictionary counts all along a long text.
PIECE = 512
THRESHOLD = 0.3
#: The score when a class has no labelled example.
UNKNOWN = 0.5


class CompressionClassifier:
    """Pairs of dictionaries, and the curve that turns the difference of compressed sizes into a score.

    The difference is normalised by the text's length: bytes saved a byte. It alone decides. Labelled texts are
    dealt into halves, each of which builds a dictionary of good and one of bad texts, and is measured with the other half's. The
    curve is the isotonic regression of the labels on these differences: it rises with the difference, which for other texts is the mean over both pairs of dictionaries. Texts without
    any difference, most of them too short to be compressed, have the share of good ones among such texts.
    """

    def __init__(self, good: list[bytes], bad: list[bytes]):
        self.fitted = bool(good and bad)
        if not self.fitted:
            return
        halves = [(good[::2], bad[::2]), (good[1::2] or good, bad[1::2] or bad)]
        self.dictionaries = [[_dictionary(texts) for texts in half] for half in halves]
        x = np.array([self.differences(t)[1 - k] for k, half in enumerate(halves) for texts in half for t in texts])
        y = np.concatenate([np.repeat([1.0, 0.0], [len(g), len(b)]) for g, b in halves])
        some = x != 0
        self.even = (y[~some].sum() + 2 * y.mean()) / ((~some).sum() + 2)  # two examples at the share of all, should there be none
        self.at, self.share = _isotonic(x[some], y[some]) if some.any() else (np.zeros(1), np.full(1, y.mean()))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_compressors"}

    def differences(self, text) -> list[float]:
        """For each pair of dictionaries how many bytes less that of good texts takes, for each byte of the text."""
        if "_compressors" not in self.__dict__:
            self._compressors = [[_compressor(d) for d in pair] for pair in self.dictionaries]
        view, out = memoryview(text), []
        for good, bad in self._compressors:
            saved = 0
            for i in range(0, len(view), PIECE):
                piece = view[i : i + PIECE]
                saved += len(bad.compress(piece)) - len(good.compress(piece))
            out.append(saved / max(1, len(view)))
        return out

    def scores(self, texts: list) -> np.ndarray:
        if not self.fitted:
            return np.full(len(texts), UNKNOWN)
        x = np.array([sum(self.differences(t)) / 2 for t in texts], float)
        return np.where(x == 0, self.even, np.interp(x, self.at, self.share))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    z = zstandard.ZstdCompressionDict(dictionary)
    z.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=z, write_content_size=False, write_checksum=False, write_dict_id=False)


def _dictionary(texts: list[bytes]) -> bytes:
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)] or [b" "]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too few examples to choose from: all of them are the dictionary
        return b"".join(pieces)[-DICTIONARY_BYTES:].rjust(8, b" ")


def _isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rising curve of shares of ones, by pooling neighbours that fall; each pool counts half a one and half a zero more, so that no share is 0 or 1."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of x, ones, size
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        pools.append([a, b, 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last)]
    at, ones, size = np.array(pools).T
    return at / size, np.maximum.accumulate((ones + 0.5) / (size + 1))


def fit(docs: DataFrame, labels: DataFrame) -> CompressionClassifier:
    """Fit on at most 2 * FIT_ROWS labelled documents of each class, the first by a hash of doc_id, none of them held out."""
    named = labels.select(F.col("doc_id").alias("i"), "quality").where("i is not null and quality in (0, 1)").where(~is_held_out(F.col("i"))).distinct()
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    for q in texts:
        chosen = named.where(F.col("quality") == q).orderBy(F.xxhash64("i"), "i").limit(2 * FIT_ROWS)
        rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("i")).where(F.col("text").isNotNull() & (F.octet_length("text") <= FIT_BYTES))
        one = rows.groupBy("doc_id").agg(F.min("text").alias("text"))  # a repeated identifier counts once
        texts[q] = [r.text.encode() for r in one.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    return CompressionClassifier(texts[1], texts[0])


def score_quality(docs: DataFrame, model: CompressionClassifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: doc_id, held_out, score (0 to 1) and predicted (score >= THRESHOLD).

    A null text counts as empty; an empty text gets the score of texts without a difference.
    A null identifier is scored and never held out. Repeated rows get one score each;
    other columns are not read; an empty table gives an empty result. Without labelled
    examples of both classes every score is UNKNOWN.
    """
    shared = broadcast(docs, model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.scores([x.as_buffer() or b"" for x in batch.column(2).cast(pa.binary()).fill_null(b"")])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def drop_low_quality(docs: DataFrame, model: CompressionClassifier) -> DataFrame:
    """The rows of ``docs`` whose score reaches THRESHOLD, with all their columns, whatever these are called.

    A null text is scored as an empty one. Repeated rows stay or go together; an empty table gives an empty result.
    """
    shared = broadcast(docs, model)
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.scores([x.as_buffer() or b"" for x in batch.column(at).cast(pa.binary()).fill_null(b"")])
            yield batch.filter(pa.array(s >= THRESHOLD))

    return docs.mapInArrow(kept, docs.schema)
