"""Byte-level BPE encoding and decoding: greedy proposals, pair checks, exact merging where a check fails."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship_package
from .bpe_tables import Merges
from .word_store import LETTER, NUMBER, OTHER, SPACE, WordStore, code_points, contractions

#: Characters of text encoded together.
TOGETHER = 1 << 20
_codecs: dict[str, ByteBPE] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merges_of(spec: dict, symbols: list[str]) -> tuple[Merges, list[str]]:
    """The merge tables of a vocabulary file over base symbols, and the names of all tokens by age."""
    age = {c: i for i, c in enumerate(symbols)}
    pairs, made = [], []
    for m in spec["model"]["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        pairs.append((age[a], age[b]))
        made.append(age.setdefault(a + b, len(age)))
    return Merges(len(symbols), pairs, made), list(age)


class ByteBPE:
    """Tables of one vocabulary file whose public pattern splits texts into words: contractions, runs of letters, numbers or other characters with a space before, and white space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        names = [c for c, _ in sorted(byte.items(), key=lambda x: x[1])]
        self.table, names = merges_of(spec, names)
        self.id_of = np.array([vocab[x] for x in names], np.uint32)
        text = [b""] * (max(int(self.id_of.max()), *self.special.values(), 0) + 1)
        for i, x in zip(self.id_of, names):
            text[i] = bytes(byte[c] for c in x)
        for x, i in self.special.items():
            text[i] = x.encode()
        self.blob = np.frombuffer(b"".join(text), np.uint8)
        self.length = np.array([len(b) for b in text], np.int64)
        self.offset = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.store = WordStore(self.table, self.id_of)

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens."""
        cp, bounds = code_points(texts)
        return self.store.texts(cp, bounds, *self.split(cp, bounds))

    def split(self, cp: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words that the pattern finds in texts: where they begin and end.

        Letters, numbers and other characters form runs, each with a space right before it. Of
        white space before a run the last character stands alone unless it
        is such a space, and what is before it is one word; so is white space at the end. An
        apostrophe that begins a run without a space can begin a contraction.
        """
        n = len(cp)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = _KIND[cp]
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        head = np.concatenate(([True], kind[1:] != kind[:-1])) | edge[:-1]  # runs of one kind
        last = np.concatenate((head[1:], [True]))
        blank = kind == SPACE
        more = blank & last & ~edge[1:]  # the last white space before a run in the same text
        prefix = more & (cp == 0x20)
        start = head.copy()
        start[more] = True
        start[np.flatnonzero(prefix) + 1] = False
        quote = np.flatnonzero((cp == 0x27) & head & ~np.concatenate(([False], prefix[:-1])) & last)
        if len(quote):
            long = contractions(cp, quote, bounds[np.searchsorted(bounds, quote, side="right")])
            quote, long = quote[long > 0], long[long > 0]
            start[quote + 1] = False
            rest = quote + 1 + long
            start[rest[rest < n]] = True
        begin = np.flatnonzero(start)
        return begin, np.append(begin[1:], n)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; the strings of special tokens become these."""
        split = [self.cut.split(t) if self.cut and any(s in t for s in self.special) else [t] for t in texts]
        flat = [p for parts in split for p in parts[::2]]
        ids, start, size = [], 0, 0
        for i, t in enumerate(flat):
            size += len(t)
            if size >= TOGETHER or i == len(flat) - 1:
                ids += self._plain(flat[start : i + 1])
                start, size = i + 1, 0
        own = iter(ids)
        return [next(own) if len(p) == 1 else b"".join(next(own) if k % 2 == 0 else self.special[x].to_bytes(4, "little") for k, x in enumerate(p)) for p in split]

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8; bytes that are no valid UTF-8 become U+FFFD."""
        t = np.frombuffer(ids, "<u4").astype(np.int64)
        n = self.length[t]
        at = np.arange(n.sum()) + np.repeat(self.offset[t] - (np.cumsum(n) - n), n)
        raw = self.blob[at].tobytes()
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()


def _kinds() -> np.ndarray:
    """The kind of every code point, by the classes of the pattern."""
    kind = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for k, c in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        kind[np.frombuffer("".join(regex.findall(c, every)).encode("utf-32-le"), np.uint32)] = k
    return kind


_KIND = _kinds()


def codec(path: str) -> ByteBPE:
    """The worker's codec for a vocabulary file."""
    if path not in _codecs:
        _codecs[path] = ByteBPE(path)
    return _codecs[path]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            yield part.column(0), part.column(1).fill_null("").to_pylist()


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text.

    A null text counts as empty and has no ids. Repeated rows are encoded each, other columns are not read,
    and an empty table gives an empty result.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, texts in _texts(batches):
            ids = codec(vocabulary).encode(texts)
            cut = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([doc, pa.ListArray.from_arrays(pa.array(cut), pa.array(np.frombuffer(b"".join(ids), "<i4")))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text from doc_id and ids; null ids give an empty text."""
    ship_package(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec(vocabulary).decode(np.array(x or [], "<u4").tobytes()).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode what was encoded, and return digests: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Nulls, repeated rows and empty tables as in :func:`encode`.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, texts in _texts(batches):
            bpe = codec(vocabulary)
            ids = bpe.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
