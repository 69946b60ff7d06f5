"""WARC derivatives: linked metadata and plain-text conversion records of responses."""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import ship_package
from ..storage import materialize, small_enough

#: The date of records built from pages, which carry none.
DATE = "2024-01-01T00:00:00Z"
#: Elements whose contents are no text, and tags that begin or end a line.
SKIPPED = ("script", "style", "noscript", "template")
LINES = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul".split())
_NAME = re.compile(r"/?([a-z][a-z0-9]*)", re.I | re.A)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I | re.A) for name in (*SKIPPED, "title")}
_BLANK = re.compile(r"[ \t\r\f\v\xa0]+")
_HREF = re.compile(r"(?<![\w-])href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HUGE = re.compile(r"&#(?:[0-9]{20,}|[xX][0-9a-fA-F]{20,});?")
_CHARSET = re.compile(r"charset\s*=\s*\"?([\w.:-]+)", re.I)
#: What stands between two records of a file, and how much of it belongs to the first and to the second one.
BETWEEN, BEFORE, MARK = "\r\n\r\nWARC/1.", 4, b"WARC/1."
#: Most records that span BETWEEN which are sent to all tasks; more are joined.
MOST_SPANS = 1_000_000

Headers = list[tuple[str, str]]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(name: str) -> str:
    """An identifier that depends on ``name`` alone, so that a repeated task writes the same records."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def build_record(headers: Headers, block: bytes) -> bytes:
    lines = [*headers, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> Headers:
    out: list[tuple[str, list[str]]] = []
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and out:  # a folded line
            out[-1][1].append(line.strip())
        elif ":" in line:
            k, _, v = line.partition(":")
            out.append((k.strip(), [v.strip()]))
    return [(k, " ".join(v)) for k, v in out]


def value(headers: Headers, name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def _ends(raw: bytes, at: int = 0) -> tuple[int, int] | None:
    """Where the block of the record at ``at`` begins and ends by its headers; None if they say nothing."""
    head = raw.find(b"\r\n\r\n", at)
    if head < 0 or not raw.startswith(b"WARC/", at):
        return None
    size = value(_fields(raw[at:head].partition(b"\r\n")[2]), "Content-Length") or ""
    return (head + 4, head + 4 + int(size)) if re.fullmatch("[0-9]{1,18}", size) else None


def parse_record(raw: bytes) -> tuple[Headers, bytes] | None:
    """Headers and block of a record, or None if it is none."""
    ends = _ends(raw)
    if ends is None or ends[1] > len(raw):
        return None
    return _fields(raw[: ends[0] - 4].partition(b"\r\n")[2]), raw[ends[0] : ends[1]]


def _need(raw: bytes) -> int:
    """Up to where the last record reaches that begins in ``raw``, a part up to BETWEEN; 0 if none goes on behind the part. Headers can end just where BETWEEN begins."""
    at = 0
    while 0 <= at < len(raw):
        ends = _ends(raw, at) or (_ends(raw + b"\r\n\r\n", at) if raw.find(b"\r\n\r\n", at) < 0 else None)
        if ends and ends[1] > len(raw):
            return ends[1]
        at = ends[1] if ends else raw.find(MARK, at + 1)
    return 0


def _whole(raw: bytes) -> Iterator[tuple[bytes | None, bytes | None]]:
    at = 0
    while at < len(raw):
        ends = _ends(raw, at)
        if ends and ends[1] <= len(raw):
            yield raw[at : ends[1]] + b"\r\n\r\n", None
            at = ends[1]
            continue
        following = raw.find(b"WARC/1.", at + 1)
        following = len(raw) if following < 0 else following
        if raw[at:following].strip():
            yield None, raw[at:following]
        at = following


def _text(raw: str) -> str:
    """Character references resolved."""
    return html.unescape(_HUGE.sub("\ufffd", raw))


def read_page(page: str) -> tuple[str, list[str], str | None]:
    """Text, links and title of a page, in one pass from left to right.

    Comments, SKIPPED elements and tags are left out, from where one begins to its end or, for comments and
    elements never closed, the end of the page; tags of LINES begin a line. A tag ends at the next ``>``; where there is none, what is left is text.
    """
    out, links, title, at, n = [], [], None, 0, len(page)
    title_at = title_end = None
    while at < n:
        i = page.find("<", at)
        if i < 0:
            break
        out.append(page[at:i])
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = n if end < 0 else end + 3
            continue
        name = _NAME.match(page, i + 1)
        end = page.find(">", i + 1) if name or page[i + 1 : i + 2] in ("!", "?") else -2
        if end == -1:  # no tag ends any more
            out.append(page[i:])
            at = n
            break
        if end == -2:
            out.append("<")
            at = i + 1
            continue
        at = end + 1
        tag = name[1].lower() if name else ""
        if tag in LINES:
            out.append("\n")
        if name and page[i + 1] != "/":
            if tag in SKIPPED:
                close = _CLOSE[tag].search(page, at)
                at = close.end() if close else n
            elif tag == "a":
                href = _HREF.search(page, name.end(), end)
                if href:
                    links.append(_text(href[1] or href[2] or href[3] or ""))
            elif tag == "title" and title_at is None:
                close = _CLOSE["title"].search(page, at)
                title_at, title_end = (at, close.start()) if close else (-1, -1)
                title = _BLANK.sub(" ", read_page(page[at:title_end])[0].replace("\n", " ")).strip() if close else None
    out.append(page[at:])
    text = _text("".join(out))
    return "\n".join(x for line in text.split("\n") if (x := _BLANK.sub(" ", line).strip())), links, title


def plain_text(page: str) -> str:
    """The text of a page: no comments, scripts and tags, a line for each block, references resolved."""
    return read_page(page)[0]


def _chunked(body: bytes) -> bytes:
    """A body without its chunked transfer coding; as it is where that is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at, at + 4096)
        size = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(b"[0-9a-fA-F]{1,15}", size):
            return body
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def _decoded(http: Headers, payload: bytes) -> bytes:
    """A payload without gzip or deflate coding; as it is where that is broken or another."""
    coding = (value(http, "Content-Encoding") or "").strip().lower()
    try:
        if coding in ("gzip", "x-gzip"):
            return gzip.decompress(payload)
        if coding == "deflate":
            return zlib.decompress(payload) if payload[:1] == b"\x78" else zlib.decompress(payload, -15)
    except (OSError, EOFError, zlib.error):
        pass
    return payload


def response_record(page_id: int | None, url: str | None, page: str | None) -> bytes:
    """A response record with an HTTP header in front of the page."""
    body = (page or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(f"response/{page_id}/{url}")), ("WARC-Date", DATE)]
    headers += [("WARC-Target-URI", re.sub(r"\s", "%20", url))] if url else []
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(body))]
    return build_record(headers, http + body)


def derive(raw: bytes) -> list[bytes]:
    """The metadata and the conversion record of a response record; nothing for other or broken records.

    Both refer to the response and carry its target and date; the metadata block holds the
    source's WARC and HTTP headers and digests, title and links as canonical JSON, and names the
    conversion, which is the plain text.
    """
    record = parse_record(raw)
    if record is None or value(record[0], "WARC-Type") != "response":
        return []
    source, block = record
    head, mark, body = block.partition(b"\r\n\r\n")
    http = _fields(head.partition(b"\r\n")[2]) if mark else []
    payload = body if mark else block
    if (value(http, "Transfer-Encoding") or "").strip().lower() == "chunked":
        payload = _chunked(payload)
    content = _decoded(http, payload)
    charset = _CHARSET.search(value(http, "Content-Type") or "")
    try:
        page = content.decode(charset[1] if charset else "utf-8", "replace")
    except (LookupError, UnicodeError):
        page = content.decode("utf-8", "replace")
    of = value(source, "WARC-Record-ID") or record_id(digest(raw))
    shared = [("WARC-Refers-To", of)] + [(k, v) for k in ("WARC-Target-URI", "WARC-Date") if (v := value(source, k))]
    shared += [("WARC-Refers-To-Target-URI", v) for v in [value(source, "WARC-Target-URI")] if v] + [("WARC-Refers-To-Date", v) for v in [value(source, "WARC-Date")] if v]
    text_id = record_id(f"conversion/{of}")
    text, links, title = read_page(page)
    about = {
        "conversion": text_id,
        "html": {"links": links, "title": title},
        "http": {"headers": [list(h) for h in http], "status": head.split(b"\r\n", 1)[0].decode("utf-8", "replace") if mark else None},
        "payload": {"digest": digest(payload), "length": len(payload), "matches": value(source, "WARC-Payload-Digest") in (None, digest(payload))},
        "source": {"headers": [list(h) for h in source]},
    }
    block = json.dumps(about, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()
    metadata = build_record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id(f"metadata/{of}")), *shared, ("WARC-Concurrent-To", text_id), ("Content-Type", "application/json")], block)
    conversion = build_record([("WARC-Type", "conversion"), ("WARC-Record-ID", text_id), *shared, ("WARC-Source-Payload-Digest", value(source, "WARC-Payload-Digest") or digest(payload)), ("Content-Type", "text/plain; charset=utf-8")], text.encode("utf-8", "replace"))
    return [metadata, conversion]


def _records(df: DataFrame, make: Callable[..., list[bytes]], *columns: str) -> DataFrame:
    """page_id and record for each record that ``make`` gives for a row."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids, out = [], []
                for page_id, *row in zip(*(c.to_pylist() for c in part.columns)):
                    made = make(page_id, *row)
                    ids += [page_id] * len(made)
                    out += made
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["page_id", "record"])

    return df.select(*columns).mapInArrow(run, "page_id long, record binary")


def responses(pages: DataFrame) -> DataFrame:
    """A response record for each page: page_id, record.

    A null html gives an empty payload and a null url a record without target.
    Repeated rows give equal records; other columns are not read; an empty table gives an empty result.
    """
    return _records(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), lambda i, url, page: [response_record(i, url, page)], "page_id", "url", "html")


def derivatives(records: DataFrame) -> DataFrame:
    """The metadata and conversion records of response records, see :func:`derive`. Null, broken and other records give none."""
    return _records(records, lambda _, raw: derive(raw) if raw is not None else [], "page_id", "record")


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """The parts that BETWEEN cuts WARC files into: file, split (where it begins in the file) and part, those of a split in order."""
    ship_package(spark)
    return spark.read.option("lineSep", BETWEEN).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("part"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """File, split, the place within the split, and the bytes of each part, with the part of BETWEEN that belongs to it."""
    now, at = None, 0
    for batch in batches:
        for file, split, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            first = (file, split) != now
            if first:
                now, at = (file, split), 0
            raw = x.as_py()
            if not (first and split == 0):  # a file begins with a part, all others have BETWEEN in front
                at, raw = at + BEFORE, MARK + raw
            yield file, split, at, raw
            at += len(raw)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split its size (need is null), and for each part that may begin a record which goes on behind it, place and need."""
    rows: list[tuple] = []
    now, size = None, 0
    for file, split, at, raw in _placed(batches):
        if (file, split) != now:
            if now:
                rows.append((*now, size, None))
            now = (file, split)
        size = at + len(raw)
        if need := _need(raw):
            rows.append((file, split, at, need))
        if len(rows) >= 10_000:
            yield _measured(rows)
            rows = []
    if now:
        rows.append((*now, size, None))
    yield _measured(rows)


def _measured(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["file", "split", "at", "need"])


def _spans(parts: DataFrame) -> DataFrame:
    """What splits have to do with records that hold BETWEEN: file, split, base (where its first part stands in the file), first and until of the record.

    A record stands inside another one, and is none, if it begins before that ends. Places alone are dealt by file and read in order, as a stream; a record
    that would end behind its file is broken, and what follows it is read on its own.
    """
    rows = materialize(parts.mapInArrow(_measure, "file string, split long, at long, need long"), "places")
    order = Window.partitionBy("file").orderBy("split")
    sizes = rows.where("need is null")  # a row a split
    bases = sizes.select("file", "split", F.coalesce(F.sum("at").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("at").over(Window.partitionBy("file")).alias("size"))
    bases = materialize(bases, "splits")
    may = rows.where("need is not null").join(bases, ["file", "split"]).select("file", (F.col("base") + F.col("at")).alias("first"), "split", "base", (F.col("base") + F.col("at") + F.col("need")).alias("until"), "size").where("until <= size").drop("size")
    both = may.unionByName(bases.select("file", F.col("base").alias("first"), "split", "base", F.lit(None).cast("long").alias("until")))

    def outermost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begin, end = None, 0, 0
        for batch in batches:
            out = []
            for file, first, split, base, until in zip(*(c.to_pylist() for c in batch.columns)):
                if file != now:
                    now, begin, end = file, 0, 0
                if until is None:
                    if first < end:  # the split begins within a record
                        out.append((file, split, base, begin, end))
                elif first >= end:
                    begin, end = first, until
                    out.append((file, split, base, begin, end))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64() if k else pa.string()) for k in range(5)], names=["file", "split", "base", "first", "until"])

    dealt = both.repartition("file").sortWithinPartitions("file", "first", F.col("until").asc_nulls_first())
    return materialize(dealt.mapInArrow(outermost, "file string, split long, base long, first long, until long"), "spans")


def _read(spark: SparkSession, path: str) -> DataFrame:
    """record and rejected of WARC files (plain or .gz), a row for each record or run of bytes that is none.

    Spark's text source cuts files at BETWEEN, so a plain file is read in splits by many tasks and a
    compressed one as a stream. A record whose block holds BETWEEN comes in several parts, perhaps in several splits, and a
    part of it can look like a record. So a first pass finds out which records span parts (:func:`_spans`); where there are any, a second one gathers the
    parts of each, and reads all other parts on their own. No task holds more than a record. Bytes are passed on as they are. Records are the same for any size of splits.
    Empty files give no row; a record above 2 GB, Spark's limit for a value, ends the job.
    """
    parts = _parts(spark, path)
    spans = _spans(parts)
    if small_enough(spans, MOST_SPANS):
        of_split: dict[tuple[str, int], list] = {}
        for r in spans.orderBy("file", "split", "first").collect():
            of_split.setdefault((r["file"], r["split"]), [r["base"], [], []])
            of_split[r["file"], r["split"]][1].append(r["first"])
            of_split[r["file"], r["split"]][2].append(r["until"])
        if not of_split:
            return parts.mapInArrow(lambda batches: (_told(_whole(raw)) for *_, raw in _placed(batches)), "record binary, rejected binary")
        shared = spark.sparkContext.broadcast(of_split)

        def place(file: str, split: int, at: int) -> tuple[int | None, int]:
            """Where the record begins that the part belongs to, None if that holds no BETWEEN, and where the part stands in the file."""
            base, firsts, ends = shared.value.get((file, split), (0, [], []))
            k = bisect.bisect_right(firsts, base + at) - 1
            return (firsts[k] if k >= 0 and base + at < ends[k] else None), base + at

        rows = parts.mapInArrow(lambda batches: _with_places(batches, place), PLACED)
    else:
        of_split = spans.groupBy("file", "split").agg(F.first("base").alias("base"), F.array_sort(F.collect_list(F.struct("first", "until"))).alias("spans"))
        own = F.expr("get(filter(spans, s -> s.first <= base + place and base + place < s.until), 0).first")
        rows = parts.mapInArrow(lambda batches: _with_places(batches, lambda file, split, at: (None, at)), PLACED).join(of_split, ["file", "split"], "left")
        rows = rows.withColumn("first", own).withColumn("place", F.col("base") + F.col("place"))
    alone = rows.where("first is null").select("raw").mapInArrow(lambda batches: (_told(_whole(x.as_py())) for b in batches for x in b.column(0)), "record binary, rejected binary")
    spanning = rows.where("first is not null").select("file", "first", "place", "raw")
    return alone.union(spanning.groupBy("file", "first").applyInArrow(_gathered, "record binary, rejected binary"))


PLACED = "file string, split long, first long, place long, raw binary"


def _with_places(batches: Iterator[pa.RecordBatch], place: Callable[[str, int, int], tuple[int | None, int]]) -> Iterator[pa.RecordBatch]:
    for file, split, at, raw in _placed(batches):
        first, at = place(file, split, at)
        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([split]), pa.array([first], pa.int64()), pa.array([at]), pa.array([raw], pa.binary())], names=["file", "split", "first", "place", "raw"])


def _gathered(table: pa.Table) -> pa.Table:
    """The record of these parts, and what stands before it in its first and behind it in its last one."""
    order = np.argsort(table.column("place").to_numpy(), kind="stable")
    whole = b"\r\n\r\n".join(table.column("raw")[int(i)].as_py() for i in order)
    return pa.Table.from_batches([_told(_whole(whole if b"\r\n\r\n" in whole else whole + b"\r\n\r\n"))])


def _told(found: Iterator[tuple[bytes | None, bytes | None]]) -> pa.RecordBatch:
    pairs = list(found)
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["record", "rejected"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files (plain or .gz): page_id (null) and record."""
    return _read(spark, path).where("record is not null").select(F.lit(None).cast("long").alias("page_id"), "record")


def rejected_warc(spark: SparkSession, path: str) -> DataFrame:
    """The bytes of WARC files that belong to no record: rejected."""
    return _read(spark, path).where("rejected is not null").select("rejected")


def describe(records: DataFrame) -> DataFrame:
    """Headers and digests of records as columns, and the block's text. Broken records are left out."""
    ship_package(records.sparkSession)
    names = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "concurrent_to": "WARC-Concurrent-To", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "block_digest": "WARC-Block-Digest", "source_payload_digest": "WARC-Source-Payload-Digest"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, p) for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if raw is not None and (p := parse_record(raw))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in rows], pa.int64()), *(pa.array([value(h, n) for _, (h, _) in rows], pa.string()) for n in names.values()), pa.array([len(b) for _, (_, b) in rows], pa.int64()), pa.array([b.decode("utf-8", "replace") for _, (_, b) in rows], pa.string())],
                names=["page_id", *names, "content_length", "content"],
            )

    return records.select("page_id", "record").mapInArrow(run, "page_id long, " + ", ".join(f"{n} string" for n in names) + ", content_length long, content string")
