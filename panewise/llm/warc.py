"""Web archives (WARC 1.1, one gzip member for each record): writing pages, and reading with salvage.

Writing goes through Spark's own text writer, and so through its commit protocol: a lost task leaves no half archive behind.
Its line separator is an empty gzip member, so that the files are plain sequences of members.

Reading walks through an archive member by member, or record by record where it isn't compressed. Where a check fails (a
member that cannot be unpacked, a length that does not lead to a record's end, a digest that does not fit), it searches for
the next member or version line from which a valid record can be read, goes on there, and logs the bytes in between. Inside a
member of several records, also one that breaks off, it does the same with version lines.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panewise.llm._common import bounded_broadcast, new_path, written

#: Payloads of fewer bytes are never stored as revisits.
LEAST = 100
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
LINE = re.compile(rb"WARC/1\.\d+\r\n")
LINES = re.compile(rb"(?:^|(?<=\n))WARC/1\.\d+\r\n")
MARKS = re.compile(re.escape(MAGIC) + b"|(?:^|(?<=\n))" + re.escape(VERSION))
EMPTY = gzip.compress(b"", mtime=0)
DAMAGED = "member cannot be unpacked"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Of compression: from here on members hardly shrink, but cost more time.
LEVEL = 4
#: Bytes of a member that are unpacked at once.
STEP = 8192
#: Bytes of an output batch of records from which on the next begins, and of an archive: a longer record has one for itself.
BYTES, ARCHIVE = 8 << 20, 64 << 20
FIELDS = "path string, offset long, length long, problem string, record_type string, record_id string, refers_to string, target_uri string, payload_bytes long, payload_digest string, inner_offset long, inner_length long, payload binary"


def record(kind: str, identity: str, uri: str, date: str, digest: str, size: int, payload: bytes, refers_to: str | None = None) -> bytes:
    """A response or revisit record. A revisit holds the headers of the response that it would repeat, and no payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{identity}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if uri:
        lines.append(f"WARC-Target-URI: {re.sub(r'[\x00-\x20]+', '%20', uri)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def firsts(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(_digest, _first): the smallest page_id of each payload of `least` bytes or more that several rows have."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    found = pages.select("page_id", F.sha2(payload, 256).alias("_digest"), F.octet_length(payload).alias("_size")).where(F.col("_size") >= least)
    found = found.groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    return found.select("_digest", "_first")


def packed(page: str, kind: str, text: bytes) -> bytes:
    """A record as a gzip member."""
    return gzip.compress(text, LEVEL, mtime=0)


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least: int = LEAST, broadcast_rows: int = 50_000, most: int = ARCHIVE, pack: Callable[[str, str, bytes], bytes] = packed) -> None:
    """Writes the rows (page_id, url, html) as archives of up to `most` bytes under path, each by the task that has its rows.

    A null html is an empty payload, a null url is left out. Of the rows with equal payloads of at least `least` bytes those
    with the smallest page_id are responses and the others refer to it; rows without page_id only count if no other has one.
    An empty table gives no records. `pack` makes the bytes of a page's record, from its id, kind and text.
    """
    small = bounded_broadcast(written(firsts(pages, least), "warc-firsts"), broadcast_rows)
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"), F.sha2(payload, 256).alias("_digest"))
    rows = rows.join(small.withColumn("_first", F.col("_first").cast("string")), "_digest", "left").select("page_id", "url", "html", "_digest", "_first")

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = lambda parts: pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["value"])
        out, total = [], 0
        for batch in given:
            for k in range(batch.num_rows):
                page, url, html, digest, first = (c[k].as_py() for c in batch.columns)
                body, again = html.encode(), first is not None and first != page
                kind = "revisit" if again else "response"
                member = pack(page or "", kind, record(kind, page or "", url or "", date, digest, len(body), b"" if again else body, first if again else None))
                if out and total + len(member) > most:
                    yield archive(out)
                    out, total = [], 0
                out.append(member)
                total += len(member)
        if out:
            yield archive(out)

    members = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    members.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


def _head(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in raw.split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out.setdefault(name.strip().lower(), value.strip())
    return out


def parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record whose version line is at `at`, and where it ends; `checked` says that a digest covers it. ValueError says which check failed."""
    if not LINE.match(data, at):
        raise ValueError("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise ValueError("header has no end")
    head = _head(data[at:stop])
    if not head.get("content-length", "").isdigit():
        raise ValueError("no length")
    start, end = stop + 4, stop + 4 + int(head["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("length does not lead to the record's end")
    block = data[start:end]
    if (told := head.get("warc-block-digest", "")).startswith("sha256:") and told[7:].lower() != hashlib.sha256(block).hexdigest():
        raise ValueError("block digest")
    http, payload, size = {}, block, None
    if head.get("content-type", "").startswith("application/http"):
        first, gap, payload = block.partition(b"\r\n\r\n")
        http = _head(first) if gap else {}
        size = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
    checked = bool(told)
    told = head.get("warc-payload-digest", "")
    told = told[7:].lower() if told.startswith("sha256:") else ""
    kind = head.get("warc-type", "")
    if kind != "revisit":
        own = hashlib.sha256(payload).hexdigest()
        if told and own != told:
            raise ValueError("payload digest")
        told, size, checked = own, len(payload), checked or bool(told)
    urn = lambda name: head[name].strip("<>").removeprefix("urn:x-page:") if name in head else None
    return {"record_type": kind, "record_id": urn("warc-record-id"), "refers_to": urn("warc-refers-to"), "target_uri": head.get("warc-target-uri"), "payload_bytes": size, "payload_digest": told or None, "payload": payload, "checked": checked}, end + 4


def _member(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What the member at `at` unpacks to, where it ends, and the problem that it broke off with (then up to where it has been read)."""
    unpack, view, parts, stop = zlib.decompressobj(wbits=31), memoryview(data), [], at
    try:
        while not unpack.eof and stop < len(data):  # in small steps: what is left of a step is copied
            parts.append(unpack.decompress(view[stop : stop + STEP]))
            stop += STEP
    except zlib.error:
        return b"".join(parts), stop, DAMAGED
    if not unpack.eof:
        return b"".join(parts), len(data), "member is cut off"
    return b"".join(parts), min(stop, len(data)) - len(unpack.unused_data), None


def _inside(text: bytes) -> Iterator[tuple[int, int, str | None, dict | None]]:
    """(offset, length, problem, record) over the unpacked bytes of a member: after a failure goes on at the next version line that a valid record begins with."""
    at = 0
    while at < len(text):
        problem, start, found = None, at, None
        while found is None and at < len(text):
            try:
                found, end = parse(text, at)
            except ValueError as x:
                problem = problem or str(x)
                mark = LINES.search(text, at + 1)
                at = mark.start() if mark else len(text)
        if problem:
            yield start, at - start, problem, None
        if found:
            yield at, end - at, None, found
            at = end


def _one(data: bytes, at: int) -> tuple[list[tuple[int, int, str | None, dict | None]], int, str | None]:
    """What the member or plain record at `at` holds, as _inside() gives it, where it ends, and the problem that it broke off with.

    ValueError if there is no valid record in it. Of a member that breaks off, the end is where the break was met; what it
    unpacked to last is not trusted, and if its bytes are not only cut off but wrong, a record in it has to have a digest that fits.
    """
    if data[at : at + 3] != MAGIC:
        found, end = parse(data, at)
        return [(0, end - at, None, found)], end, None
    text, end, problem = _member(data, at)
    parts = list(_inside(text))
    if problem:
        parts = parts[:-1]
    if problem == DAMAGED:
        parts = [(o, n, p or (None if x["checked"] else problem), x) for o, n, p, x in parts]
    if parts and not any(p is None for _, _, p, _ in parts) or problem and not parts:
        raise ValueError(problem or parts[0][2])
    return parts, end, problem


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, dict | None]]:
    """(offset, length, problem, record) over all bytes of an archive: a record, or the problem of a quarantined gap.

    Offsets and lengths are those of whole members; records and gaps inside a member of several tell their place in its
    unpacked bytes under `inner_offset` and `inner_length`. Of a member that breaks off the records before the break stay; its
    bytes, up to the next mark that a valid record begins with, are a gap too.
    """
    at = 0
    while at < len(data):
        start, problem, parts, broken = at, None, None, None
        while parts is None and at < len(data):
            try:
                parts, end, broken = _one(data, at)
            except ValueError as x:
                problem = problem or str(x)
                mark = MARKS.search(data, at + 1)
                at = mark.start() if mark else len(data)
        if at > start:
            yield start, at - start, problem, None
        for offset, length, trouble, found in parts or []:
            place = {"inner_offset": offset, "inner_length": length} if broken or len(parts) > 1 else {}
            if trouble:
                yield at, 0, trouble, place
            else:
                yield at, 0 if broken else end - at, None, {**found, **place}
        if broken:
            # a version line before the break may be of the member's own stored bytes
            marks = (m.start() for m in MARKS.finditer(data, at + len(MAGIC)) if m.group() == MAGIC or m.start() >= end)
            mark = next((m for m in marks if _valid(data, m)), None)
            after = len(data) if mark is None else mark
            yield at, after - at, broken, None
            end = after
        at = end if parts is not None else len(data)


def _valid(data: bytes, at: int) -> bool:
    try:
        _one(data, at)
    except ValueError:
        return False
    return True


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A row of FIELDS for each record and for each gap under path: gaps have a problem, records none.

    Where Spark cannot open the folder it raises; an empty archive has no rows. With payload=False payloads are checked but
    left out. A task holds one archive at a time (or those of one input split).
    """

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds[t]) for n, t in (f.split() for f in FIELDS.split(", "))])
        names = schema.names[4:]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        for batch in given:
            for k in range(batch.num_rows):
                name, out, total = batch.column(0)[k].as_py(), [], 0
                for offset, length, problem, found in salvage(batch.column(1)[k].as_py()):
                    found = found or {}
                    if not payload:
                        found["payload"] = None
                    out.append((name, offset, length, problem, *map(found.get, names)))
                    total += len(out[-1][-1] or b"") + 200
                    if total > BYTES:
                        yield pack(out)
                        out, total = [], 0
                if out:
                    yield pack(out)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, FIELDS)


def records(found: DataFrame) -> DataFrame:
    return found.where(F.col("problem").isNull())


def gaps(found: DataFrame) -> DataFrame:
    """(path, offset, length, problem, inner_offset, inner_length) of the quarantined bytes; the last two only inside a member."""
    return found.where(F.col("problem").isNotNull()).select("path", "offset", "length", "problem", "inner_offset", "inner_length")


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): pages written as archives and read back.

    A gap in what has just been written fails the query: the pages in it would be missing.
    """
    path = new_path(pages.sparkSession, "warc")
    write(pages, path)
    page = lambda c: F.nullif(F.col(c), F.lit("")).cast("long")
    found = read(pages.sparkSession, path, payload=False)
    broken = F.raise_error(F.concat(F.lit("gap in "), "path", F.lit(" at "), F.col("offset").cast("string"), F.lit(": "), "problem")).cast("long")
    return found.select(F.when(F.col("problem").isNotNull(), broken).otherwise(page("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


#: The query's rows in DuckDB's SQL.
ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha256(b) AS h FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS m FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
  CASE WHEN m <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN m <> page_id THEN m END AS refers_to FROM f
"""


#: What a drill does to the record of a page, by its id modulo DRILL.
DRILL, BYTES_CHANGE, CUT, NOISE, LENGTH, DIGEST = 20, 1, 5, 9, 13, 17
#: Problems of a member that breaks off; which of them is met depends on the bytes behind it.
BROKEN = (DAMAGED, "member is cut off")


def damaged(page: str, kind: str, text: bytes) -> bytes:
    """The bytes of a page's record as a drill leaves them, and behind them, untouched, a metadata record that refers to the page.

    Of every DRILL pages one has bytes in the middle of its member inverted, one loses its member's end, one has noise before
    its member, one tells a wrong length, and one, if it is a response, a wrong digest. A page without an id stays whole.
    """
    rule = int(page) % DRILL if page else None
    if rule == LENGTH:
        text = re.sub(rb"(\r\nContent-Length: )(?=[0-9]+\r\n\r\nHTTP)", rb"\g<1>1", text, count=1)
    if rule == DIGEST and kind == "response":
        text = re.sub(rb"(\r\nWARC-Payload-Digest: sha256:)[0-9a-f]{64}", rb"\g<1>" + b"0" * 64, text, count=1)
    member = packed(page, kind, text)
    if rule == BYTES_CHANGE:
        at = len(member) // 2
        member = member[:at] + bytes(x ^ 0xFF for x in member[at : at + 3]) + member[at + 3 :]
    elif rule == CUT:
        member = member[:-12]
    elif rule == NOISE:
        member = b"\x00noise\r\n" + member
    return member + packed(page, "metadata", record("metadata", f"{page}/about", "", "2024-01-01T00:00:00Z", hashlib.sha256(b"").hexdigest(), 0, b"", page))


def salvaged(pages: DataFrame) -> DataFrame:
    """(page_id, record_type, payload_bytes, payload_digest, problem): a row for each row of pages, from archives that damaged() spoiled.

    Of a page whose record is lost only page_id and the problem of its gap are given; one that was recovered behind a gap has
    both. The metadata records tell which page a gap belongs to: a page's gap and record, if there are any, are what stands
    between two of them. Repeated rows stay; null ids and payloads are as in write(); an empty table gives no rows.
    """
    path = new_path(pages.sparkSession, "warc-drill")
    write(pages, path, pack=damaged)
    found = read(pages.sparkSession, path, payload=False).select("path", "offset", "problem", "record_type", "refers_to", "payload_bytes", "payload_digest")
    order = Window.partitionBy("path").orderBy("offset")  # an archive, which is bounded by bytes
    row = F.struct("problem", "record_type", "payload_bytes", "payload_digest")
    seen = found.select("*", F.lag(row, 1).over(order).alias("last"), F.lag(row, 2).over(order).alias("before")).where("record_type = 'metadata'")
    lost = F.col("last.problem").isNotNull()
    problem = F.when(lost, F.col("last.problem")).otherwise(F.col("before.problem"))
    whole = [F.when(~lost, F.col(f"last.{c}")).alias(c) for c in ("record_type", "payload_bytes", "payload_digest")]
    return seen.select(F.nullif("refers_to", F.lit("")).cast("long").alias("page_id"), *whole, F.when(problem.isin(*BROKEN), "broken member").otherwise(problem).alias("problem"))


#: The drill's rows in DuckDB's SQL.
SALVAGED_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha256(b) AS h FROM p),
f AS (SELECT *, CASE WHEN n >= 100 AND min(page_id) OVER (PARTITION BY h) <> page_id THEN 'revisit' ELSE 'response' END AS kind FROM d),
g AS (SELECT *, CASE WHEN page_id % {DRILL} IN ({BYTES_CHANGE}, {CUT}) THEN 'broken member' WHEN page_id % {DRILL} = {LENGTH} THEN 'length does not lead to the record''s end'
  WHEN page_id % {DRILL} = {DIGEST} AND kind = 'response' THEN 'payload digest' END AS loss FROM f)
SELECT page_id, CASE WHEN loss IS NULL THEN kind END AS record_type, CASE WHEN loss IS NULL THEN n END AS payload_bytes, CASE WHEN loss IS NULL THEN h END AS payload_digest,
  CASE WHEN page_id % {DRILL} = {NOISE} THEN 'no version line' ELSE loss END AS problem FROM g
"""
