"""WARC: a converter from legacy ARC archives.

An ARC record is a header line and as many bytes as the line declares. Version 1 lines have
five fields (URL, address, date, type, length), version 2 lines ten (URL, address, date, type,
status, checksum, location, offset, file name, length); a ``filedesc`` record at the start of
each archive names the version. The converter reads the declared lengths, never the content,
to find the next record, and gives each record what WARC asks for: an identifier derived from
its digest and place, an ISO timestamp, a type, and block and payload digests. Recorded HTTP answers and
name look-ups become responses, filedesc records warcinfo, anything else resources. Of HTTP answers with
one payload digest (and at least ``least_bytes`` of payload), that with the smallest key is
the response; the others become revisits that refer to it and carry no payload. The key is a header of
archives that ``write_arc`` made; records of other archives go by date and place, after those with a key.

Scale: archives are closed by running size, so none holds more than ARCHIVE_BYTES and one record; Spark's text writer
writes each as a file, and they are read back as binary files, one at a time in a task.
Which records are revisits is an aggregate on digests joined back; payloads are never part of
a shuffle by digest.

Defined cases: a null payload counts as empty; a null URL is written as ``-``. Rows with a null
key are written with the key ``-`` and come back as null; among equal payloads they are never
the response of another. Repeated rows are records of their own: the first copy of the smallest
key is the response, the others refer to it. White space inside a URL is percent-encoded.
A blank inside a content type belongs to it. After a header line that can't be read, nothing is a record up to a full header
line (scheme, IP address, date) whose block ends where the archive does or another header line follows, so that no
line of a payload becomes one; a last record that is
shorter than it declares is left out. ``convert`` returns what it left out. A key that isn't a 64-bit number is none. Extra columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.common import new_folder, staged

#: Bytes of payload in one archive, about.
ARCHIVE_BYTES = 16 << 20
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100

#: Header lines of the two ARC versions and the names that WARC gives.
ARC_FIELDS = {1: ["url", "ip", "date", "type", "length"], 2: ["url", "ip", "date", "type", "status", "checksum", "location", "offset", "file", "length"]}
VERSION_1_TITLE = "URL IP-address Archive-date Content-type Archive-length"
VERSION_2_TITLE = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


# --- pages to ARC -------------------------------------------------------------------------------------


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes an ARC record for each row, without a shuffle: version 1 archives from one half of the partitions, version 2 from the other.

    Each file ends with the record that brings it to ``archive_bytes``, and starts with a filedesc
    record. The key is a header of the recorded response.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Record-Key: "), F.coalesce(F.col(key).cast("string"), F.lit("-")), F.lit("\r\n\r\n"), body)
    place = F.regexp_replace(F.coalesce(F.nullif(F.col(url), F.lit("")), F.lit("-")), r"\s", "%20")
    day = F.date_format(F.expr(f"timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(pmod(coalesce({key}, 0), 365) as int))"), "yyyyMMddHHmmss")
    rows = pages.select(*(x.cast("binary").alias(c) for c, x in (("place", place), ("day", day), ("block", block))))
    # a row is an archive
    rows.mapInArrow(_archives(archive_bytes), "value string").write.option("lineSep", "\n").option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


def _archives(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = 1 + TaskContext.get().partitionId() % 2
        title, more = ((VERSION_1_TITLE, ""), (VERSION_2_TITLE, "200 - - 0 legacy.arc "))[version - 1]
        about = f"{version} 0 Plinth\n{title}\n"
        first = f"filedesc://legacy.arc 0.0.0.0 20240101000000 text/plain {more}{len(about)}\n{about}".encode()
        held, size = [first], 0
        whole = lambda: pa.RecordBatch.from_arrays([pa.array([b"\n".join(held)], pa.string())], names=["value"])
        for batch in batches:
            for place, day, block in zip(*(batch.column(c) for c in ("place", "day", "block")), strict=True):
                block = block.as_py()
                held.append(b"%b 0.0.0.0 %b text/html %b%d\n%b" % (place.as_py(), day.as_py(), more.encode(), len(block), block))
                size += len(held[-1])
                if size >= most:
                    yield whole()
                    held, size = [first], 0
        if size:
            yield whole()

    return run


ADDRESS = re.compile(r"[0-9A-Fa-f.:]+|-")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")


def _head(line: str, names: list[str], strict: bool = False) -> dict | None:
    """The fields of a header line; blanks inside an address or a content type belong to it. None if it isn't one.

    strict: of a line that nothing says is a header: its address has a scheme, its IP address and its date are such.
    """
    fields = line.rstrip("\r").split(" ")
    tail = len(names) - 4  # fields after the type
    # the last date after an IP address; what stands between it and the tail is the type
    ends = range(len(fields) - tail - 2, 1, -1)
    at = next((i for i in ends if fields[i].isdecimal() and 8 <= len(fields[i]) <= 14 and ADDRESS.fullmatch(fields[i - 1])), None)
    if at is None:
        at = len(fields) - tail - 2
        if at < 2 or strict or not fields[at].isdecimal():
            return None
    head = dict(zip(names, ["%20".join(fields[: at - 1]), fields[at - 1], fields[at], " ".join(fields[at + 1 : len(fields) - tail]), *fields[len(fields) - tail :]], strict=True))
    if not head["length"].isdecimal() or len(head["length"]) > 18 or strict and not SCHEME.match(head["url"]):
        return None
    return head


def _line(content: bytes, at: int) -> tuple[str, int]:
    """The line at a place, and where it ends (-1: at the archive's end)."""
    end = content.find(b"\n", at)
    return content[at : end if end >= 0 else len(content)].decode("utf-8", "replace"), end


def _found_again(content: bytes, at: int, names: list[str]) -> bool:
    """Whether a record begins here for sure: a full header line whose block ends where the archive does, or another header line follows."""
    line, end = _line(content, at)
    head = _head(line, names, True) if end >= 0 else None
    if head is None:
        return False
    after = end + 1 + int(head["length"])
    if after >= len(content):
        return after == len(content)
    if content[after] not in b"\r\n":
        return False
    while after < len(content) and content[after] in b"\r\n":
        after += 1
    return after == len(content) or _head(_line(content, after)[0], names, True) is not None


def arc_records(content: bytes, skipped: list | None = None) -> Iterator[dict]:
    """Records of one ARC archive, by declared lengths; a filedesc record tells the version. skipped: takes (place, reason) of what can't be read."""
    at, version, lost = 0, 1, False
    skipped = [] if skipped is None else skipped
    while at < len(content):
        if content[at] in b"\r\n":
            at += 1
            continue
        line, end = _line(content, at)
        about = line.startswith("filedesc://")
        names = ARC_FIELDS[2 if line.rstrip("\r").count(" ") == 9 else 1] if about else ARC_FIELDS[version]
        head = _head(line, names) if end >= 0 and (not lost or _found_again(content, at, names)) else None
        if head is None:
            if not lost:
                skipped.append((at, f"no ARC {version} header line"))
            lost, at = True, end + 1 if end >= 0 else len(content)
            continue
        size, lost = int(head["length"]), False
        block = content[end + 1 : end + 1 + size]
        if len(block) != size:
            skipped.append((at, "shorter than it declares"))
            return
        at = end + 1 + size
        if about:
            version = 2 if block[:1] == b"2" else 1
        yield head | {"block": block}


# --- ARC to WARC ----------------------------------------------------------------------------------------


def response_parts(block: bytes) -> tuple[bytes, bytes]:
    """The HTTP head of a recorded response, with the empty line, and its payload."""
    at = block.find(b"\r\n\r\n")
    return (block[: at + 4], block[at + 4 :]) if at >= 0 else (b"", block)


def kind_of(url: str, block: bytes) -> str:
    if url.startswith("filedesc:"):
        return "warcinfo"
    return "response" if block.startswith(b"HTTP/") else "look-up" if url.startswith("dns:") else "resource"


def header(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n"):
        if line[: len(name) + 1].lower() == name.lower() + b":":
            return line[len(name) + 1 :].strip().decode("utf-8", "replace")
    return None


def number(said: str | None) -> int | None:
    """A 64-bit number, null for anything else."""
    return int(said) if said and re.fullmatch(r"-?[0-9]{1,19}", said) and -(2**63) <= int(said) < 2**63 else None


def key_of(head: bytes) -> tuple[int | None, bool]:
    """The key in a response's head, and whether there is one (``-`` is a null one). What isn't a number is another maker's."""
    said = header(head, b"X-Record-Key")
    return number(said), said == "-" or number(said) is not None


_CAPTURES = pa.schema([("file", pa.string()), ("nr", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("type", pa.string()), ("kind", pa.string()), ("key", pa.int64()), ("has_key", pa.bool_()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("block", pa.binary())])
_CAPTURES_DDL = "file string, nr long, url string, ip string, date string, type string, kind string, key long, has_key boolean, digest string, payload_bytes long, block binary"


def _plain(content: bytes) -> bytes:
    """The bytes of a file that may be gzip, with any number of members."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content) + member.flush())
        content = member.unused_data
    return b"".join(out)


def _batched(rows: Iterator[dict], schema: pa.Schema, size: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` bytes of the column ``size``."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row.get(size) or b"") + 200
        if n >= most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _read_arc(with_block: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                    file, skipped = path.as_py().rpartition("/")[2], []
                    for nr, r in enumerate(arc_records(_plain(content.as_py()), skipped)):
                        kind = kind_of(r["url"], r["block"])
                        head, payload = response_parts(r["block"]) if kind == "response" else (b"", r["block"])
                        key, has_key = key_of(head)
                        yield {"file": file, "nr": nr, "url": r["url"], "ip": r["ip"], "date": r["date"], "type": r["type"], "kind": kind, "key": key, "has_key": has_key, "digest": hashlib.sha256(payload).hexdigest(), "payload_bytes": len(payload), "block": r["block"] if with_block else b""}
                    if not with_block:
                        for at, reason in skipped:
                            yield {"file": file, "nr": at, "kind": "skipped", "type": reason}

        return _batched(rows(), _CAPTURES, "block")

    return run


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def warc_record(kind: str, url: str, date: str, ip: str, digest: str, identity: str, head: bytes, payload: bytes, refers: str | None, content_type: str = "application/http; msgtype=response") -> bytes:
    """One record, without the two line ends after it."""
    block = head + (payload if kind != "revisit" else b"")
    date = date.ljust(14, "0")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{identity}>"),
        ("WARC-Date", f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"),
        *([("WARC-Filename", url.partition("://")[2])] if kind == "warcinfo" else [("WARC-Target-URI", url), ("WARC-IP-Address", ip)]),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
        *([("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:uuid:{refers}>")] if refers else []),
        ("Content-Type", content_type),
        ("Content-Length", str(len(block))),
    ]
    return ("WARC/1.0\r\n" + "".join(f"{a}: {b}\r\n" for a, b in fields) + "\r\n").encode() + block


def identifier(key: int | str | None, copy: int, digest: str) -> str:
    """A version 5 UUID from what identifies a record (its key, or address, date and place), its number among rows with that key, and its digest."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{key}/{copy}/{digest}"))


_REVISIT = "X-Revisit-Of"


def _to_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def name(r: dict) -> int | str | None:
        return r["key"] if r["has_key"] else f"{r['url']} {r['date']} {r['file']} {r['nr']}"

    def rows():
        for batch in batches:
            for r in batch.to_pylist():
                first, about = r["first"], (r["url"], r["date"], r["ip"], r["digest"], identifier(name(r), r["copy"] if r["has_key"] else 0, r["digest"]))
                if r["kind"] != "response":
                    yield {"value": warc_record("response" if r["kind"] == "look-up" else r["kind"], *about, b"", r["block"], None, "text/dns" if r["kind"] == "look-up" else r["type"])}
                    continue
                head, payload = response_parts(r["block"])
                if first is None:
                    yield {"value": warc_record("response", *about, head, payload, None)}
                    continue
                # the length and the response's key are kept in headers of the revisit, which has no payload
                of = "" if first["key"] is None else f"{_REVISIT}: {first['key']}\r\n"
                more = (head[:-2] or b"HTTP/1.1 200 OK\r\n") + f"X-Payload-Length: {len(payload)}\r\n{of}\r\n".encode()
                yield {"value": warc_record("revisit", *about, more, b"", identifier(name(first), 0, r["digest"]))}

    return _batched(rows(), pa.schema([("value", pa.binary())]), "value")


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Reads the ARC archives under one path and writes WARC archives under another. Returns (file, place, reason) of what could not be read."""
    seen = staged(_files(spark, arc_path).mapInArrow(_read_arc(False), _CAPTURES_DDL).drop("block", "ip"), "captures")
    large = seen.where((F.col("kind") == "response") & (F.col("payload_bytes") >= least_bytes) & (F.col("key").isNotNull() | ~F.col("has_key")))
    first = F.struct((~F.col("has_key")).alias("late"), "key", "date", "file", "nr", "url", "has_key")
    firsts = large.groupBy("digest").agg(F.min(first).alias("first"), F.count("*").alias("n"))
    firsts = staged(firsts.where("n > 1").select("digest", "first"), "responses")
    place = (F.col("file") == F.col("first.file")) & (F.col("nr") == F.col("first.nr"))
    revisits = large.join(firsts, "digest").where(~place).select("file", "nr", "first")
    whole = _files(spark, arc_path).mapInArrow(_read_arc(True), _CAPTURES_DDL)
    marked = whole.join(revisits, ["file", "nr"], "left").withColumn("copy", F.when(F.col("first").isNull(), F.lit(0)).otherwise(F.xxhash64("file", "nr")))
    records = marked.mapInArrow(_to_warc, "value binary")
    records.select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(warc_path)
    return seen.where("kind = 'skipped'").select("file", F.col("nr").alias("place"), F.col("type").alias("reason"))


# --- WARC to rows -----------------------------------------------------------------------------------------


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of an archive, by declared lengths."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a WARC record starts with its version")
        fields = {a.lower(): b.strip() for a, _, b in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        block = content[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError("a WARC record is shorter than it declares")
        yield fields, block
        at = end + 4 + size + 4


_ROWS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("warc_date", pa.string()), ("url", pa.string())])


def _read_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for content in batch.column("content"):
                for fields, block in warc_records(_plain(content.as_py())):
                    revisit = fields["warc-type"] == "revisit"
                    http = revisit or block.startswith(b"HTTP/")
                    head, payload = response_parts(block) if http else (b"", block)
                    key, of = key_of(head)[0], number(header(head, _REVISIT.encode()))
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError("a payload doesn't match its digest")
                    size = int(header(head, b"X-Payload-Length")) if revisit else len(payload)
                    yield {"page_id": key, "payload_bytes": size, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": of, "record_id": fields["warc-record-id"], "warc_date": fields["warc-date"], "url": fields.get("warc-target-uri")}

    return _batched(rows(), _ROWS, "payload_digest")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives under a path; payloads are held against their digests."""
    return _files(spark, path).mapInArrow(_read_warc, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string, url string")


def converted(pages: DataFrame) -> DataFrame:
    """Pages, written as ARC archives, converted to WARC archives, and read back from these."""
    spark = pages.sparkSession
    arc, warc = new_folder(spark, "arc"), new_folder(spark, "warc")
    write_arc(pages.select(F.col("page_id").cast("long"), "url", "html"), arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc).where("record_type in ('response', 'revisit')")


REPORT_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha256(t) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""


def warc_report(pages: DataFrame) -> DataFrame:
    """The columns of the contract."""
    return converted(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
