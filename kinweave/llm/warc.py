"""WARC archives: a writer with revisit records, and a reader that salvages what comes after damage."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import bounded, shared_dir, written

#: Payloads below so many bytes are always written whole.
LEAST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
_URN = "urn:kinweave:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_member = b"\x1f\x8b\x08"
_version = re.compile(rb"WARC/1\.[01]\r\n")
_unsafe = re.compile(r"[\x00-\x20\x7f]")


# ---- one record


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None) -> bytes:
    """A response record, or a revisit record where ``refers_to`` is given."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_unsafe.sub(lambda m: f'%{ord(m[0]):02X}', url)}"] if url else []),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_URN}{refers_to}>"] if revisit else []),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """``data`` as gzip members, the last byte of which is zero: the high byte of a length below 16 MiB."""
    pack = lambda x: (c := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(x) + c.flush()
    out = pack(data)
    return out if out[-1] == 0 else out + pack(b"")


# ---- writer

#: Members of so many bytes are a line of the text writer, so many lines a file: archives end at about 64 MB (a record may exceed it).
LINE_BYTES, LINES = 1 << 20, 64
#: Groups of equal payloads that every task gets at most, at 64 bytes each; more of them meet the pages by a shuffle.
GROUP_BYTES = 16 << 20
#: Parts into which that shuffle deals the pages of one digest.
SALTS = 32


def _payload() -> Column:
    return F.coalesce("html", F.lit("")).cast("binary")


def repeated(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """digest, first: the smallest page_id of each payload of ``least`` bytes or more that repeats. Only digests are shuffled."""
    p = pages.select("page_id", _payload().alias("payload")).where(F.octet_length("payload") >= least)
    return p.select("page_id", F.sha2("payload", 256).alias("digest")).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")


def marked(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload (null for revisits), bytes, digest, refers_to: the smallest page_id of an equal payload of ``least`` bytes or more.

    The groups of equal payloads go to every task where their size is within GROUP_BYTES, and no payload is shuffled. Beyond
    it pages are shuffled by digest and one of SALTS numbers of the page, so that a payload of a third of all pages is dealt too.
    """
    p = pages.select("page_id", "url", _payload().alias("payload"))
    p = p.select("*", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest"))
    first = written(repeated(pages, least), "payloads")
    if bounded(first, GROUP_BYTES, 64):
        p = p.join(F.broadcast(first), "digest", "left")
    else:
        first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(first, ["digest", "salt"], "left").drop("salt")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return p.withColumn("refers_to", refers).drop("first").withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    """A gzip member a page, in files of about LINES x LINE_BYTES at most.

    Null html is an empty payload, a null url leaves out the target header, a null page_id an empty record id. Of rows
    with equal payloads those with the smallest page_id are responses, also where that id repeats.
    The text writer joins its lines by the zero byte that ends every member, so the files are the members and no more. A cast
    of bytes to a string keeps them as they are and the writer writes a string's bytes; tests read every member back.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, held = [], 0
        for b in batches:
            columns = [b.column(b.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "digest", "bytes", "refers_to")]
            for i in range(b.num_rows):
                page_id, url, payload, digest, length, refers_to = (c[i].as_py() for c in columns)
                line.append(member(record(page_id, url, payload or b"", digest, length, refers_to)))
                held += len(line[-1])
                if held >= LINE_BYTES:
                    yield _line(line)
                    line, held = [], 0
        if line:
            yield _line(line)

    lines = marked(pages, least).mapInArrow(pack, "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", "\0").option("maxRecordsPerFile", LINES).text(path)


def _line(members: list[bytes]) -> pa.RecordBatch:
    """Members without the last one's zero byte, which the text writer adds."""
    return pa.RecordBatch.from_arrays([pa.array([b"".join(members)[:-1]], pa.binary())], names=["value"])


# ---- reader


def _parsed(data: bytes, at: int) -> tuple[dict | None, int]:
    """The record at ``at`` and its end; None and ``at`` where it isn't whole and true to its digests.

    A header that was cut runs on into the next record's: where a whole record begins inside a header, that one counts. A
    value that merely ends like a version line (a URL may) has the record's type or id before it, so none begins there.
    """
    got, stop = _whole(data, at)
    if got is not None:
        inside = [m.start() for m in _version.finditer(data, at + 1, data.find(b"\r\n\r\n", at))]
        if inside and _whole(data, inside[-1])[0] is not None:
            return None, at
    return got, stop


def _whole(data: bytes, at: int) -> tuple[dict | None, int]:
    if not _version.match(data, at) or (end := data.find(b"\r\n\r\n", at)) < 0:
        return None, at
    head = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        head[k.strip().lower()] = v.strip()
    try:
        n = int(head[b"content-length"])
    except (KeyError, ValueError):
        return None, at
    if b"warc-type" not in head or b"warc-record-id" not in head:
        return None, at
    block, stop = data[end + 4 : end + 4 + n], end + 4 + n
    if n < 0 or len(block) < n or data[stop : stop + 4] != b"\r\n\r\n":
        return None, at
    said = head.get(b"warc-block-digest", b"").rpartition(b":")[2].lower()
    if said and said.decode("latin-1") != hashlib.sha256(block).hexdigest():
        return None, at
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = head.get(b"warc-type", b"").decode("latin-1")
    digest = head.get(b"warc-payload-digest", b"").rpartition(b":")[2].decode("latin-1").lower()
    length = len(payload)
    if kind == "revisit":
        found = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
        length = int(found[1]) if found else None
    else:
        own = hashlib.sha256(payload).hexdigest()
        if digest and digest != own:
            return None, at
        digest = own
    ident = lambda k: int(m[1]) if (m := re.search(rb":(-?\d+)>$", head.get(k, b""))) else None
    return {"page_id": ident(b"warc-record-id"), "url": head.get(b"warc-target-uri", b"").decode("utf-8", "replace") or None, "record_type": kind, "payload": payload, "payload_bytes": length, "payload_digest": digest, "refers_to": ident(b"warc-refers-to")}, stop + 4


def _plain(data: bytes, at: int, stop: int) -> Iterator[tuple[str, object, int]]:
    """Records and gaps of uncompressed bytes, as (kind, record or end, start)."""
    while at < stop:
        got, end = _parsed(data, at)
        if got is not None:
            yield "record", got, at
            at = end
            continue
        found = _version.search(data, at + 1, stop)
        end = found.start() if found else stop
        yield "gap", end, at
        at = end


def _unpacked(data: bytes, at: int) -> tuple[bytes, int]:
    """What the gzip member at ``at`` holds, and its end; as far as it goes and the end -1 where it is broken."""
    view, d, out = memoryview(data), zlib.decompressobj(31), []
    try:
        for i in range(at, len(data), 1 << 14):
            out.append(d.decompress(view[i : i + (1 << 14)]))
            if d.eof:
                return b"".join(out), min(i + (1 << 14), len(data)) - len(d.unused_data)
    except zlib.error:
        pass
    return b"".join(out), -1


class _Marks:
    """Where the next member or version line may begin. A mark that was found stays until it is passed, so damage costs no second scan."""

    def __init__(self, data: bytes) -> None:
        self.data, self.line, self.gz = data, -1, -1

    def after(self, at: int) -> int:
        """The first mark from ``at`` (never less than before) on; else the end."""
        end = len(self.data)
        if self.line < at:
            found = _version.search(self.data, at)
            self.line = found.start() if found else end
        if self.gz < at:
            found = self.data.find(_member, at)
            self.gz = found if found >= 0 else end
        return min(self.line, self.gz)


def salvage(data: bytes) -> Iterator[tuple[str, object, int]]:
    """Every whole record of an archive, and every byte gap between them: ("record", fields, start) and ("gap", end, start).

    Members of gzip and plain records may alternate. Where a member doesn't unpack or a record fails its length or
    digests, the search goes on at the next member or version line; whole records of a broken member count.
    Gaps that touch are one; offsets are those of the file.
    """
    at, gap, marks = 0, -1, _Marks(data)
    while at < len(data):
        sound = False
        if data.startswith(_member, at):
            inside, end = _unpacked(data, at)
            found = list(_plain(inside, 0, len(inside)))
            sound = end >= 0 and all(kind == "record" for kind, _, _ in found)
            records = [x for kind, x, _ in found if kind == "record"]
        else:
            got, end = _parsed(data, at)
            sound = got is not None
            records = [got] if sound else []
            end = end if sound else -1
        for x in records:
            yield "record", x, at
        if sound:
            if gap >= 0:
                yield "gap", at, gap
            at, gap = end, -1
        else:
            gap = at if gap < 0 else gap
            at = end if end >= 0 else marks.after(at + 1)
    if gap >= 0:
        yield "gap", at, gap


FIELDS = {"archive": "string", "kind": "string", "start": "long", "end": "long", "page_id": "long", "url": "string", "record_type": "string", "payload_bytes": "long", "payload_digest": "string", "refers_to": "long", "payload": "binary"}
_arrow = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
#: Records, and bytes of their payloads, that are sent back at once.
BATCH, BATCH_BYTES = 1000, 1 << 20


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records and the quarantined gaps of all archives of a folder: archive, kind (record or gap), start, end (of gaps), and
    the record's fields, with its payload if ``payloads``.

    A task holds one archive at a time; the writer's are of about 64 MB at most. An empty folder gives no rows.
    """
    fields = {k: v for k, v in FIELDS.items() if payloads or k != "payload"}
    schema = pa.schema([(k, _arrow[v]) for k, v in fields.items()])

    def rows(name: str, data: bytes) -> Iterator[pa.RecordBatch]:
        got, held = [], 0
        for kind, x, start in salvage(data):
            row = {"archive": name, "kind": kind, "start": start}
            row |= {k: v for k, v in x.items() if k in fields} if kind == "record" else {"end": x}
            got.append(row)
            held += len(row.get("payload") or b"")
            if held > BATCH_BYTES or len(got) == BATCH:
                yield pa.RecordBatch.from_pylist(got, schema=schema)
                got, held = [], 0
        if got:
            yield pa.RecordBatch.from_pylist(got, schema=schema)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from rows(b.column(0)[i].as_py(), b.column(1)[i].as_py())

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(unpack, ", ".join(f"`{k}` {v}" for k, v in fields.items()))


def round_trip(pages: DataFrame) -> DataFrame:
    """The pages' records as the salvage reader finds them in the archives that the writer made of ``pages``.

    An empty table gives no rows; what is null is described in ``write_archives``. Other columns of ``pages`` are not read, so
    none clashes. Gaps would be damage that the writer did: there are none, or this raises.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    whole = F.when(F.col("kind") == "record", True).otherwise(F.raise_error(F.lit("the archives have a gap")).cast("boolean"))
    return read_archives(spark, path, payloads=False).where(whole).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, sha256(encode(coalesce(html, ''))) AS payload_digest, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
