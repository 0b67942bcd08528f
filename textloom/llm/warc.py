"""WARC archives: a writer with revisit records, and a salvage reader.

The reader takes an archive member by member or, uncompressed, record by record. When a check fails
(compression, version line, headers, block length, payload digest), it searches for the next place
where a valid member or version line begins, goes on from there, and logs the bytes between as a
quarantined gap. The same search runs over the inflated bytes of a member, so a member with one bad
record, or one that breaks off, still gives its other records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Archives roll over at this many bytes; each is read by one task.
ROLL_BYTES = 16 << 20
#: Payloads under this many bytes never become revisits.
MIN_REVISIT = 1000
MEMBER, VERSION = b"\x1f\x8b\x08", b"WARC/1."


def _header(value: object) -> str:
    """A header value in one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def record(page_id: int | str | None, url: str | None, payload: bytes, digest: str, refers_to: int | str | None, revisit: bool) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"\r\n" if revisit else b"Content-Length: %d\r\n\r\n" % len(payload) + payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header(url)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_record_types(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, html, digest, record_type, refers_to): of equal payloads the largest page_id is the response.

    Rows that share the largest page_id are all responses; one without an id refers to the response.

    Only digests seen more than once come back from the count, a row each; a join against them
    splits a hot payload by AQE's skew join or is broadcast by its measured size. A null html is an empty
    payload; other columns are not read; an empty table gives an empty result.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    seen = p.where(F.octet_length("html") >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return p.join(seen, "digest", "left").select("page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("top")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) as gzip members; a manifest (archive, records, bytes) comes back.

    folder is a URI that executors share. Each archive gets its name by a move when it is whole, so a
    task that is tried again leaves no partial archive and no second copy. A null html is an empty
    payload; null page ids and urls are written without them; repeated rows give a record each.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        part, k, out, n, size = TaskContext.get().partitionId(), 0, [], 0, 0
        done: list[tuple[str, int, int]] = []

        def close():
            nonlocal k, out, n, size
            if out:
                name, temp = f"{root}/pages-{part:06d}-{k:04d}.warc.gz", f"{root}/.{uuid.uuid4().hex}"
                with store.open_output_stream(temp, compression=None) as f:
                    for x in out:
                        f.write(x)
                store.move(temp, name)
                done.append((name.rsplit("/", 1)[1], n, size))
                k, out, n, size = k + 1, [], 0, 0

        for b in batches:
            for page, url, html, digest, kind, refers in b.astype(object).where(b.notna(), None).itertuples(index=False):
                squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                x = squeeze.compress(record(page, url, html.encode(), digest, refers, kind == "revisit")) + squeeze.flush()
                out.append(x)
                n, size = n + 1, size + len(x)
                if size >= roll_bytes:
                    close()
        close()
        yield pd.DataFrame(done, columns=["archive", "records", "bytes"])

    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    # ids travel as text: a null would turn a column of numbers into floats
    rows = with_record_types(pages, min_revisit).withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return rows.mapInPandas(write, "archive string, records long, bytes long")


class Bad(Exception):
    pass


def _parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record at a place of uncompressed bytes and where it ends; Bad if a check fails."""
    end = data.find(b"\r\n\r\n", at)
    if not data.startswith(VERSION, at) or end < 0:
        raise Bad("version line or header")
    fields: dict[str, str] = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("header")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", size):
        raise Bad("block length")
    start, stop = end + 4, end + 4 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Bad("block length")
    block = data[start:stop]
    kind, digest = fields.get("warc-type", ""), _digest(fields.get("warc-payload-digest", ""))
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    if kind == "response" and digest and hashlib.new(digest[0], payload).hexdigest() != digest[1]:
        raise Bad("payload digest")
    number = lambda s: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?[0-9]+)>", fields.get(s, ""))) else None
    length = fields.get("x-payload-length", "")
    return {
        "page_id": number("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": number("warc-refers-to"), "payload_digest": digest[1] if digest else None,
        "payload_bytes": len(payload) if kind == "response" else int(length) if re.fullmatch(r"[0-9]{1,18}", length) else None, "payload": payload if kind == "response" else None,
    }, stop + 4


def _digest(text: str) -> tuple[str, str] | None:
    """(algorithm, lower-case hexadecimal digits) of a labelled digest in hexadecimal or base32; None if it can't be checked."""
    name, _, value = text.rpartition(":")
    name = name.lower().replace("-", "") or "sha1"
    size = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}.get(name)
    if size and re.fullmatch(r"[0-9A-Fa-f]+", value) and len(value) == 2 * size:
        return name, value.lower()
    if size and re.fullmatch(r"[A-Za-z2-7]+=*", value):
        try:
            raw = base64.b32decode(value.rstrip("=").upper() + "=" * (-len(value.rstrip("=")) % 8))
        except ValueError:
            return None
        return (name, raw.hex()) if len(raw) == size else None
    return None


def _inflate(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int | None]:
    """The bytes of the gzip member at a place, as far as they can be had, and where it ends (None if it is damaged)."""
    inflate, out = zlib.decompressobj(31), []
    while at < len(data):
        before = inflate.copy()
        try:
            out.append(inflate.decompress(data[at : at + step]))
        except zlib.error:
            # up to the damage, byte by byte
            for i in range(at, min(at + step, len(data))):
                try:
                    out.append(before.decompress(data[i : i + 1]))
                except zlib.error:
                    break
            return b"".join(out), None
        at += step
        if inflate.eof:
            return b"".join(out), min(at, len(data)) - len(inflate.unused_data)
    return b"".join(out), None


def _records(plain: bytes) -> list[dict]:
    """Records and gaps of inflated bytes: after a failed check the next version line that starts a valid record goes on."""
    found, at = [], 0
    while at < len(plain):
        try:
            x, end = _parse(plain, at)
            found.append({"kind": "record"} | x)
        except Bad as e:
            end = _next(plain, at + 1, (VERSION,))
            found.append({"kind": "gap", "reason": str(e), "inner_offset": at, "inner_end": end})
        at = end
    return found


def _valid(data: bytes, at: int) -> bool:
    if data.startswith(MEMBER, at):
        plain, _ = _inflate(data, at)
        return any(x["kind"] == "record" for x in _records(plain))
    try:
        _parse(data, at)
    except Bad:
        return False
    return True


def _next(data: bytes, at: int, signs: tuple[bytes, ...] = (MEMBER, VERSION)) -> int:
    """The first place from at on where a member or version line begins a valid record; len(data) if none."""
    places = {s: data.find(s, at) for s in signs}
    while (left := {s: p for s, p in places.items() if p >= 0}):
        sign = min(left, key=left.get)
        if _valid(data, left[sign]):
            return left[sign]
        places[sign] = data.find(sign, left[sign] + 1)
    return len(data)


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of an archive in order: kind is 'record' (with its offset) or 'gap' (offset, gap_end, reason).

    A gap inside a whole member has the member's bounds and its own place in the inflated bytes
    (inner_offset, inner_end). A damaged member is a gap up to the next valid place, after the records
    that could be read from its beginning.
    """
    at = 0
    while at < len(data):
        if data.startswith(MEMBER, at):
            plain, end = _inflate(data, at)
            found = _records(plain)
            if end is None or not any(x["kind"] == "record" for x in found):
                reason = "compression" if end is None else found[0]["reason"] if found else "empty member"
                yield from ({"offset": at} | x for x in found if x["kind"] == "record")
                end = _next(data, at + 1)
                yield {"kind": "gap", "offset": at, "gap_end": end, "reason": reason}
            else:
                yield from ({"offset": at} | ({"gap_end": end} if x["kind"] == "gap" else {}) | x for x in found)
        else:
            try:
                x, end = _parse(data, at)
                yield {"kind": "record", "offset": at} | x
            except Bad as e:
                end = _next(data, at + 1)
                yield {"kind": "gap", "offset": at, "gap_end": end, "reason": str(e)}
        at = end


RECORD = "archive string, kind string, offset long, gap_end long, reason string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, inner_offset long, inner_end long"


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True, pattern: str = "*.warc*") -> DataFrame:
    """Records and quarantined gaps (column kind) of all archives in folder; each is checked as it is read.

    A damaged archive gives the records before and after each gap. An empty archive gives no row.
    Revisits carry no payload; their payload_bytes and payload_digest are the response's. Digests are
    checked as md5, sha1, sha256 or sha512 in hexadecimal or base32. An archive is one row of Spark's
    binary reader, which takes files up to 2 GB; archives from write_archives are far smaller.
    """
    schema = RECORD + ", payload binary" * with_payload
    columns = [x.split(" ")[0] for x in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in b.itertuples(index=False):
                rows: list[dict] = []
                size = 0
                for x in salvage(bytes(content)):
                    rows.append(x)
                    size += with_payload and len(x.get("payload") or b"")
                    if len(rows) >= 5000 or size > 32 << 20:
                        yield _frame(rows, path, columns)
                        rows, size = [], 0
                if rows:
                    yield _frame(rows, path, columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInPandas(read, schema)


def _frame(rows: list[dict], path: str, columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame([x | {"archive": path} for x in rows]).reindex(columns=columns)
    for c in ("offset", "gap_end", "page_id", "refers_to", "payload_bytes", "inner_offset", "inner_end"):
        out[c] = pd.array([None if x is None or x != x else int(x) for x in (r.get(c) for r in rows)], dtype="Int64")
    return out.astype({c: object for c in ("kind", "reason", "url", "record_type", "payload_digest")}).where(out.notna(), None)
