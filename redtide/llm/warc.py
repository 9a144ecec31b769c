"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Every record is a gzip member of its own. The reader checks each member (length, CRC, version line,
record length, payload digest). After a failed check it looks for the next valid member or version
line, goes on from there, and reports the bytes in between as a gap.

A null page counts as an empty payload, a null url as a URN of the page id. Pages with a null id are
responses and nothing refers to them. Rows with the same id and payload are written each for itself;
all of them are responses if the id is the largest of its payload. An empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redtide.llm.shared import map_rows, open_for_read, open_for_write
from redtide.session import fresh_path, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
LEVEL = 6
STEP = 1 << 20
HEAD_STEP = 1 << 16
GZIP = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
_URN = re.compile(r"<urn:x-page:(-?\d*)>")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One response, or a revisit of the page `refers_to` with the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", page_urn(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else page_urn(page_id)[1:-1]),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        head += [("WARC-Refers-To", page_urn(refers_to)), ("WARC-Profile", PROFILE)]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def revisits(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(id, refers_to) of the pages whose payload also belongs to a larger id.

    Only digests and ids are shuffled. Payloads shorter than `least_bytes` are left out.
    """
    payload = F.encode(F.coalesce(payload_col, F.lit("")), "UTF-8")
    own = pages.select(F.col(id_col).alias("id"), F.sha1(payload).alias("sha"), F.octet_length(payload).alias("n"))
    own = own.where(F.col("id").isNotNull() & (F.col("n") >= least_bytes)).select("id", "sha").distinct()
    largest = own.groupBy("sha").agg(F.max("id").alias("refers_to"))
    return own.join(largest, "sha").where("id < refers_to").groupBy("id", "sha").agg(F.max("refers_to").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """One archive for each partition; (path, n_records, n_bytes) of those that belong to the result."""
    wanted = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(payload_col, F.lit("")).alias("html"))
    # the id decides the side of the join and the digest which row of an id is meant
    known = revisits(pages, least_bytes, id_col, payload_col).withColumnRenamed("id", "known_id")
    same = (F.col("id") == F.col("known_id")) & (F.sha1(F.encode("html", "UTF-8")) == F.col("sha"))
    rows = wanted.join(known, same, "left").select("id", "url", "html", "refers_to")

    def run(batches):
        path, out, n, size = None, None, 0, 0
        for columns in batches:
            if out is None:
                path = f"{folder}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                out = open_for_write(path)
            for page_id, url, html, refers_to in zip(*columns):
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = packer.compress(record_bytes(page_id, url, html.encode(), refers_to)) + packer.flush()
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield [path], [n], [size]

    return written(map_rows(rows, run, "path string, n_records bigint, n_bytes bigint"))


class Source:
    """A seekable archive read in steps."""

    def __init__(self, stream):
        self.stream = stream
        self.size = stream.seek(0, 2)

    def get(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def next_start(self, at: int) -> int:
        """The next place at or behind `at` where a gzip member or a version line may begin."""
        overlap = len(VERSION) - 1
        while at < self.size:
            part = self.get(at, STEP + overlap)
            found = [x for x in (part.find(GZIP), part.find(VERSION)) if x >= 0]
            if found:
                return at + min(found)
            at += STEP
        return self.size

    def member(self, at: int) -> tuple[bytes, int]:
        """Bytes of the gzip member at `at`, and the place behind it."""
        unpacker, out = zlib.decompressobj(31), []
        while not unpacker.eof:
            part = self.get(at, STEP // 8)
            if not part:
                raise ValueError("the member is cut off")
            out.append(unpacker.decompress(part))
            at += len(part) - len(unpacker.unused_data)
        return b"".join(out), at


class Bytes(Source):
    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def get(self, at: int, n: int) -> bytes:
        return self.data[at : at + n]


def parse_record(source: Source, at: int) -> tuple[dict, bytes, int]:
    """Headers, block and end of the plain record at `at`; ValueError if a check fails."""
    head = bytearray(source.get(at, HEAD_STEP))
    if not head.startswith(VERSION):
        raise ValueError("no version line")
    seen = 0
    # headers of any length: a url may be as long as a page
    while (end := head.find(b"\r\n\r\n", seen)) < 0:
        seen = max(0, len(head) - 3)
        more = source.get(at + len(head), len(head))
        if not more:
            raise ValueError("no end of the headers")
        head += more
    lines = head[:end].decode("utf-8", "replace").split("\r\n")[1:]
    pairs = [x.partition(":") for x in lines]
    fields = {k.strip().lower(): v.strip() for k, _, v in pairs}
    if not fields.get("content-length", "").isdigit():
        raise ValueError("no content length")
    n, start = int(fields["content-length"]), at + end + 4
    if start + n + 4 > source.size:
        raise ValueError("the record is cut off")
    block = source.get(start, n)
    if source.get(start + n, 4) != b"\r\n\r\n":
        raise ValueError("the record has another length")
    if (said := fields.get("warc-block-digest", "")).startswith("sha1:") and said[5:] != digest_of(block):
        raise ValueError("the block digest differs")
    if fields.get("warc-type") == "response" and (said := fields.get("warc-payload-digest", "")).startswith("sha1:"):
        if said[5:] != digest_of(block.partition(b"\r\n\r\n")[2]):
            raise ValueError("the payload digest differs")
    return fields, block, start + n + 4


def salvage(source: Source):
    """("record", place, length, fields, block) and ("gap", place, length, reason, b"") in order.

    Bytes that belong to no valid record lie in exactly one gap.
    """
    at, gap, reason = 0, None, ""
    while at < source.size:
        place, found = at, None
        try:
            if source.get(at, 3) == GZIP:
                data, end = source.member(at)
                found = [x for x in salvage(Bytes(data))]
                bad = next((x for x in found if x[0] == "gap"), None)
                if bad and not any(x[0] == "record" for x in found):
                    raise ValueError(bad[3])
            else:
                fields, block, end = parse_record(source, at)
                found = [("record", at, end - at, fields, block)]
        except (ValueError, zlib.error) as why:
            if gap is None:
                gap, reason = at, str(why)
            at = source.next_start(at + 1)
            continue
        if gap is not None:
            yield "gap", gap, place - gap, reason, b""
            gap = None
        # records of one member share its place; gaps inside a member are told with its place
        yield from ((kind, place, end - place, what, block) for kind, _, _, what, block in found)
        at = end
    if gap is not None:
        yield "gap", gap, source.size - gap, reason, b""


def _page(urn: str | None) -> int | None:
    found = _URN.fullmatch(urn or "")
    return int(found[1]) if found and found[1] else None


def read_archives(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records and gaps of the archives in the column `path`: path, kind, place, length, reason,
    page_id, url, record_type, refers_to, payload_digest, payload_bytes and, if asked for, payload."""

    def row(path, kind, place, length, what, block):
        if kind == "gap":
            return (path, kind, place, length, what, *[None] * (7 if with_payload else 6))
        http, _, payload = block.partition(b"\r\n\r\n")
        size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        n = len(payload) if what.get("warc-type") == "response" else int(size[1]) if size else None
        told = what.get("warc-payload-digest", "").removeprefix("sha1:") or digest_of(payload)
        known = (_page(what.get("warc-record-id")), what.get("warc-target-uri"), what.get("warc-type"), _page(what.get("warc-refers-to")), told, n)
        return (path, kind, place, length, None, *known, payload)[: 11 + with_payload]

    def run(batches):
        for (paths,) in batches:
            for path in paths:
                with open_for_read(path) as stream:
                    out, held = [], 0
                    for found in salvage(Source(stream)):
                        out.append(row(path, *found))
                        held += len(found[4])
                        if held > 1 << 24 or len(out) >= 4096:
                            yield list(zip(*out))
                            out, held = [], 0
                    if out:
                        yield list(zip(*out))

    schema = "path string, kind string, place bigint, length bigint, reason string, page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint"
    dealt = files.select("path").repartition(max(1, files.count()))
    return map_rows(dealt, run, schema + ", payload binary" * with_payload)


def round_trip(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the archives under the shared folder and read them back."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, least_bytes, id_col, url_col, payload_col))
