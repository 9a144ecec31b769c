"""Token id files: byte or bit planes of fixed-size id blocks, each plane compressed with zstandard.

Layout of a file: magic; blocks of at most BLOCK ids (for each plane a length and its bytes); the
document table (ids and token counts); the chunk index (place and size of each block) and a
footer that points to both. Block k holds the ids from k * BLOCK on, so any range is read by
decoding only its blocks.

Documents are written in ascending order of their integer id; rows with equal ids by their text,
null first. A null text counts as empty and still has its end id. A null document id is kept and comes
first. An empty table gives no files and no rows. Other columns are neither read nor kept.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redtide.llm.shared import map_rows, open_for_read, open_for_write
from redtide.llm.tokens import encoder
from redtide.session import fresh_path, written

MAGIC = b"PLANES1\n"
BLOCK = 65_536
LEVEL = 3
NULL_ID = -(1 << 63)
_FOOTER = struct.Struct("<QQQQI?3x8s")  # document table, chunk index, documents, ids, blocks, bit planes


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The block's planes: plane k has byte (or bit) k of every id."""
    as_bytes = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(as_bytes[:, k]).tobytes() for k in range(4)]
    all_bits = np.unpackbits(as_bytes, axis=1, bitorder="little")
    return [np.packbits(all_bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    rows = [np.frombuffer(p, np.uint8) for p in planes]
    if bits:
        columns = np.stack([np.unpackbits(r, count=n, bitorder="little") for r in rows], axis=1)
        return np.packbits(columns, axis=1, bitorder="little").view("<u4").ravel()
    return np.ascontiguousarray(np.stack(rows, axis=1)).view("<u4").ravel()


class Writer:
    def __init__(self, stream, bits: bool = False, block: int = BLOCK):
        self.stream, self.bits, self.block = stream, bits, block
        self.at, self.waiting, self.held, self.total = 0, [], 0, 0
        self.index: list[tuple[int, int]] = []
        self.keys: list[int] = []
        self.counts: list[int] = []
        self.pack = zstandard.ZstdCompressor(level=LEVEL).compress
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def _flush(self, everything: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, "<u4")
        whole = len(ids) if everything else len(ids) // self.block * self.block
        for lo in range(0, whole, self.block):
            part = ids[lo : min(whole, lo + self.block)]
            self.index.append((self.at, len(part)))
            for plane in to_planes(part, self.bits):
                data = self.pack(plane)
                self._put(struct.pack("<I", len(data)) + data)
        self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def add(self, key: int | None, ids: bytes) -> None:
        part = np.frombuffer(ids, "<u4")
        self.keys.append(NULL_ID if key is None else key)
        self.counts.append(len(part))
        self.waiting.append(part)
        self.held += len(part)
        self.total += len(part)
        if self.held >= self.block:
            self._flush(False)

    def close(self) -> int:
        self._flush(True)
        table = self.at
        for column in (self.keys, self.counts):
            data = self.pack(np.asarray(column, "<i8").tobytes())
            self._put(struct.pack("<Q", len(data)) + data)
        chunks = self.at
        self._put(np.asarray(self.index, "<u8").tobytes())
        self._put(_FOOTER.pack(table, chunks, len(self.keys), self.total, len(self.index), self.bits, MAGIC))
        self.stream.close()
        return self.at


class Reader:
    def __init__(self, stream):
        self.stream = stream
        self.size = stream.seek(0, 2)
        self.table, chunks, self.n_docs, self.n_ids, n_blocks, self.bits, magic = _FOOTER.unpack(self._get(self.size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token id file")
        self.index = np.frombuffer(self._get(chunks, 16 * n_blocks), "<u8").reshape(-1, 2)
        self.unpack = zstandard.ZstdDecompressor().decompress

    def _get(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids and token counts of the documents, in order."""
        at, out = self.table, []
        for _ in range(2):
            (n,) = struct.unpack("<Q", self._get(at, 8))
            out.append(np.frombuffer(self.unpack(self._get(at + 8, n)), "<i8"))
            at += 8 + n
        return out[0], out[1]

    def block(self, k: int) -> np.ndarray:
        at, n = map(int, self.index[k])
        end = int(self.index[k + 1][0]) if k + 1 < len(self.index) else self.table
        data, planes, place = self._get(at, end - at), [], 0
        while place < len(data):
            (size,) = struct.unpack_from("<I", data, place)
            planes.append(self.unpack(data[place + 4 : place + 4 + size]))
            place += 4 + size
        return from_planes(planes, n, self.bits)

    def range(self, first: int, count: int) -> np.ndarray:
        """Ids `first` to `first + count` of the file, from their blocks only."""
        ends = np.cumsum(self.index[:, 1].astype(np.int64))
        lo, hi = np.searchsorted(ends, first, "right"), np.searchsorted(ends, first + count, "left")
        parts = [self.block(k) for k in range(lo, min(hi, len(ends) - 1) + 1)]
        skip = first - (int(ends[lo - 1]) if lo else 0)
        return np.concatenate(parts)[skip : skip + count] if parts else np.empty(0, "<u4")

    def streams(self):
        """(document id, ids) one after another, holding one block and one document."""
        keys, counts = self.documents()
        k, rest = 0, np.empty(0, "<u4")
        for key, n in zip(keys.tolist(), counts.tolist()):
            parts = []
            while n:
                if not len(rest):
                    rest, k = self.block(k), k + 1
                parts.append(rest[:n])
                n -= len(parts[-1])
                rest = rest[len(parts[-1]) :]
            yield (None if key == NULL_ID else key), np.concatenate(parts) if parts else rest[:0]


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int, words: bool = True, bits: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write one file for each range of document ids; (file_no, path, n_docs, n_ids, n_bytes) of each.

    Only the files named in the result belong to it: a task that ran twice leaves a second file
    under another name.
    """

    def run(batches):
        encode = encoder(tokenizer, words).encode
        end = np.asarray([end_id], "<u4").tobytes()
        writer, task = None, TaskContext.get()
        for keys, texts in batches:
            if writer is None:
                path = f"{folder}/ids-{task.partitionId():06d}-{uuid.uuid4().hex}.planes"
                writer = Writer(open_for_write(path), bits)
            for key, text in zip(keys, texts):
                writer.add(key, encode(text) + end)
        if writer is not None:
            n_bytes = writer.close()
            yield [task.partitionId()], [path], [len(writer.keys)], [writer.total], [n_bytes]

    ordered = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    ordered = ordered.repartitionByRange("id").sortWithinPartitions("id", "text")
    return written(map_rows(ordered, run, "file_no bigint, path string, n_docs bigint, n_ids bigint, n_bytes bigint"))


def _placed(files: DataFrame) -> DataFrame:
    """Adds file_start: the ids in earlier files. One row for each file, so one task sorts few rows."""
    before = Window.partitionBy(F.lit(0)).orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("file_start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_ids(files: DataFrame, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Documents of the files: id, start (ids of all documents before it), n_tokens, ids_crc32 and,
    if asked for, the ids as little-endian unsigned 32-bit binary."""

    def run(batches):
        for paths, starts in batches:
            for path, start in zip(paths, starts):
                with open_for_read(path) as stream:
                    out, held = [], 0
                    for key, ids in Reader(stream).streams():
                        data = ids.astype("<u4").tobytes()
                        out.append((key, start, len(ids), zlib.crc32(data), data)[: 4 + with_ids])
                        start, held = start + len(ids), held + len(ids)
                        if held > 1 << 20 or len(out) >= 4096:
                            yield list(zip(*out))
                            out, held = [], 0
                    if out:
                        yield list(zip(*out))

    dealt = _placed(files).select("path", "file_start").repartition(max(1, files.count()))
    return map_rows(dealt, run, f"`{id_col}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, words: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all documents under the shared folder and read them back."""
    folder = fresh_path(docs.sparkSession, "token-ids")
    return read_ids(write_ids(docs, tokenizer, folder, end_id, words, id_col=id_col, text_col=text_col), id_col, with_ids=False)
