"""Substring dedup on bytes by column-wise construction over many strings at once.

Equal strings of LENGTH bytes have the same anchor, the least hash of their short runs, at the same
place. Around each anchor that may occur twice (a merged sketch tells, and loses none) a document gives
one segment: the bytes of all its LENGTH-strings with that anchor. Segments with one anchor meet
in one task and are aligned at the anchor.

There the collection's transform is built column by column: each round inserts one symbol of every
segment, orders the segments by what they have read so far (a stable sort by the new symbol of the
order before) and updates the common lengths of neighbours, reading and writing each array once
from front to back. A string ends in a column as a repeat if the common length with a neighbour reaches
LENGTH. The arrays belong to one bounded batch, so they stay in memory and no scratch file is needed.

Anchors with more than GROUP segments are dealt to several tasks by content; these tasks also tell the
hashes of all their strings, and those are joined over the tasks, so nothing is lost between them.

A document is its id and its text, as in `substrings`. Null and empty texts have no bytes. A text takes
about 100 times its bytes of memory while its anchors are found.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redtide.llm.rolling import BASES, anchor_of_windows, anchors, runs, window_hashes, window_minima
from redtide.llm.shared import map_rows
from redtide.llm.sketch import SCHEMA, Repeated, Sketch, merged, width_bits
from redtide.llm.substrings import _with_places, covered
from redtide.session import written

LENGTH = 400
RUN = 32
GROUP = 65_536  # segments of one anchor that one task takes: about 100 MB
BATCH = 16_384
NOTHING = 255  # the symbol outside a segment; no byte of UTF-8


def _anchored(data: bytes, length: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    grams = window_hashes(np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1), run)
    least = window_minima(grams, length - run + 1)
    return grams, least, anchors(grams, least, length - run + 1)


def sketch_of(docs: DataFrame, text_col: str, length: int, run: int) -> Repeated:
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = width_bits(2 * size / (length - run + 2))

    def count(batches):
        sketch = Sketch(bits)
        for (texts,) in batches:
            found = [np.empty(0, np.uint64)]
            for text in texts:
                data = text.encode() if text else b""
                if len(data) >= length:
                    grams, _, places = _anchored(data, length, run)
                    found.append(grams[places])
            sketch.add(np.concatenate(found))
        rows = list(sketch.rows())
        for at in range(0, len(rows), 256):
            yield list(zip(*rows[at : at + 256]))

    return merged(map_rows(docs.select(text_col), count, SCHEMA), bits)


def segments(docs: DataFrame, length: int = LENGTH, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, anchor, ahead, first, n_bytes, bytes): the bytes from `first` on, with the anchor `ahead`
    bytes later, for each anchor that may occur twice. Segments that are equal inside a batch are repeats;
    one of them goes on for the others and their rows have null bytes."""
    may_repeat = docs.sparkSession.sparkContext.broadcast(sketch_of(docs, text_col, length, run))

    def cut(batches):
        sketch = may_repeat.value
        for ids, hashes, texts in batches:
            out, met = [], {}
            for key, text_hash, text in zip(ids, hashes, texts):
                data = text.encode() if text else b""
                if len(data) < length:
                    continue
                grams, least, places = _anchored(data, length, run)
                wanted = sketch(grams[places])
                if not wanted.any():
                    continue
                whose = anchor_of_windows(grams, least, places)
                firsts = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]]))
                ends = np.concatenate([firsts[1:], [len(whose)]])
                for a, b in zip(firsts[wanted[whose[firsts]]].tolist(), ends[wanted[whose[firsts]]].tolist()):
                    place = int(places[whose[a]])
                    anchor, part = int(grams[place].view(np.int64)), data[a : b - 1 + length]
                    one = met.setdefault((place - a, part), len(out))
                    if one < len(out):
                        # a null row for this segment and, the first time, for the one that was met before
                        if out[one][-2] is not None:
                            out.append((*out[one][:6], None, None))
                            out[one] = (*out[one][:6], None, out[one][7])
                        out.append((key, text_hash, anchor, place - a, a, len(part), None, None))
                    else:
                        out.append((key, text_hash, anchor, place - a, a, len(part), True, part))
            if out:
                yield list(zip(*out))

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), text_col)
    return map_rows(rows, cut, f"id {kind}, text_hash bigint, anchor bigint, ahead int, first bigint, n_bytes bigint, alone boolean, bytes binary")


def repeats_by_columns(parts: list[bytes], ahead: list[int], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(segment, first, end) byte ranges covered by strings of `length` bytes that also lie in another
    segment at the same distance from its anchor. Each segment comes with its anchor's place."""
    if len(parts) < 2:
        return []
    shift = max(ahead)
    width = max(shift - a + len(p) for a, p in zip(ahead, parts))
    table = np.full((len(parts), width), NOTHING, np.uint8)
    for row, a, p in zip(table, ahead, parts):
        row[shift - a : shift - a + len(p)] = np.frombuffer(p, np.uint8)
    columns = np.ascontiguousarray(table.T)
    del table
    n = len(parts)
    order, common = np.arange(n), np.zeros(n + 1, np.int64)  # common[k]: with the one before; ends are 0
    start, end, out = np.full(n, -1), np.full(n, -1), []
    for k, column in enumerate(columns):
        symbols = column[order]
        moved = np.argsort(symbols, kind="stable")
        sorted_symbols = symbols[moved]
        same = (sorted_symbols[1:] == sorted_symbols[:-1]) & (sorted_symbols[1:] != NOTHING)
        now = np.zeros(n + 1, np.int64)
        at = np.flatnonzero(same)
        if len(at):
            # least common length on the way from one to the other in the order before
            lo, hi = moved[at] + 1, moved[at + 1] + 1
            now[at + 1] = 1 + np.minimum.reduceat(common, np.column_stack([lo, hi]).ravel())[::2]
        order, common = order[moved], now
        if k + 1 >= length:
            hit = order[(common[:-1] >= length) | (common[1:] >= length)]
            if len(hit):
                fresh = hit[end[hit] < k - length + 1]
                done = fresh[end[fresh] > 0]
                out.append(np.column_stack([done, start[done], end[done]]))
                start[fresh] = k - length + 1
                end[hit] = k + 1
    done = np.flatnonzero(end > 0)
    out.append(np.column_stack([done, start[done], end[done]]))
    back = np.asarray(ahead) - shift
    return [(int(r), int(a + back[r]), int(b + back[r])) for r, a, b in np.concatenate(out)]


def _strings(part: bytes, length: int) -> np.ndarray:
    """128 bits of each string of `length` bytes in the segment."""
    values = np.frombuffer(part, np.uint8).astype(np.uint64) + np.uint64(1)
    return np.column_stack([window_hashes(values, length, b) for b in BASES])


def repeated_places(docs: DataFrame, length: int = LENGTH, run: int = RUN, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, places): the byte ranges covered by repeated strings, as start << 32 | length."""
    cut = written(segments(docs, length, run, id_col, text_col))
    settled = cut.where("bytes is null").select("id", "text_hash", F.shiftleft("first", 32).bitwiseOR(F.col("n_bytes")).alias("place"))
    cut = cut.where("bytes is not null")
    large = cut.groupBy("anchor").count().where(F.col("count") > group)
    parts = F.ceil(F.col("count") / group).cast("bigint")
    dealt = (
        cut.join(large, "anchor", "left")
        .withColumn("split", F.col("count").isNotNull())
        .withColumn("share", F.when(F.col("split"), F.pmod(F.xxhash64("bytes", "id", "first"), parts)).otherwise(0))
        .drop("count")
    )
    names = ["anchor", "share", "ahead", "id", "text_hash", "first", "split", "bytes"]
    dealt = dealt.select(names).repartition("anchor", "share").sortWithinPartitions("anchor", "share")

    def settle(rows: list[tuple]):
        found = repeats_by_columns([r[7] for r in rows], [r[2] for r in rows], length)
        out = [(rows[k][3], rows[k][4], rows[k][5] + a << 32 | b - a, None, None, None) for k, a, b in found]
        ranges: dict[int, list] = {}
        told = set()
        for k, a, b in found:
            ranges.setdefault(k, []).append((a, b))
        for k, r in enumerate(rows):
            if r[6]:
                settled = np.zeros(len(r[7]) - length + 1, bool)
                for a, b in ranges.get(k, ()):
                    settled[a : b - length + 1] = True
                for (one, two), at, done in zip(_strings(r[7], length).view(np.int64).tolist(), range(r[5], r[5] + len(settled)), settled.tolist()):
                    if not done or (one, two) not in told:
                        out.append((r[3], r[4], at << 32 | length, one, two, done))
                        told.add((one, two) if done else None)
        return list(zip(*out)) if out else None

    def run_batches(batches):
        """Whole groups together, up to BATCH segments and one group."""
        held, current = [], []
        for columns in batches:
            for row in zip(*columns):
                if current and row[:2] != current[-1][:2]:
                    held += current
                    current = []
                    if len(held) >= BATCH:
                        if (out := settle(held)) is not None:
                            yield out
                        held = []
                current.append(row)
        if (held or current) and (out := settle(held + current)) is not None:
            yield out

    kind = docs.schema[id_col].dataType.simpleString()
    found = written(map_rows(dealt, run_batches, f"id {kind}, text_hash bigint, place bigint, h1 bigint, h2 bigint, done boolean"))
    # a split group's strings: true if settled in their task, else they ask whether another task has them
    together = Window.partitionBy("h1", "h2")
    asked = found.where("done is not null").withColumn("n", F.count("*").over(together)).where("not done and n > 1")
    hit = found.where("done is null").select("id", "text_hash", "place").unionByName(asked.select("id", "text_hash", "place")).unionByName(settled)
    return hit.groupBy("id", "text_hash").agg(F.collect_list("place").alias("places"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, run: int = RUN, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, kept (the remaining bytes), n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""

    def strip(batches):
        for ids, texts, places in batches:
            out = []
            for text, at in zip(texts, places):
                data = text.encode() if text else b""
                gone = covered(at, len(data)) if at else np.zeros(len(data), bool)
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if at else data
                out.append((kept, len(data), int(gone.sum()), len(runs(gone)) if at else 0, hashlib.sha256(kept).hexdigest()))
            yield ids, *zip(*out)

    found = repeated_places(docs, length, min(run, length), group, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return map_rows(_with_places(docs, found, id_col, text_col, ()), strip, schema)


