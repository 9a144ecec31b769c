"""Substring dedup on words: windows that occur more than once, found behind a count-min prefilter.

Every window of WINDOW words has an anchor, the least hash of the word runs in it; equal windows have
equal anchors. First pass: each partition counts its anchors in a sketch and the sketches are merged, so the
estimate of an anchor is at least the count of any of its windows. Second pass: only windows whose
anchor may occur twice are grouped exactly, by 128 bits over the whole word sequence. Windows that
meet inside a batch are settled there and one of them is sent on, so a very common passage
reaches the shuffle once for each batch.

A document is its id and its text: rows equal in both are two places of the same words and get the
same result. Null and empty texts have no words. Columns that are asked for in `extra` are carried
along; no others are read. A text takes about 100 bytes of memory a word while it is looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redtide.llm.rolling import BASES, anchors, window_hashes, window_minima
from redtide.llm.shared import map_rows, words_of
from redtide.llm.sketch import SCHEMA, Repeated, Sketch, merged, width_bits

WINDOW = 35
RUN = 8
CACHE_WORDS = 400_000
BYTES_A_WORD = 6


class WordHashes(dict):
    """128 bits of each word; forgets when it has become large."""

    def __missing__(self, word: bytes) -> bytes:
        self[word] = out = xxhash.xxh3_128_digest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, words)), "<u8").reshape(-1, 2)


def _anchored(words: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    grams = window_hashes(np.ascontiguousarray(words[:, 0]), run)
    return grams, window_minima(grams, window - run + 1)


def sketch_of(docs: DataFrame, text_col: str, window: int, run: int) -> Repeated:
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = width_bits(2 * size / BYTES_A_WORD / (window - run + 2))

    def count(batches):
        known, sketch = WordHashes(), Sketch(bits)
        for (texts,) in batches:
            found = []
            for text in texts:
                words = words_of(text)
                if len(words) >= window:
                    grams, least = _anchored(known.of(words), window, run)
                    found.append(grams[anchors(grams, least, window - run + 1)])
            if found:
                sketch.add(np.concatenate(found))
        rows = list(sketch.rows())
        for at in range(0, len(rows), 256):
            yield list(zip(*rows[at : at + 256]))

    return merged(map_rows(docs.select(text_col), count, SCHEMA), bits)


def _settle(h1: np.ndarray, h2: np.ndarray):
    """Order by hash, and which entries are followed or preceded by an equal one."""
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    equal = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    before = np.concatenate([[False], equal])
    return order, before, before | np.concatenate([equal, [False]])


def repeated_places(docs: DataFrame, window: int = WINDOW, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, places): the word ranges covered by repeated windows, as start << 32 | length."""
    may_repeat = docs.sparkSession.sparkContext.broadcast(sketch_of(docs, text_col, window, run))

    def look(batches):
        known, sketch = WordHashes(), may_repeat.value
        for ids, hashes, texts in batches:
            whose, where, one, two = [], [], [], []
            for k, text in enumerate(texts):
                words = words_of(text)
                if len(words) < window:
                    continue
                pairs = known.of(words)
                _, least = _anchored(pairs, window, run)
                at = np.flatnonzero(sketch(least))
                if len(at):
                    one.append(window_hashes(np.ascontiguousarray(pairs[:, 0]), window, BASES[0])[at])
                    two.append(window_hashes(np.ascontiguousarray(pairs[:, 1]), window, BASES[1])[at])
                    where.append(at)
                    whose.append(np.full(len(at), k))
            if not whose:
                continue
            h1, h2, where, whose = (np.concatenate(x) for x in (one, two, where, whose))
            order, repeat, settled = _settle(h1, h2)
            sent = order[~repeat]
            done = np.zeros(len(h1), bool)
            done[order] = settled
            h1, h2 = h1.view(np.int64), h2.view(np.int64)
            place = (where << 32) | window
            take = lambda column, at: [column[k] for k in whose[at].tolist()]
            # windows to be grouped; those settled here only tell others that they exist
            yield take(ids, sent), take(hashes, sent), h1[sent], h2[sent], place[sent], done[sent]
            own = _ranges(whose[done], where[done], window)
            if own:
                k, place = zip(*own)
                n = len(k)
                yield [ids[i] for i in k], [hashes[i] for i in k], np.array(place) ^ np.arange(n), np.arange(n), place, [None] * n

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), text_col)
    found = map_rows(rows, look, f"id {kind}, text_hash bigint, h1 bigint, h2 bigint, place bigint, done boolean")
    # `done` is null for ranges that are certain already, true for windows that are among them
    together = Window.partitionBy("h1", "h2", F.isnull("done"))
    hit = found.withColumn("n", F.count("*").over(together)).where("done is null or (not done and n > 1)")
    return hit.groupBy("id", "text_hash").agg(F.collect_list("place").alias("places"))


def _ranges(whose: np.ndarray, where: np.ndarray, window: int) -> list[tuple[int, int]]:
    """(document, start << 32 | length) of the runs of consecutive windows."""
    order = np.lexsort((where, whose))
    whose, where = whose[order], where[order]
    cut = np.flatnonzero((whose[1:] != whose[:-1]) | (where[1:] != where[:-1] + 1)) + 1
    if not len(whose):
        return []
    firsts, lasts = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(whose) - 1]])
    return [(int(whose[a]), int(where[a]) << 32 | int(where[b] - where[a] + window)) for a, b in zip(firsts, lasts)]


def covered(places: list[int] | None, n: int) -> np.ndarray:
    """Which of n units lie in a range."""
    change = np.zeros(n + 1, np.int64)
    if places:
        at = np.asarray(places, np.int64)
        start = at >> 32
        np.add.at(change, start, 1)
        np.add.at(change, start + (at & 0xFFFFFFFF), -1)
    return np.cumsum(change[:-1]) > 0


def _with_places(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, extra: tuple[str, ...]) -> DataFrame:
    found = found.withColumnsRenamed({"id": "found_id", "text_hash": "found_hash"})
    same = F.col(id_col).eqNullSafe(F.col("found_id")) & (F.xxhash64(text_col) == F.col("found_hash"))
    return docs.select(id_col, text_col, *extra).join(found, same, "left").select(id_col, text_col, "places", *extra)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = (), spaced: bool = True) -> DataFrame:
    """id, kept (words joined by one space; with spaced=False a text that loses nothing stays as it is), n_words, n_removed, kept_sha256 and the columns of `extra`."""

    def strip(batches):
        for ids, texts, places, *rest in batches:
            out = []
            for text, at in zip(texts, places):
                words = words_of(text)
                gone = covered(at, len(words))
                kept = b" ".join(w for w, x in zip(words, gone.tolist()) if not x) if at else b" ".join(words)
                if not at and not spaced:
                    kept = (text or "").encode()
                out.append((kept.decode(), len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            yield ids, *zip(*out), *rest

    found = repeated_places(docs, window, min(RUN, window), id_col, text_col)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = f"`{id_col}` {kinds[id_col]}, kept string, n_words bigint, n_removed bigint, kept_sha256 string" + "".join(f", `{c}` {kinds[c]}" for c in extra)
    return map_rows(_with_places(docs, found, id_col, text_col, extra), strip, schema)

