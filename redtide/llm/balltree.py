"""Ranked lexical search: exact inner products over sparse ball trees.

Terms are the maximal matches of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, with A-Z lower-cased. A document is a sparse
vector of integer impacts, one for each term of the queries; a query holds how often its terms occur. The score is
the inner product of the two, all in whole numbers. Tasks read blocks of documents, build a tree of balls
(centroid, radius) over each block and visit, query by query, the subtrees in falling order of the bound
`q . centroid + sum over g of |q_g| radius_g`, where g runs over groups of terms of similar weight and q_g holds the
query's terms of the group that occur in the ball: one radius over all terms is nearly the length of a document, as
texts share few rare terms, and would prune nothing. A subtree is left out only if its bound, rounded up by
more than the arithmetic can lose, is below the query's k-th best score so far; what is visited is scored exactly at the leaves. The best of
a task's earlier blocks, and of a first look at the documents with the smallest hashes, count as k-th best.

Statistics (N, L, df) cover all documents. Queries are taken in blocks of bounded text, each against all rows.

Null and empty texts have no terms: such a document counts nowhere and is never returned, and such a
query has no rows. Scores of zero are not returned. Repeated documents are ranked one by one; a null id ranks
behind all others of the same score. Equal queries (id and text) are answered once, queries that share
an id each by their own. Empty tables give an empty result. Further columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from redtide.llm.shared import partitions_for, text_or_empty
from redtide.session import written

TOP = 20
QUERY_TEXT = 1 << 20  # characters of queries answered together
BLOCK_ROWS, BLOCK_ENTRIES = 4096, 1 << 18  # documents and entries of one tree
LEAF_ROWS = 16
GROUPS = 16  # of terms by weight, each with a radius of its own
MOST_CELLS = 1 << 22  # numbers in one dense table of a tree
FIRST_LOOK = 4096  # documents whose scores give the first bounds
#: Relative loss allowed for in sums of doubles; a sum of a million terms loses less than 1e-9.
SLACK = 1e-9

_APART = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes(32 if c in _APART and not 65 <= c <= 90 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Lower-cased terms as UTF-8: separators become blanks, and bytes of longer characters stay as they are."""
    return text.encode().translate(_TABLE).split(b" ") if text else []


def term_counts(text: str | None) -> Counter:
    found = Counter(terms(text))
    found.pop(b"", None)
    return found


def index_rows(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, cols, tfs) of every document with a term: its number of terms, and those of the vocabulary."""
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))

    def run(batches):
        for batch in batches:
            keep, ns, cols, tfs = [], [], [], []
            for at, text in enumerate(batch.column(1).to_pylist()):
                counts = term_counts(text)
                if not counts:
                    continue
                known = sorted((vocabulary[t], c) for t, c in counts.items() if t in vocabulary)
                keep.append(at)
                ns.append(counts.total())
                cols.append([t for t, _ in known])
                tfs.append([c for _, c in known])
            if keep:
                columns = [batch.column(0).take(pa.array(keep)), pa.array(ns, pa.int64()), pa.array(cols, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "n", "cols", "tfs"])

    kind = next(f.dataType.simpleString() for f in rows.schema if f.name == "_id")
    return rows.mapInArrow(run, f"_id {kind}, n bigint, cols array<int>, tfs array<bigint>")


def term_weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Impacts:
    """Integer vectors of documents from their counts, the weights of the terms, N and L."""

    def __init__(self, weights: np.ndarray, n_docs: int, n_terms: int):
        self.weights, self.n_docs, self.n_terms = weights, n_docs, n_terms

    def of(self, n: int, cols: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        m = 75 + (25 * n * self.n_docs) // self.n_terms
        return self.weights[cols] * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * m))


class Tree:
    """Balls over the rows of one block; only the columns that occur in the block are held.

    A leaf is a range of `order`, and the entries of its rows lie side by side.
    """

    def __init__(self, cols: list[np.ndarray], values: list[np.ndarray], group_of: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.columns, flat = np.unique(np.concatenate(cols), return_inverse=True)
        self.group = group_of[self.columns]
        self.members = [np.flatnonzero(self.group == g) for g in range(GROUPS)]
        self.flat, self.values = flat, np.concatenate(values)
        self.starts = np.concatenate([[0], np.cumsum([len(c) for c in cols])])
        self.real = self.values.astype(float)
        owner = np.repeat(np.arange(len(cols)), np.diff(self.starts))
        self.squares = self._by_group(owner, flat, self.real * self.real, len(cols))
        # all centroids together hold at most MOST_CELLS numbers, or there is one leaf
        self.leaf_rows = max(leaf_rows, 4 * len(cols) * len(self.columns) // MOST_CELLS)
        self.order, self.centroids, self.radii, self.kids, self.ranges = np.arange(len(cols)), [], [], [], []
        self._grow(0, len(cols))
        self.centroids, self.radii = np.array(self.centroids), np.array(self.radii)
        at, _ = self._entries(self.order)
        self.flat, self.values = self.flat[at], self.values[at]
        self.starts = np.concatenate([[0], np.cumsum(np.diff(self.starts)[self.order])])

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows' entries, and the number of the row in `rows` each belongs to."""
        lengths = self.starts[rows + 1] - self.starts[rows]
        owner = np.repeat(np.arange(len(rows)), lengths)
        ahead = np.cumsum(lengths) - lengths
        return np.arange(lengths.sum()) - ahead[owner] + self.starts[rows][owner], owner

    def _by_group(self, owner: np.ndarray, flat: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
        return np.bincount(owner * GROUPS + self.group[flat], values, rows * GROUPS).reshape(rows, GROUPS)

    def _far(self, rows: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Upper bounds of the squared distances in each group: what cancellation can lose is added."""
        at, owner = self._entries(rows)
        products = self._by_group(owner, self.flat[at], self.real[at] * point[self.flat[at]], len(rows))
        size = np.bincount(self.group, point * point, GROUPS)
        return np.maximum(self.squares[rows] - 2 * products + size, 0) + SLACK * (self.squares[rows] + size)

    def _point(self, row: int) -> np.ndarray:
        out = np.zeros(len(self.columns))
        part = slice(self.starts[row], self.starts[row + 1])
        out[self.flat[part]] = self.real[part]
        return out

    def _grow(self, low: int, high: int) -> int:
        rows = self.order[low:high]
        at, _ = self._entries(rows)
        centroid = np.bincount(self.flat[at], self.real[at], len(self.columns)) / len(rows)
        far = self._far(rows, centroid)
        node = len(self.radii)
        self.centroids.append(centroid)
        self.radii.append(np.sqrt(far.max(0)) * (1 + SLACK))
        self.kids.append(None)
        self.ranges.append((low, high))
        if len(rows) > self.leaf_rows:
            one = self._point(rows[np.argmax(far.sum(1))])
            from_one = self._far(rows, one).sum(1)
            side = from_one - self._far(rows, self._point(rows[np.argmax(from_one)])).sum(1)
            half = low + len(rows) // 2
            self.order[low:high] = rows[np.argsort(side, kind="stable")]
            self.kids[node] = (self._grow(low, half), self._grow(half, high))
        return node

    def bounds(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """For each node and query at least the largest product of the query with a row of the node."""
        out = np.empty((len(self.radii), len(queries)))
        present = (self.centroids > 0).astype(float)
        step = max(1, MOST_CELLS // len(self.columns))
        for first in range(0, len(queries), step):
            some = queries[first : first + step]
            dense = np.zeros((len(self.columns), len(some)))
            for k, (cols, counts) in enumerate(some):
                dense[cols, k] = counts
            total = self.centroids @ dense
            for g, here in enumerate(self.members):
                total += self.radii[:, g, None] * np.sqrt(present[:, here] @ (dense[here] ** 2))
            out[:, first : first + step] = total * (1 + SLACK) + 1
        return out

    def search(self, query: tuple[np.ndarray, np.ndarray], bounds: np.ndarray, best: Best) -> int:
        """Offer all rows that could be among the best; returns how many leaves were scored."""
        counts = np.zeros(len(self.columns), np.int64)
        counts[query[0]] = query[1]
        queue, scored = [(-bounds[0], 0)], 0
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < best.least():
                break
            if self.kids[node]:
                for child in self.kids[node]:
                    if bounds[child] >= best.least():
                        heapq.heappush(queue, (-bounds[child], child))
                continue
            scored += 1
            low, high = self.ranges[node]
            first, last = self.starts[low], self.starts[high]
            found = np.add.reduceat(self.values[first:last] * counts[self.flat[first:last]], self.starts[low:high] - first)
            for at in np.flatnonzero(found >= best.least()):
                best.offer(int(found[at]), int(self.order[low + at]))
        return scored


class Best:
    """The k best (score, id) so far; `floor` is a score that k documents are known to reach."""

    def __init__(self, k: int, floor: int = 1):
        self.k, self.floor, self.heap, self.ids = k, max(1, floor), [], []

    def least(self) -> int:
        return max(self.floor, self.heap[0][0]) if len(self.heap) == self.k else self.floor

    def offer(self, score: int, row: int) -> None:
        ident = self.ids[row]
        order = (score, ident is not None, -ident if isinstance(ident, int) else _Reversed(ident), ident)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, order)
        elif order[:3] > self.heap[0][:3]:
            heapq.heapreplace(self.heap, order)


class _Reversed:
    """Ids that aren't integers, in falling order; null compares equal to null."""

    def __init__(self, value):
        self.value = value

    def __lt__(self, other):
        return self.value is not None and other.value is not None and other.value < self.value

    def __eq__(self, other):
        return self.value == other.value


def blocks(batches: Iterable[pa.RecordBatch], impacts: Impacts) -> Iterator[tuple[list, list, list]]:
    """(ids, cols, values) of the documents with an impact, some thousand at a time."""
    ids, cols, values, entries = [], [], [], 0
    for batch in batches:
        for ident, n, col, tf in zip(*(c.to_pylist() for c in batch.columns)):
            col = np.array(col, np.int64)
            value = impacts.of(n, col, np.array(tf, np.int64))
            some = np.flatnonzero(value)
            if not len(some):
                continue
            ids.append(ident)
            cols.append(col[some])
            values.append(value[some])
            entries += len(some)
            if len(ids) >= BLOCK_ROWS or entries >= BLOCK_ENTRIES:
                yield ids, cols, values
                ids, cols, values, entries = [], [], [], 0
    if ids:
        yield ids, cols, values


def weight_groups(weights: np.ndarray) -> np.ndarray:
    """Group of each term: GROUPS equal shares of the terms in order of weight."""
    order = np.argsort(np.argsort(weights, kind="stable"), kind="stable")
    return (order * GROUPS // max(1, len(weights))).astype(np.int64)


def search_blocks(
    found: Iterable[tuple[list, list, list]], queries: list[tuple[np.ndarray, np.ndarray]], top: int, floors: list[int], group_of: np.ndarray
) -> list[Best]:
    """The best documents of all blocks for each query, by one tree a block."""
    bests = [Best(top, f) for f in floors]
    for ids, cols, values in found:
        tree = Tree(cols, values, group_of)
        local = []
        for q_cols, q_counts in queries:
            at = np.searchsorted(tree.columns, q_cols).clip(max=len(tree.columns) - 1)
            here = tree.columns[at] == q_cols
            local.append((at[here], q_counts[here]))
        bounds = tree.bounds(local)
        for k, (query, best) in enumerate(zip(local, bests)):
            best.ids = ids
            if len(query[0]):
                tree.search(query, bounds[:, k], best)
    return bests


def _searched(index: DataFrame, impacts: Impacts, queries: list, top: int, floors: list[int]) -> DataFrame:
    """(query, id, score): the best of every task."""
    group_of = weight_groups(impacts.weights)

    def run(batches):
        kind = None

        def watched():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        bests = search_blocks(blocks(watched(), impacts), queries, top, floors, group_of)
        rows = [(k, entry[3], entry[0]) for k, best in enumerate(bests) for entry in best.heap]
        if rows:
            ks, ids, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(ids, kind), pa.array(scores, pa.int64())], names=["query", "_id", "score"])

    kind = next(f.dataType.simpleString() for f in index.schema if f.name == "_id")
    return index.select("_id", "n", "cols", "tfs").mapInArrow(run, f"query int, _id {kind}, score bigint")


def _answer(docs: DataFrame, asked: list[Row], id_col: str, text_col: str, top: int) -> DataFrame:
    """(query, id, score, rank) for one block of queries."""
    counts = [term_counts(r.text) for r in asked]
    vocabulary = {t: k for k, t in enumerate(sorted(set().union(*counts)))}
    index = written(index_rows(docs, vocabulary, id_col, text_col))
    n_docs, n_terms = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    # at most one row a term of this block of queries
    df = {r.t: r.c for r in index.select(F.explode("cols").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c")).collect()}
    weights = np.zeros(len(vocabulary) + 1, np.int64)
    for t, c in df.items():
        weights[t] = term_weight(c, n_docs)
    impacts = Impacts(weights, n_docs, n_terms or 1)
    queries = []
    for c in counts:
        pairs = sorted((vocabulary[t], k) for t, k in c.items() if weights[vocabulary[t]])
        queries.append((np.array([t for t, _ in pairs], np.int64), np.array([k for _, k in pairs], np.int64)))
    # any k documents bound the k-th best from below: about FIRST_LOOK with the smallest hashes are looked at first
    share = F.lit(min(1.0, FIRST_LOOK / max(1, n_docs)))
    look = index.where(F.xxhash64("_id", "n", "cols") <= (share * 2.0**64 - 2.0**63)).limit(2 * FIRST_LOOK).coalesce(1)
    first = _searched(look, impacts, queries, top, [1] * len(queries))
    seen = first.groupBy("query").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("least")).collect()
    floors = {r["query"]: r.least for r in seen if r.c == top}
    offers = _searched(index, impacts, queries, top, [floors.get(k, 1) for k in range(len(queries))])
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("_id").asc_nulls_last())
    return offers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    query_text: int = QUERY_TEXT,
) -> DataFrame:
    """(item id, rank, id, score): the `top` documents of largest positive score for each item."""
    asked = items.select(F.col(f"`{item_col}`").alias("item"), text_or_empty(f"`{item_text}`").alias("text")).where("text != ''").distinct()
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = partitions_for(size, query_text)
    spark, out = docs.sparkSession, None
    number = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    asked = written(asked.withColumn("part", number))
    for part in range(parts):
        some = sorted(asked.where(F.col("part") == part).collect(), key=lambda r: (r.item is None, r.item, r.text))
        if not some:
            continue
        names = spark.createDataFrame([(k, r.item) for k, r in enumerate(some)], f"query int, item {asked.schema['item'].dataType.simpleString()}")
        found = _answer(docs, some, id_col, text_col, top).join(F.broadcast(names), "query")
        found = found.select(F.col("item").alias(item_col), "rank", F.col("_id").alias(id_col), "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.limit(0).select(F.lit(None).cast(asked.schema["item"].dataType).alias(item_col), F.lit(0).alias("rank"), F.col(f"`{id_col}`").alias(id_col), F.lit(0).cast("bigint").alias("score"))
    return out
