"""Document quality by a linear-chain conditional random field over lines.

Every line gets a label, good or bad, from features of its own and of the lines before and after it, and from the
labels of its neighbours. Forward-backward sums give the probability that a line is good; their mean, weighted by
length (bytes and the line's end), is the evidence for the document, and a logistic curve turns it into the score.

Lines carry their document's label in training. The sample is bounded by `most_documents` labelled rows (half of
each class, least hashes first) and, shortest texts first, by `most_lines` lines in all; its texts are whole. Scoring looks at whole texts
of all rows, and only at the text.

Null and empty texts are one empty line and get a score like any other. Repeated rows and ids get equal scores. Ids with
labels of both kinds aren't learnt from, nor are null labels. Without labels, or with one class, the score is the
smoothed share of good labels. An empty table gives an empty result. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redtide.llm.shared import text_or_empty

MOST_DOCUMENTS, MOST_LINES = 3000, 100_000
FOLDS = 5
THRESHOLD = 0.3
STEPS, RATE, DECAY = 200, 0.1, 1e-4
BATCH_LINES = 1 << 15  # lines whose features are held at once, or those of one document

OWN = """words word_length symbols bars marks digits upper distinct echoed closers starts_upper ends_sentence
empty short seen""".split()
#: Own features, a flag that there is a line, and both again for the line before and the line after.
WIDTH = 1 + 3 * (len(OWN) + 1)

_DIGITS, _SYMBOLS, _CLOSERS = b"0123456789", b"#*$%&<>", b".,;:"
_UPPER, _LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
_ENDS = (b".", b"!", b"?", b'"', b":", "…".encode(), "»".encode(), "”".encode())


def _share(line: bytes, drop: bytes, of: int) -> float:
    return (len(line) - len(line.translate(None, drop))) / of


def own_features(lines: list[bytes]) -> np.ndarray:
    """One row for each line of a document, all numbers of order one."""
    out, seen = np.zeros((len(lines), len(OWN)), np.float32), set()
    for k, line in enumerate(lines):
        words = line.split()
        n, size = len(words), max(1, len(line))
        letters = max(1, len(line) - len(line.translate(None, _LETTERS)))
        bare = line.strip()
        out[k] = (
            np.log1p(n) / 5,
            sum(map(len, words)) / max(1, n) / 10,
            min(1.0, 8 * _share(line, _SYMBOLS, size)),
            min(1.0, 8 * line.count(b"|") / size),
            min(1.0, 8 * line.count(b"!") / size),
            min(1.0, 4 * _share(line, _DIGITS, size)),
            _share(line, _UPPER, letters),
            len(set(words)) / max(1, n),
            sum(map(eq, words, words[1:])) / max(1, n - 1),
            min(1.0, 8 * _share(line, _CLOSERS, size)),
            bare[:1].isupper(),
            bare.endswith(_ENDS),
            n == 0,
            0 < n < 4,
            n > 0 and line in seen,
        )
        seen.add(line)
    return out


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of all lines with those of their neighbours, and the lengths of the lines."""
    lines = (text or "").encode().split(b"\n")
    own = own_features(lines)
    there = np.ones((len(lines), 1), np.float32)
    framed = np.zeros((len(lines) + 2, len(OWN) + 1), np.float32)
    framed[1:-1] = np.hstack([own, there])
    return np.hstack([there, framed[1:-1], framed[:-2], framed[2:]]), np.array([len(x) + 1 for x in lines], float)


def chain_batches(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chains of about one length together: (numbers of the chains, places of their lines, -1 behind the end)."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    sizes = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for size in np.unique(sizes):
        some = np.flatnonzero(sizes == size)
        step = np.arange(lengths[some].max())
        yield some, np.where(step < lengths[some][:, None], starts[some][:, None] + step, -1)


def forward_backward(gain: np.ndarray, there: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of label 1 [chain, line] and of neighbouring labels [chain, line, from, to] of padded chains."""
    score = np.stack([np.zeros_like(gain), gain], axis=2)
    ahead, behind = np.zeros_like(score), np.zeros_like(score)
    ahead[:, 0] = score[:, 0]
    length = gain.shape[1]
    for k in range(1, length):
        into = np.logaddexp(ahead[:, k - 1, 0, None] + moves[0], ahead[:, k - 1, 1, None] + moves[1]) + score[:, k]
        ahead[:, k] = np.where(there[:, k, None], into, ahead[:, k - 1])
    for k in range(length - 2, -1, -1):
        after = behind[:, k + 1] + score[:, k + 1]
        out = np.logaddexp(moves[:, 0] + after[:, 0, None], moves[:, 1] + after[:, 1, None])
        behind[:, k] = np.where(there[:, k + 1, None], out, 0)
    total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])[:, None]
    on = np.exp(np.clip(ahead[:, :, 1] + behind[:, :, 1] - total, -700, 0)) * there
    pairs = ahead[:, :-1, :, None] + moves + (behind[:, 1:] + score[:, 1:])[:, :, None, :] - total[:, :, None, None]
    return on, np.exp(np.clip(pairs, -700, 0)) * there[:, 1:, None, None]


@dataclass
class Model:
    """Weights of label good against bad, scores of neighbouring labels [from, to], and the logistic curve."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float
    offset: float

    def evidence(self, x: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Length-weighted mean probability of a good line for chains that lie one behind the other."""
        gain, out = x @ self.weights, np.zeros(len(lengths))
        for some, places in chain_batches(lengths):
            there = places >= 0
            on, _ = forward_backward(np.where(there, gain[places], 0), there, self.moves)
            weight = np.where(there, sizes[places], 0)
            out[some] = (on * weight).sum(1) / weight.sum(1)
        return out

    def scores(self, x: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * logit(self.evidence(x, sizes, lengths)) + self.offset)


def sigmoid(v):
    return 1 / (1 + np.exp(-np.clip(v, -500, 500)))


def logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def adam(start: np.ndarray, slopes, steps: int = STEPS) -> np.ndarray:
    """Steps up the gradient with running means of it and of its square."""
    at, first, second = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for step in range(1, steps + 1):
        g = slopes(at)
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        at += RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return at


def fit(x: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, good: np.ndarray) -> Model:
    """Maximum likelihood of the line labels, both classes weighing the same, then of the document labels."""
    width, share = WIDTH, (good.sum() + 1) / (len(good) + 2)
    if good.all() or not good.any():
        return Model(np.zeros(width), np.zeros((2, 2)), 0.0, float(logit(share)))
    weight = np.where(good, 0.5 / good.sum(), 0.5 / (~good).sum()) / lengths
    line_weight, line_good = np.repeat(weight, lengths), np.repeat(good, lengths)
    batches = list(chain_batches(lengths))
    kept = [(weight[some] * (good[some] == flag) * (lengths[some] - 1)).sum() for flag in (False, True) for some, _ in batches]
    seen = np.diag([sum(kept[: len(batches)]), sum(kept[len(batches) :])])

    def slopes(at):
        w, moves = at[:width], at[width:].reshape(2, 2)
        gain, on, pairs = x @ w, np.zeros(len(x)), np.zeros((2, 2))
        for some, places in batches:
            there = places >= 0
            p, q = forward_backward(np.where(there, gain[places], 0), there, moves)
            on[places[there]] = p[there]
            pairs += (q * weight[some][:, None, None, None]).sum((0, 1))
        return np.concatenate([x.T @ ((line_good - on) * line_weight), (seen - pairs).ravel()]) - DECAY * at

    found = adam(np.zeros(width + 4), slopes)
    model = Model(found[:width], found[width:].reshape(2, 2), 1.0, 0.0)
    at = logit(model.evidence(x, sizes, lengths))

    def curve(v):
        rest = good - sigmoid(v[0] * at + v[1])
        return np.array([(rest * at).mean(), rest.mean()]) - DECAY * v

    model.slope, model.offset = map(float, adam(np.array([1.0, 0.0]), curve))
    return model


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves no rest by FOLDS; false for a null id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % FOLDS == 0, F.lit(False))


def _batches(batches, text_at: int, others: list[int]):
    """(other columns, features, sizes, lengths) of some documents at a time, by the number of their lines."""
    for batch in batches:
        texts, first, made, lines = batch.column(text_at).to_pylist(), 0, [], 0
        for at, text in enumerate(texts):
            made.append(features(text))
            lines += len(made[-1][1])
            if lines >= BATCH_LINES or at == len(texts) - 1:
                columns = [batch.column(k).slice(first, len(made)) for k in others]
                yield columns, np.vstack([m[0] for m in made]), np.concatenate([m[1] for m in made]), np.array([len(m[1]) for m in made])
                first, made, lines = at + 1, [], 0


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_documents: int = MOST_DOCUMENTS, most_lines: int = MOST_LINES) -> Model:
    """Fit on labelled documents outside the held-out fold; their features are made in tasks."""
    ident = F.col(f"`{id_col}`").alias("_id")
    known = labels.where(~held_out(id_col)).where(F.col("quality").isNotNull()).groupBy(ident).agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
    known = known.where((F.col("lo") == F.col("hi")) & F.col("_id").isNotNull()).select("_id", (F.col("lo") == 1).alias("good"))
    texts = docs.select(ident, F.col(f"`{text_col}`").alias("_text"))
    order = [F.xxhash64("_id"), F.col("_id"), F.col("n")]
    sized = texts.select("_id", (F.length(F.regexp_replace(text_or_empty("_text"), "[^\n]", "")) + 1).alias("n"))
    # the sides of the labels are bounded first, so few texts move
    drawn = [known.where(F.col("good") == flag).orderBy(F.xxhash64("_id"), "_id").limit(most_documents) for flag in (True, False)]
    rows = []
    for side in drawn:
        rows += sized.join(F.broadcast(side), "_id").orderBy(*order).limit(most_documents // 2).collect()
    picked, total = [], 0
    for r in sorted(rows, key=lambda r: r.n):
        total += r.n
        if total <= most_lines:
            picked.append((r._id, r.good))
    spark = docs.sparkSession
    chosen = spark.createDataFrame(sorted(set(picked)), f"_id {known.schema['_id'].dataType.simpleString()}, good boolean")

    def run(batches):
        for (ids, good), x, sizes, lengths in _batches(batches, 1, [0, 2]):
            ends = np.cumsum(lengths)
            sizes_of = [sizes[e - n : e].tobytes() for e, n in zip(ends, lengths)]
            columns = [ids, good, pa.array([x[e - n : e].tobytes() for e, n in zip(ends, lengths)], pa.binary()), pa.array(sizes_of, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "good", "x", "sizes"])

    kind = known.schema["_id"].dataType.simpleString()
    # broadcast side: at most `most_documents` ids
    rows = texts.join(F.broadcast(chosen), "_id").select("_id", "_text", "good").mapInArrow(run, f"_id {kind}, good boolean, x binary, sizes binary").collect()
    rows.sort(key=lambda r: (r._id, r.x))
    x = np.vstack([np.zeros((0, WIDTH), np.float32), *[np.frombuffer(r.x, np.float32).reshape(-1, WIDTH) for r in rows]])
    sizes = np.concatenate([np.zeros(0), *[np.frombuffer(r.sizes) for r in rows]])
    return fit(x, sizes, np.array([len(r.sizes) // 8 for r in rows], int), np.array([r.good for r in rows], bool))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").alias("_text"))

    def run(batches):
        for (ids, held), x, sizes, lengths in _batches(batches, 2, [0, 1]):
            yield pa.RecordBatch.from_arrays([ids, held, pa.array(model.scores(x, sizes, lengths))], names=["_id", "held_out", "score"])

    kind = next(f.dataType.simpleString() for f in rows.schema if f.name == "_id")
    found = rows.mapInArrow(run, f"_id {kind}, held_out boolean, score double")
    return found.select(F.col("_id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
