"""Document quality: base rules, and a linear-chain conditional random field over lines.

The field labels each line content (1) or boilerplate (0); Viterbi decoding gives the best label
sequence and the share of words in content lines decides whether the document stays.

Training takes documents with a known quality: at most MOST_DOCUMENTS of them, the ones with the least
hash of their id, so the sample doesn't depend on partitions. Their texts are whole. Lines of good documents count as
content and lines of bad ones as boilerplate. Everything else looks at all rows.

Null and empty texts have no words, fail the base rules and are not kept. Equal rows are judged
alike. Without any labelled documents, or with one class only, every line is content.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redtide.llm.classifier import adam, chain_batches, forward_backward
from redtide.llm.shared import SPACES, map_rows, words_of

MOST_DOCUMENTS = 3000
AT_ONCE = 512  # documents of a batch that a task holds as objects
STEPS, DECAY = 250, 1e-3
CONTENT_SHARE = 0.5
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent of the words
_ENDS = (".", "!", "?", "…", '"', "»", "”", ":")

FEATURES = """bias words mean_length symbols digits upper bars marks repeated ends_sentence starts_upper
short long punctuation first last""".split()


def line_features(lines: list[str]) -> np.ndarray:
    """One row for each line, all numbers of order one."""
    out, seen = np.zeros((len(lines), len(FEATURES))), set()
    for k, line in enumerate(lines):
        words = line.split()
        n, chars = len(words), max(1, len(line))
        letters = max(1, sum(map(str.isalpha, line)))
        bare = line.strip()
        out[k] = (
            1,
            np.log1p(n) / 5,
            sum(map(len, words)) / max(1, n) / 10,
            min(1.0, 5 * sum(line.count(c) for c in SYMBOLS) / chars),
            min(1.0, 5 * sum(map(str.isdigit, line)) / chars),
            sum(map(str.isupper, line)) / letters,
            min(1.0, 10 * line.count("|") / chars),
            min(1.0, 10 * line.count("!") / chars),
            line in seen,
            bare.endswith(_ENDS),
            bare[:1].isupper(),
            n < 4,
            n > 100,
            min(1.0, 5 * sum(line.count(c) for c in ".,;:") / chars),
            k == 0,
            k == len(lines) - 1,
        )
        seen.add(line)
    return out


@dataclass
class Field:
    """Weights of a two-label chain: label 1 against 0 for each feature, and transitions [from, to]."""

    weights: np.ndarray
    moves: np.ndarray

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The most probable labels; on a tie a line is content."""
        gain = features @ self.weights
        best, back = np.array([0.0, gain[0]]), np.zeros((len(gain), 2), np.int8)
        m = self.moves
        for k in range(1, len(gain)):
            to0, to1 = (best[0] + m[0, 0], best[1] + m[1, 0]), (best[0] + m[0, 1], best[1] + m[1, 1])
            back[k] = to0[1] >= to0[0], to1[1] >= to1[0]
            best = np.array([max(to0), max(to1) + gain[k]])
        labels = np.zeros(len(gain), np.int8)
        labels[-1] = best[1] >= best[0]
        for k in range(len(gain) - 1, 0, -1):
            labels[k - 1] = back[k, labels[k]]
        return labels


def fit(texts: list[str], good: list[bool]) -> Field:
    """`fit_chains` on whole texts."""
    chains = [line_features(t.split("\n")) for t in texts]
    x = np.vstack([np.zeros((0, len(FEATURES))), *chains])
    return fit_chains(x, np.array([len(c) for c in chains], int), np.asarray(good, dtype=bool))


def fit_chains(x: np.ndarray, lengths: np.ndarray, good: np.ndarray) -> Field:
    """Maximum likelihood by gradient steps with forward-backward sums; chains of about one length are padded together.

    `x` has the features of all lines, chain after chain. Both classes, and all chains of a class, weigh the same.
    """
    width = len(FEATURES)
    if not len(good) or good.all() or not good.any():
        return Field(np.zeros(width), np.zeros((2, 2)))
    weight = np.where(good, 0.5 / good.sum(), 0.5 / (~good).sum()) / lengths
    line_weight, line_good = np.repeat(weight, lengths), np.repeat(good, lengths)
    batches = list(chain_batches(lengths))
    seen = np.diag([(weight * (good == flag) * (lengths - 1)).sum() for flag in (False, True)])

    def slopes(at):
        w, moves = at[:width], at[width:].reshape(2, 2)
        gain, on, pairs = x @ w, np.zeros(len(x)), np.zeros((2, 2))
        for some, places in batches:
            there = places >= 0
            p, q = forward_backward(np.where(there, gain[places], 0), there, moves)
            on[places[there]] = p[there]
            pairs += (q * weight[some][:, None, None, None]).sum((0, 1))
        return np.concatenate([x.T @ ((line_good - on) * line_weight), (seen - pairs).ravel()]) - DECAY * at

    found = adam(np.zeros(width + 4), slopes, STEPS)
    return Field(found[:width], found[width:].reshape(2, 2))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_DOCUMENTS) -> DataFrame:
    """(text, good) of at most `most` labelled documents, half of each class where there are so many.

    The sample is bounded on the side of the labels first, so that few texts move.
    """
    known = labels.where("quality is not null").select(F.col(id_col).alias("labelled_id"), (F.col("quality") == 1).alias("good")).distinct()
    order = [F.xxhash64("labelled_id"), F.col("labelled_id")]
    picked = [known.where(F.col("good") == flag).orderBy(*order).limit(most // 2) for flag in (True, False)]
    few = picked[0].union(picked[1])
    texts = docs.select(F.col(id_col).alias("labelled_id"), F.col(text_col).alias("t")).where("t is not null")
    return texts.join(F.broadcast(few), "labelled_id").groupBy("labelled_id", "good").agg(F.min("t").alias("t"))


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_DOCUMENTS) -> Field:
    """Fit on the training rows; tasks turn their whole texts into features."""

    def run(batches):
        for texts, good in batches:
            made = [line_features(t.split("\n")) for t in texts]
            yield [hashlib.sha256(t.encode()).digest() for t in texts], good, [m.astype(np.float32).tobytes() for m in made]

    rows = map_rows(training_rows(docs, labels, id_col, text_col, most).select("t", "good"), run, "digest binary, good boolean, x binary").collect()
    rows.sort(key=lambda r: (bytes(r.digest), r.good))
    chains = [np.frombuffer(r.x, np.float32).reshape(-1, len(FEATURES)).astype(float) for r in rows]
    x = np.vstack([np.zeros((0, len(FEATURES))), *chains])
    return fit_chains(x, np.array([len(c) for c in chains], int), np.array([r.good for r in rows], bool))


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words that lie in windows found twice or more in the text, the first one included."""
    windows = list(zip(*(words[i:] for i in range(window))))
    if len(set(windows)) == len(windows):
        return 0
    counts, reach, total = Counter(windows), 0, 0
    for at, w in enumerate(windows):
        if counts[w] > 1:
            total += at + window - max(at, reach)
            reach = at + window
    return total


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text, words = text or "", words_of(text)
    seen, equal = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            equal += line in seen
            seen.add(line)
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, sum(map(text.count, SYMBOLS)), equal, repeated_words(words)


def content_share(text: str, field: Field) -> float:
    """Share of the words that stand in lines labelled content."""
    lines = text.split("\n")
    weights = np.array([len(words_of(line)) for line in lines], dtype=float)
    labels = field.decode(line_features(lines))
    return float((weights * labels).sum() / weights.sum()) if weights.sum() else 0.0


def judge(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """The base counts, base_failed, content_share and kept of every row, beside the columns in `extra`."""

    def run(batches):
        for ids, texts, *rest in batches:
            counts = [base_counts(t) for t in texts]
            failed = [c[0] < LEAST_WORDS or 100 * c[4] > MOST_REPEATED * c[0] for c in counts]
            shares = [content_share(t, field) if c[0] else 0.0 for t, c in zip(texts, counts)]
            kept = [not f and s >= CONTENT_SHARE for f, s in zip(failed, shares)]
            yield ids, *zip(*counts), failed, shares, kept, texts, *rest

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = f"`{id_col}` {kinds[id_col]}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, content_share double, kept boolean"
    if not extra:
        return map_rows(docs.select(id_col, text_col), lambda b: (x[:9] for x in run(b)), schema, AT_ONCE)
    schema += "".join(f", `{c}` {kinds[c]}" for c in (text_col, *extra))
    return map_rows(docs.select(id_col, text_col, *extra), run, schema, AT_ONCE)
