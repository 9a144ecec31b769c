"""Document fingerprints from closed syncmers, with DataFrame functions only.

A text is its sequence of word hashes. A run of K words is chosen if the least hash among its inner
runs of S words stands at one of its two edges. Whether a run is chosen depends on its own words only,
so the same passage gives the same anchors wherever it stands, and every second run or so is one.

A fingerprint is the SKETCH least distinct anchor hashes; the likeness of two is the share of the
least hashes of both together that are in both, an estimate of the Jaccard likeness of the anchors.

Null texts count as empty and have an empty fingerprint; texts of fewer than K words are one anchor.
Equal texts have equal fingerprints. Rows with one id are ordered by their text; a null id comes
first. An empty table gives no rows. Columns other than the id and the text are neither read nor kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redtide.llm.shared import WORD_SPACE, partitions_for

K, S = 5, 2
SKETCH = 64
LOW = (1 << 32) - 1
FIRST_ID = -(1 << 63)
ROWS_A_BUCKET = 4096
MOST_BUCKETS = 4096


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(text, WORD_SPACE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def inner_hashes(words: Column, s: int = S) -> Column:
    """Hash of each run of s words."""
    if s == 1:
        return words
    places = F.when(F.size(words) >= s, F.sequence(F.lit(1), F.size(words) - (s - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + (j - 1)) for j in range(s)]))


def anchor_places(inner: Column, k: int = K, s: int = S) -> Column:
    """Places (from 0) of the closed syncmers, given the hashes of the inner runs."""
    n = k - s + 1
    places = F.when(F.size(inner) >= n, F.sequence(F.lit(0), F.size(inner) - n)).otherwise(F.array().cast("array<int>"))

    def closed(i):
        at = [F.get(inner, i + j) for j in range(n)]
        middle = F.least(*at[1:-1]) if n > 3 else at[n // 2]
        return (F.least(at[0], at[-1]) <= middle) if n > 2 else F.lit(True)

    return F.filter(places, closed)


def anchor_hash(words: Column, at: Column, k: int = K) -> Column:
    return F.xxhash64(*[F.get(words, at + j) for j in range(k)]).bitwiseAND(F.lit(LOW))


def with_fingerprint(df: DataFrame, text: Column, name: str, k: int = K, s: int = S, sketch: int = SKETCH) -> DataFrame:
    """Adds the column `name`: the least distinct anchor hashes, in order."""
    df = df.withColumn(f"{name}_w", word_hashes(text)).withColumn(f"{name}_g", inner_hashes(F.col(f"{name}_w"), s))
    words, inner = F.col(f"{name}_w"), F.col(f"{name}_g")
    found = F.transform(anchor_places(inner, k, s), lambda i: anchor_hash(words, i, k))
    short = F.when(F.size(words) > 0, F.array(F.xxhash64(words).bitwiseAND(F.lit(LOW)))).otherwise(F.array().cast("array<bigint>"))
    least = F.slice(F.sort_array(F.array_distinct(F.when(F.size(words) >= k, found).otherwise(short))), 1, sketch)
    return df.withColumn(name, least).drop(f"{name}_w", f"{name}_g")


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def likeness(a: Column, b: Column, sketch: int = SKETCH) -> Column:
    """From 0 to 1; two empty fingerprints are alike."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, sketch)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """(id, position, anchor) of every closed syncmer, for positional matching."""
    df = docs.select(F.col(id_col), word_hashes(F.coalesce(text_col, F.lit(""))).alias("w")).withColumn("g", inner_hashes(F.col("w"), s))
    at = F.when(F.size("w") >= k, anchor_places(F.col("g"), k, s)).otherwise(F.array().cast("array<int>"))
    return df.select(id_col, "w", F.explode(at).alias("position")).select(id_col, "position", anchor_hash(F.col("w"), F.col("position"), k).alias("anchor"))


def shared_runs(a: DataFrame, b: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(a_id, b_id, shift, n_anchors, first, last): anchors of two anchor tables that match with one shift
    of position, which is what a copied passage looks like."""
    left = a.select(F.col(id_col).alias("a_id"), F.col("position").alias("p"), "anchor")
    right = b.select(F.col(id_col).alias("b_id"), F.col("position").alias("q"), "anchor")
    met = left.join(right, "anchor").withColumn("shift", F.col("q") - F.col("p"))
    return met.groupBy("a_id", "b_id", "shift").agg(F.count("*").alias("n_anchors"), F.min("p").alias("first"), F.max("p").alias("last"))


def _buckets(docs: DataFrame) -> tuple[list[int], dict[int, int]]:
    """Bounds of ranges of ids with few rows each, and for the first id of each range the range before it
    (the last one for the very first). At most MOST_BUCKETS numbers reach the driver."""
    n = docs.count()
    if not n:
        return [], {}
    wanted = min(MOST_BUCKETS, partitions_for(n, ROWS_A_BUCKET))
    steps = [k / wanted for k in range(1, wanted)]
    cuts = docs.agg(F.percentile_approx("sort_id", steps, 10_000)).first()[0] if steps else []
    cuts = sorted(set(cuts or []))
    firsts = docs.groupBy(_bucket(cuts).alias("bucket")).agg(F.min("sort_id").alias("first")).collect()
    firsts = sorted((r["bucket"], r["first"]) for r in firsts)
    return cuts, {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}


def _bucket(cuts: list[int]) -> Column:
    if not cuts:
        return F.lit(0)
    bounds = F.array(*[F.lit(c).cast("bigint") for c in cuts])
    return F.size(F.filter(bounds, lambda c: c <= F.col("sort_id")))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Window]:
    """Every document once, and the first of each range of ids once more behind the range before it (own is false
    there). Returned with the window in which the next row is the next document."""
    rows = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("text"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(FIRST_ID)).alias("sort_id"))
    cuts, before = _buckets(rows.select("sort_id"))
    own = F.struct(_bucket(cuts).alias("bucket"), F.lit(True).alias("own"))
    copies = F.array(own)
    if before:
        # ids of firsts and their targets, as two arrays of one order
        ids, targets = F.array(*[F.lit(i).cast("bigint") for i in before]), F.array(*[F.lit(b) for b in before.values()])
        place = F.array_position(ids, F.col("sort_id"))
        also = F.struct(F.get(targets, (place - 1).cast("int")).alias("bucket"), F.lit(False).alias("own"))
        copies = F.when(place > 0, F.array(own, also)).otherwise(copies)
    dealt = rows.withColumn("copy", F.explode(copies)).select(id_col, "text", "sort_id", "copy.bucket", "copy.own")
    return dealt, Window.partitionBy("bucket").orderBy(F.col("own").desc(), "sort_id", "text")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: n_chars, the edited text (its last half replaced by the start of the next
    document's text), fingerprints of both, and the likeness to the edited text and to the next document."""
    rows, order = with_next(docs, id_col, text_col)
    rows = rows.withColumn("next_text", F.lead("text").over(order))
    rows = with_fingerprint(rows, F.col("text"), "fp")
    rows = rows.withColumn("next_fp", F.lead("fp").over(order)).where("own")
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = with_fingerprint(rows, F.col("edited"), "edited_fp")
    return rows.select(
        id_col,
        n.cast("bigint").alias("n_chars"),
        "edited",
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
