"""Packing documents into sequences: first-fit decreasing with a tournament tree of bin capacities.

A document is cut into whole sequences and one remainder. Pieces are dealt to randomised groups of
bounded size and each group is packed on its own, longest piece first, into the first bin that has
room; a tournament tree over the free capacities finds that bin in logarithmic time.

A null text counts as empty and still has its end id. Equal rows are packed each for itself. An
empty table gives no pieces. Columns other than the id and the text are neither read nor kept.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redtide.llm.shared import map_rows, partitions_for
from redtide.llm.tokens import encoder
from redtide.session import written

LENGTH = 1024
GROUP = 16_384
SEED = 17


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", words: bool = False, with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, and the ids as
    little-endian unsigned 32-bit binary if asked for."""

    def run(batches):
        encode = encoder(tokenizer, words).encode
        end = np.uint32(end_id).astype("<u4").tobytes()
        for keys, texts in batches:
            out = []
            for key, text in zip(keys, texts):
                ids = encode(text) + end
                n = len(ids) // 4
                for at in range(0, n, length):
                    part = ids[4 * at : 4 * (at + length)]
                    out.append((key, at, len(part) // 4, zlib.crc32(part), n, part)[: 5 + with_ids])
            yield list(zip(*out))

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * with_ids
    return map_rows(docs.select(id_col, text_col), run, schema)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each size; `sizes` must not increase. Leaf k of the tree is the room left in bin k, and
    an inner node has the larger room of its children."""
    bins = np.empty(len(sizes), np.int64)
    full = int((sizes >= capacity).sum())
    bins[:full] = np.arange(full)
    rest = sizes[full:].tolist()
    leaves = 1 << max(0, len(rest) - 1).bit_length()
    room = [capacity] * (2 * leaves)
    for k, size in enumerate(rest):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[full + k] = full + node - leaves
        room[node] -= size
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins


def packed(cut: DataFrame, length: int = LENGTH, group: int = GROUP, id_col: str = "doc_id") -> DataFrame:
    """`cut` (see `pieces`, already written, so that it is read in the same order again) with
    sequence_id, and offset, the place of the piece in its sequence.

    The groups are dealt by a hash of the row's position, so rows that are all equal spread too.
    """
    groups = partitions_for(cut.count(), group)
    dealt = cut.withColumn("row_no", F.monotonically_increasing_id()).withColumn("pack_group", F.pmod(F.xxhash64("row_no", F.lit(SEED)), F.lit(groups)))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "row_no"], ascending=[False, True], ignore_index=True)
        bins = first_fit_decreasing(rows["length"].to_numpy(), length)
        rows["sequence_id"] = (rows["pack_group"].to_numpy(np.int64) << 32) + bins
        before = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
        rows["offset"] = before.astype("int64")
        return rows.drop(columns=["row_no", "pack_group"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return dealt.groupBy("pack_group").applyInPandas(pack, f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = LENGTH, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return packed(written(pieces(docs, tokenizer, end_id, length, id_col, text_col)), length, group, id_col)


def sequences(pieces_packed: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """The padded id sequences of packed pieces that carry their ids: (sequence_id, n_tokens, ids).

    A sequence is padded to `length`, except when its length is a power of two.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    pad = F.lit(np.uint32(pad_id).astype("<u4").tobytes().hex())
    n = F.sum("length")
    missing = F.when(F.bit_count(n) == 1, 0).otherwise(length - n)
    return pieces_packed.groupBy("sequence_id").agg(
        n.alias("n_tokens"), F.concat(joined, F.unhex(F.repeat(pad, missing.cast("int")))).alias("ids")
    )
