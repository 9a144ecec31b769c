"""SentencePiece encoding and decoding with a relational lattice.

A text, its spaces replaced by marks, is cut into words at every border whose two characters stand side by
side in no piece of the vocabulary, so no piece crosses it. Each distinct word is encoded once for many documents: its substrings of up to the longest piece's length are exploded and joined to the piece
table, the edges are grouped by word, and a higher-order aggregate folds them into the best path.

Documents lie in compressed block files in the shared folder; no text is shuffled. A block sends its distinct
words, joined to one string for each bucket of words, and gets back numbers and ids. The files are final once
their list is written, so lost tasks read the same blocks again.

For a unigram vocabulary the fold is Viterbi's: the path with the largest sum of scores. The public vocabulary is a BPE
one, for which that sum gives other pieces than its library. There the fold takes the edges in
order of score and joins two neighbours where an edge covers exactly these two, which is the path the library
takes. Its state is one number with a bit for each border. Words too long for that number, words with
several space marks (whose pieces all have one score) and the line break are encoded by the library.

Characters without a piece become byte pieces. Null and empty texts have no ids. Equal rows are
encoded each for itself. An empty table gives no rows. Other columns are neither read nor kept. A space mark that
stands in a text itself can't be told from a space and decodes to one.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redtide.llm.shared import open_for_read, open_for_write, partitions_for
from redtide.session import fresh_path, written

MARK = "▁"
LONGEST_WORD = 60
BLOCK_BYTES = 1 << 22
LINE = "\n"  # stands in no longer piece (checked), so it is a word of its own and may lie between others
BUCKET_BYTES = 1 << 19  # of text for each bucket of words
BUCKETS_A_TASK = 4
PAIR_CELLS = 1 << 24
MOST_TASKS = 20_000  # beyond it tasks take more and sort on disk
BLOCKS_A_TASK = 8
DECODED_TOGETHER = 256
REGION_BLOCKS = 4096  # a word's list of blocks stays in a region of about so many
SENT_TOGETHER = 1 << 18
NORMAL, BYTE = 1, 6


@dataclass(frozen=True)
class Vocabulary:
    """The pieces of a model that are text."""

    pieces: tuple[tuple[str, int, float], ...]  # text, id, score
    first_byte: int
    unigram: bool

    def reach(self, spark: SparkSession) -> DataFrame:
        """(prefix, reach): the length of the longest piece for each beginning of three characters; bounded by the vocabulary."""
        reach = {}
        for p, _, _ in self.pieces:
            if len(p) > 2:
                reach[p[:3]] = max(len(p), reach.get(p[:3], 0))
        return spark.createDataFrame(pd.DataFrame(list(reach.items()), columns=["prefix", "reach"]), "prefix string, reach int")

    def table(self, spark: SparkSession) -> DataFrame:
        """One row for each piece; bounded by the vocabulary."""
        return spark.createDataFrame(pd.DataFrame(self.pieces, columns=["piece", "id", "score"]), "piece string, id int, score double")


@lru_cache(maxsize=4)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    pieces = tuple((p.piece, k, p.score) for k, p in enumerate(model.pieces) if p.type == NORMAL)
    if model.normalizer_spec.name != "identity" or any(MARK in p.lstrip(MARK) or (LINE in p and p != LINE) for p, _, _ in pieces):
        raise ValueError("a vocabulary without normalisation and with pieces inside words is needed")
    return Vocabulary(pieces, next(k for k, p in enumerate(model.pieces) if p.type == BYTE), model.trainer_spec.model_type == 1)


class Borders:
    """Cuts a text into words. Pairs of neighbours are looked up by a cell they may share with others; then a
    border isn't cut, which changes no ids. Beside a line break and before a mark that follows no mark, which no piece
    spans, it is always cut."""

    def __init__(self, pieces):
        self.may_join = np.zeros(PAIR_CELLS, bool)
        for p, _, _ in pieces:
            self.may_join[self._cells(self._codes(p))] = True

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le"), "<u4")

    @staticmethod
    def _cells(code: np.ndarray) -> np.ndarray:
        return (code[:-1] * np.uint32(4099) + code[1:]) & np.uint32(PAIR_CELLS - 1)

    def cuts(self, code: np.ndarray) -> np.ndarray:
        """Where the words of a marked text of these code points start and end."""
        mark, line = code == ord(MARK), code == ord(LINE)
        joined = self.may_join[self._cells(code)] & ~(mark[1:] & ~mark[:-1]) & ~(line[1:] | line[:-1])
        return np.concatenate([[0], np.flatnonzero(~joined) + 1, [len(code)]])

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        cuts = self.cuts(self._codes(marked)).tolist()
        return [marked[a:b] for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=4)
def borders(path: str) -> Borders:
    return Borders(vocabulary(path).pieces)


def edges(distinct_words: DataFrame, vocab: Vocabulary, keys: tuple[str, ...] = (), carried: str | None = None) -> DataFrame:
    """(keys, word, edges, carried): the pieces in each word as structs (rank, first, end, id, unknown), in no order.
    A character without a piece has an edge with its text in `unknown`. Words are distinct within `keys`; the
    column `carried` goes along on the edge that every word has."""
    named = [*keys, "word"]
    kept = [carried] if carried else []
    at = distinct_words.select(*named, *kept, F.explode(F.sequence(F.lit(0), F.char_length("word") - 1)).alias("first"))
    at = at.select(*named, "first", *[F.when(F.col("first") == 0, F.col(c)).alias(c) for c in kept])
    at = at.join(F.broadcast(vocab.reach(distinct_words.sparkSession)), F.substring("word", F.col("first") + 1, F.lit(3)) == F.col("prefix"), "left")
    lengths = F.sequence(F.lit(1), F.least(F.coalesce("reach", F.lit(2)), F.char_length("word") - F.col("first")))
    parts = at.select(*named, "first", *kept, F.explode(lengths).alias("n")).withColumn("part", F.substring("word", F.col("first") + 1, F.col("n")))
    found = parts.join(F.broadcast(vocab.table(distinct_words.sparkSession)), F.col("part") == F.col("piece"), "left")
    found = found.where(F.col("id").isNotNull() | (F.col("n") == 1))
    edge = F.struct(
        (-F.col("score")).alias("rank"), "first", (F.col("first") + F.col("n")).alias("end"), "id", F.when(F.col("id").isNull(), F.col("part")).alias("unknown")
    )
    rest = [F.max(F.when(F.col("n") == 1, F.col(c))).alias(c) for c in kept]
    return found.groupBy(*named).agg(F.collect_list(edge).alias("edges"), *rest)


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), k)


def _bounds(e: Column) -> tuple[Column, Column]:
    """Bits of both ends of an edge, and of the borders inside it."""
    first, end = _bit(e["first"]), _bit(e["end"])
    return first.bitwiseOR(end), end - first * 2


def merge_path(found: DataFrame) -> DataFrame:
    """The columns of `found` and `path`: join neighbours in order of score; the state has a bit for each border left."""

    def step(borders: Column, e: Column) -> Column:
        ends, inner = _bounds(e)
        joins = (borders.bitwiseAND(ends) == ends) & (F.bit_count(borders.bitwiseAND(inner)) == 1)
        return F.when(joins, borders.bitwiseAND(F.bitwise_not(inner))).otherwise(borders)

    longer = F.sort_array(F.filter("edges", lambda e: e["end"] - e["first"] > 1))
    start = _bit(F.char_length("word") + 1) - 1
    folded = found.withColumn("borders", F.aggregate(longer, start, step))

    def stays(e: Column) -> Column:
        ends, inner = _bounds(e)
        return (F.col("borders").bitwiseAND(ends) == ends) & (F.col("borders").bitwiseAND(inner) == 0)

    ordered = F.sort_array(F.transform(F.filter("edges", stays), lambda e: F.struct(e["first"], e["id"], e["unknown"])))
    return folded.withColumn("path", ordered).drop("borders", "edges")


def viterbi_path(found: DataFrame, unknown_score: float = -1e6) -> DataFrame:
    """The columns of `found` and `path`, the path with the largest sum of scores. The state has, for each border, the best sum up to it
    and the edges on that way; on a tie the edge that comes first (the one with the better score) stays."""
    by_end = F.sort_array(F.transform("edges", lambda e: F.struct(e["end"], e["rank"], e["first"], e["id"], e["unknown"])))
    piece = "struct<first:int,id:int,unknown:string>"
    empty = F.struct(F.lit(0.0).alias("sum"), F.array().cast(f"array<{piece}>").alias("way"))
    nothing = F.lit(None).cast(f"struct<sum:double,way:array<{piece}>>")
    start = F.transform(F.sequence(F.lit(0), F.char_length("word")), lambda k: F.when(k == 0, empty).otherwise(nothing))

    def step(best: Column, e: Column) -> Column:
        source = F.get(best, e["first"])
        total = source["sum"] - F.coalesce(e["rank"], F.lit(-unknown_score))
        way = F.concat(source["way"], F.array(F.struct(e["first"].alias("first"), e["id"].alias("id"), e["unknown"].alias("unknown"))))
        better = source.isNotNull() & (F.get(best, e["end"]).isNull() | (total > F.get(best, e["end"])["sum"]))
        return F.transform(best, lambda old, k: F.when((k == e["end"]) & better, F.struct(total.alias("sum"), way.alias("way"))).otherwise(old))

    folded = F.aggregate(by_end, start, step)
    return found.withColumn("path", F.element_at(folded, -1)["way"]).drop("edges")


def path_ids(path: Column, first_byte: int) -> Column:
    """Ids along a path; an unknown character gives the pieces of its bytes."""

    def ids(e: Column) -> Column:
        text = F.hex(F.encode(e["unknown"], "UTF-8"))
        byte = lambda k: (F.conv(F.substring(text, 2 * k + 1, F.lit(2)), 16, 10).cast("int") + first_byte)
        raw = F.transform(F.sequence(F.lit(0), (F.length(text) / 2 - 1).cast("int")), byte)
        return F.when(e["id"].isNull(), raw).otherwise(F.array(e["id"]))

    return F.flatten(F.transform(path, ids))


def encode_words(distinct_words: DataFrame, model: str, keys: tuple[str, ...] = (), carried: str | None = None) -> DataFrame:
    """(keys, word, carried, ids) of words that are distinct within `keys`, by the lattice. Words have at most
    LONGEST_WORD characters and one space mark."""
    vocab = vocabulary(model)
    found = edges(distinct_words, vocab, keys, carried)
    path = viterbi_path(found) if vocab.unigram else merge_path(found)
    return path.withColumn("ids", path_ids(F.col("path"), vocab.first_byte)).drop("path")


def _usual(word: str) -> bool:
    return len(word) <= LONGEST_WORD and not word.startswith(MARK * 2) and word != LINE


@dataclass(frozen=True)
class BlockWords:
    """The texts of a block as numbers. Texts are split at spaces into parts, equal ones once, and parts into words."""

    places: np.ndarray  # of the parts of all texts, one after the other
    n_parts: np.ndarray  # of each text
    at: np.ndarray  # of the words of all parts, one after the other, among the distinct ones
    n_words: np.ndarray  # of each part; an empty one has none
    distinct: pa.StringArray  # the single mark is the first
    order: np.ndarray  # places of the usual words among the distinct ones, by bucket; a word's number is its place here
    buckets: np.ndarray  # in that order


def _buckets_of(words: pa.StringArray, buckets: int) -> np.ndarray:
    """A bucket for each word, from a sum over its bytes that depends on their places."""
    ends = np.frombuffer(words.buffers()[1], "<i4")[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], "u1")[ends[0] : ends[-1]].astype("<u8")
    ends = ends - ends[0]
    place = np.arange(len(data), dtype="<u8") - np.repeat(ends[:-1], np.diff(ends)).astype("<u8")
    factor = (place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = np.add.reduceat((data + np.uint64(1)) * (factor ^ (factor >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), ends[:-1])
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return ((mixed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _block_words(texts: pa.Array, model: str, buckets: int) -> BlockWords:
    """All distinct parts are cut as one text; a part's first word has the mark."""
    split = pc.split_pattern(pc.replace_substring(texts, MARK, " "), " ")
    coded = split.flatten().dictionary_encode()
    parts = coded.dictionary
    filled = pc.not_equal(parts, "")
    own = parts.filter(filled)
    marked = MARK + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), MARK)[0].as_py() if len(own) else ""
    code = Borders._codes(marked)
    cuts = borders(model).cuts(code) if marked else np.zeros(1, np.int64)
    width = 1 + (code > 0x7F) + (code > 0x7FF).astype(np.int32) + (code > 0xFFFF)
    bytes_to = np.concatenate([[0], np.cumsum(width)]).astype("<i4")
    words = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(bytes_to[cuts].tobytes()), pa.py_buffer(marked.encode()))
    known = pa.concat_arrays([pa.array([MARK]), words]).dictionary_encode()
    n_words = np.zeros(len(parts), np.int64)
    firsts = np.flatnonzero(code[cuts[:-1]] == ord(MARK))
    n_words[filled.to_numpy(zero_copy_only=False)] = np.diff(firsts, append=len(words))
    long = pc.greater(pc.utf8_length(known.dictionary), LONGEST_WORD)
    usual = np.flatnonzero(~pc.or_(long, pc.equal(known.dictionary, LINE)).to_numpy(zero_copy_only=False))
    own = _buckets_of(known.dictionary.take(pa.array(usual)), buckets)
    order = np.argsort(own, kind="stable")
    return BlockWords(coded.indices.to_numpy(), np.diff(split.offsets.to_numpy()), known.indices.to_numpy()[1:], n_words, known.dictionary, usual[order], own[order])


def _read_block(path: str) -> pa.Table:
    with open_for_read(path) as f, pa.ipc.open_stream(f) as stream:
        return stream.read_all()


def write_blocks(rows: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, path, size) of block files with the columns (id, text) of `rows`, a file for about `block_bytes` of text."""

    def save(parts: list[pa.RecordBatch], size: int):
        name = uuid.uuid4()
        path = f"{folder}/{name.hex}.arrow"
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        with open_for_write(path) as f, pa.ipc.new_stream(f, parts[0].schema, options=options) as out:
            for p in parts:
                out.write_batch(p)
        return pa.RecordBatch.from_pydict({"block": [name.hex], "path": [path], "size": pa.array([size], pa.int64())})

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                upto = min(batch.num_rows, int(np.searchsorted(ends, before + block_bytes - size)) + 1)
                parts.append(batch.slice(at, upto - at))
                size, at = size + int(ends[upto - 1]) - before, upto
                if size >= block_bytes:
                    yield save(parts, size)
                    parts, size = [], 0
        if parts:
            yield save(parts, size)

    return written(rows.mapInArrow(run, "block string, path string, size bigint"))


def block_words(blocks: DataFrame, model: str, buckets: int, regions: int) -> DataFrame:
    """(bucket, block, first, words): a block's distinct words of one bucket, with line breaks between them; `first` is
    the number of the first one. Each region of blocks has buckets of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = _block_words(_read_block(path)["text"].combine_chunks(), model, buckets)
                own = found.buckets
                cuts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]])
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), found.distinct.take(pa.array(found.order)))
                region = xxhash.xxh3_64_intdigest(name) % regions
                columns = [own[cuts[:-1]] + region * buckets, [name] * len(lists), cuts[:-1].astype("<i4"), pc.binary_join(lists, LINE)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "block", "first", "words"])

    return blocks.select("block", "path").mapInArrow(run, "bucket bigint, block string, first int, words string")


def _packed(answers: DataFrame) -> DataFrame:
    """(block, data) from (block, k, ids): numbers, lengths and byte planes of ids, compressed, for as many answers as fit in memory."""

    def send(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held).sort_by([("block", "ascending"), ("k", "ascending")]).combine_chunks()
        names = table["block"].chunk(0).dictionary_encode()
        of, k = names.indices.to_numpy(), table["k"].chunk(0).to_numpy()
        lists = table["ids"].chunk(0)
        ends = lists.offsets.to_numpy()
        ids = lists.values.to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]]).tolist()
        pack, data = zstandard.ZstdCompressor(level=3), []
        for a, b in zip(cuts, cuts[1:]):
            own = ids[ends[a] : ends[b]].astype("<u4")
            head = np.array([b - a, len(own)], "<u4").tobytes()
            numbers = np.diff(k[a:b], prepend=0).astype("<u4")
            data.append(pack.compress(head + numbers.tobytes() + np.diff(ends[a : b + 1]).astype("u1").tobytes() + own.view("u1").reshape(-1, 4).T.tobytes()))
        return pa.RecordBatch.from_pydict({"block": [names.dictionary[of[a]].as_py() for a in cuts[:-1]], "data": data})

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= SENT_TOGETHER:
                yield send(held)
                held, n = [], 0
        if n:
            yield send(held)

    return answers.select("block", "k", "ids").mapInArrow(run, "block string, data binary")


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of words, how many ids each has, and the ids."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, m = np.frombuffer(raw, "<u4", 2).tolist()
    numbers = np.cumsum(np.frombuffer(raw, "<u4", n, 8), dtype=np.int64)
    lengths = np.frombuffer(raw, "u1", n, 8 + 4 * n)
    return numbers, lengths, np.frombuffer(raw, "u1", 4 * m, 8 + 5 * n).reshape(4, -1).T.copy().view("<u4").ravel()


class Lists:
    """Lists of numbers by place: `lengths` of them, one after the other in `flat`."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat, lengths
        self.starts = np.cumsum(lengths) - lengths

    def joined(self, at: np.ndarray) -> np.ndarray:
        n = self.lengths[at]
        return self.flat[np.repeat(self.starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def merged(self, of: Lists) -> Lists:
        """A list for each of `of`, whose numbers are places here: their lists one after the other."""
        ends = np.concatenate([[0], np.cumsum(self.lengths[of.flat])])
        return Lists(self.joined(of.flat), ends[of.starts + of.lengths] - ends[of.starts])


def _by_number(found: list[bytes], odd: list[list[int]], usual: int) -> Lists:
    """Ids of each word of a block: the answers for the usual ones, then those of the others."""
    numbers, lengths, ids = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*map(_unpacked, found))) or [[], [], []]))
    numbers = np.concatenate([numbers, usual + np.arange(len(odd))]).astype(np.int64)
    if len(numbers) != usual + len(odd):
        raise ValueError(f"{usual + len(odd) - len(numbers)} words of a block have no ids")
    lengths = np.concatenate([lengths, [len(x) for x in odd]]).astype(np.int64)
    ids = np.concatenate([ids, *odd]).astype("<u4")
    order = np.empty(len(numbers), np.int64)
    order[numbers] = np.arange(len(numbers))
    return Lists(Lists(ids, lengths).joined(order), lengths[order])


def library_ids(word: str, model: str) -> list[int]:
    encode = processor(model).encode
    return encode(word[1:]) if word.startswith(MARK) else encode(LINE + word)[len(encode(LINE)) :]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, ids binary): little-endian unsigned 32-bit ids of every row.

    Documents are put in block files once. The distinct words of all blocks meet in buckets, go through the lattice
    once in each region of blocks, and only their numbers and ids come back to the blocks.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    blocks = write_blocks(rows, fresh_path(spark, "blocks"), block_bytes)
    count, size = blocks.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = min(MOST_TASKS, partitions_for(size, BUCKETS_A_TASK * BUCKET_BYTES))
    buckets = tasks * BUCKETS_A_TASK
    block_tasks = min(MOST_TASKS, partitions_for(count, BLOCKS_A_TASK))
    listed = blocks.select("block", "path").repartition(block_tasks, "block")
    sent = block_words(listed, model, buckets, partitions_for(count, REGION_BLOCKS)).repartition(tasks, "bucket")
    pairs = sent.select("bucket", "block", "first", F.posexplode(F.split("words", LINE)).alias("at", "word"))
    place = F.struct("block", (F.col("first") + F.col("at")).alias("k"))
    grouped = pairs.groupBy("bucket", "word").agg(F.collect_list(place).alias("places"))
    known = encode_words(grouped, model, ("bucket",), "places")
    answers = _packed(known.select(F.inline("places"), "ids"))
    nothing = F.lit(None)
    parts = answers.withColumn("path", nothing.cast("string")).unionByName(blocks.select("block", nothing.cast("binary").alias("data"), "path"))
    kind = docs.schema[id_col].dataType.simpleString()

    def put_together(found: pa.Table) -> pa.Table:
        block = _read_block(found["path"].drop_null()[0].as_py())
        texts = block["text"].combine_chunks()
        words = _block_words(texts, model, buckets)
        # texts in which marks follow one another or stand last: runs of marks stay together
        runs = pc.or_(pc.match_substring_regex(texts, f"^[ {MARK}]|[ {MARK}][ {MARK}]"), pc.match_substring_regex(texts, f"[ {MARK}]\\z"))
        cut = {k: borders(model).words(texts[k].as_py()) for k in np.flatnonzero(runs.to_numpy(zero_copy_only=False)).tolist()}
        usual = len(words.order)
        number = np.full(len(words.distinct), -1, np.int64)
        number[words.order] = np.arange(usual)
        rest = np.flatnonzero(number < 0)
        number[rest] = usual + np.arange(len(rest))
        odd = words.distinct.take(pa.array(rest)).to_pylist()
        if cut:
            odd = list(dict.fromkeys([*odd, *(w for own in cut.values() for w in own if not _usual(w))]))
            number_of = dict(zip(words.distinct.to_pylist(), number.tolist())) | {w: usual + k for k, w in enumerate(odd)}
        of_words = _by_number([d.as_py() for d in found["data"].drop_null()], [library_ids(w, model) for w in odd], usual)
        ids_of = of_words.merged(Lists(number[words.at], words.n_words)).merged(Lists(words.places, words.n_parts))

        def joined(k: int) -> bytes:
            if k not in cut:
                return ids_of.joined(np.array([k])).tobytes()
            return of_words.joined(np.fromiter(map(number_of.__getitem__, cut[k]), np.int64)).tobytes()

        if cut:
            ids = pa.array([joined(k) for k in range(len(texts))], pa.binary())
        else:
            ends = np.concatenate([[0], np.cumsum(4 * ids_of.lengths)]).astype("<i4")
            ids = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(ids_of.flat)])
        out = pa.table({"id": block["id"], "ids": ids})
        del block, texts, words, cut, number, of_words, ids_of, ids
        pa.default_memory_pool().release_unused()  # workers live on; a block's memory shouldn't
        return out

    out = parts.repartition(block_tasks, "block").groupBy("block").applyInArrow(put_together, f"id {kind}, ids binary")
    return out.withColumnRenamed("id", id_col)


def decode_ids(data: list[bytes], pieces: pa.Array) -> list[str]:
    """The texts of ids: byte pieces are put together to characters, marks become spaces, the first one goes."""
    found = pieces.take(pa.array(np.frombuffer(b"".join(data), "<u4")))
    to = np.frombuffer(found.buffers()[1], "<i4")[: len(found) + 1] if len(found) else np.zeros(1, "<i4")
    ends = to[np.concatenate([[0], np.cumsum([len(d) // 4 for d in data])])].tolist()
    raw = found.buffers()[2].to_pybytes() if len(found) else b""
    return [raw[a:b].decode("utf-8", "replace").replace(MARK, " ")[1:] for a, b in zip(ends, ends[1:])]


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_crc32, text) of the rows of `encode`."""

    names = [id_col, "n_tokens", "ids_crc32", "text"]

    def run(batches):
        vocab = vocabulary(model)
        pieces = [b""] * (max(max(k for _, k, _ in vocab.pieces), vocab.first_byte + 255) + 1)
        for p, k, _ in vocab.pieces:
            pieces[k] = p.encode()
        for k in range(256):
            pieces[vocab.first_byte + k] = bytes([k])
        pieces = pa.array(pieces, pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, DECODED_TOGETHER):
                keys, some = batch.slice(at, DECODED_TOGETHER).columns
                data = some.to_pylist()
                sizes, sums = pa.array([len(d) // 4 for d in data], pa.int64()), pa.array([zlib.crc32(d) for d in data], pa.int64())
                texts = pa.array(decode_ids(data, pieces), pa.string())
                yield pa.RecordBatch.from_arrays([keys, sizes, sums, texts], names)
            pa.default_memory_pool().release_unused()

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_crc32 bigint, text string")
