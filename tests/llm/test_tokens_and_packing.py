"""Chunked encoding, packing, id files and the SentencePiece lattice against their libraries."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tests.llm.conftest import AWKWARD

from redtide.llm import packing, sentencepieces, token_files
from redtide.llm.tokens import ChunkEncoder

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def library_ids(encoder, text):
    return np.asarray(encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("path,words", [(BYTES, False), (WORDS, True)])
def test_chunks_give_the_ids_of_the_whole_text(path, words):
    encoder, rng = ChunkEncoder(path, words), random.Random(1)
    parts = [" ", "\n", "a", "b1", "\t", "é", " ", "'s", "<|endoftext|>", "!", "Σ", "\x1f", "\x85", ", ", ".\n", "Foo", "ÄÖ", "İ", "#", " the"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    for text in [t for _, t in AWKWARD] + made:
        assert encoder.encode(text) == library_ids(encoder, text), repr(text)


def check_pieces(rows, texts, length):
    encoder, by_doc, by_sequence = ChunkEncoder(BYTES, False), {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) >= set(texts)
    for doc, text in texts.items():
        ids, at = library_ids(encoder, text) + b"\0\0\0\0", 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            part = ids[4 * r.start : 4 * (r.start + r.length)]
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids) // 4, zlib.crc32(part))
            at += r.length
        assert 4 * at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    return by_sequence


def test_packing_covers_every_id_once_with_little_padding(docs, texts):
    rows = packing.pack_documents(docs, BYTES, group=64).collect()
    sequences = check_pieces(rows, texts, 1024)
    assert sum(r.length for r in rows) >= 0.9 * 1024 * len(sequences)


def test_packing_of_awkward_rows(awkward, nothing):
    rows = packing.pack_documents(awkward, BYTES, length=64).collect()
    once = [(i, t) for i, t in AWKWARD if i != 8]
    check_pieces(rows, dict(once), 64)
    assert len([r for r in rows if r.doc_id == 8]) == 3
    assert packing.pack_documents(nothing, BYTES).count() == 0


def test_first_fit_decreasing_is_first_fit():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 300):
        sizes = np.sort(rng.integers(1, 101, n))[::-1]
        room, bins = [], []
        for s in sizes:
            k = next((k for k, r in enumerate(room) if r >= s), len(room))
            if k == len(room):
                room.append(100)
            room[k] -= s
            bins.append(k)
        assert packing.first_fit_decreasing(sizes, 100).tolist() == bins


def test_sequences_are_padded_except_at_a_power_of_two(docs):
    cut = packing.pieces(docs.where("doc_id < 20"), BYTES, length=100, with_ids=True)
    from redtide.session import written

    packed = packing.packed(written(cut), 100)
    for r in packing.sequences(packed, 100, pad_id=7).collect():
        n, ids = r.n_tokens, np.frombuffer(r.ids, "<u4")
        assert len(ids) == (n if n & (n - 1) == 0 else 100) and (ids[n:] == 7).all()


@pytest.mark.parametrize("bits", [False, True])
def test_file_round_trip_and_ranges(bits):
    class Kept(io.BytesIO):
        def close(self):
            pass

    out, rng = Kept(), np.random.default_rng(3)
    writer = token_files.Writer(out, bits, block=50)
    docs = [(k if k else None, rng.integers(0, 1 << 32, rng.integers(0, 170), dtype=np.uint32)) for k in range(20)]
    for key, ids in docs:
        writer.add(key, ids.astype("<u4").tobytes())
    writer.close()
    reader, everything = token_files.Reader(out), np.concatenate([i for _, i in docs])
    for (key, ids), (got_key, got) in zip(docs, reader.streams(), strict=True):
        assert key == got_key and (ids == got).all()
    for first, count in ((0, 0), (0, 10), (49, 2), (50, 50), (123, 400), (len(everything) - 1, 1), (0, len(everything))):
        assert (reader.range(first, count) == everything[first : first + count]).all()


def test_id_files_against_the_library(docs, texts, awkward, nothing):
    encoder, at = ChunkEncoder(WORDS, True), 0
    got = {r.doc_id: r for r in token_files.round_trip(docs, WORDS, 2).collect()}
    for doc in sorted(texts):
        ids = library_ids(encoder, texts[doc]) + np.asarray([2], "<u4").tobytes()
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    rows = sorted(token_files.round_trip(awkward, WORDS, 2).collect(), key=lambda r: r.start)
    order = [r.doc_id for r in rows]
    assert order == [None, *sorted(i for i, _ in AWKWARD if i is not None)]
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]
    assert token_files.round_trip(nothing, WORDS, 2).count() == 0


def test_lattice_gives_the_ids_of_the_library(spark, docs, texts, awkward, nothing):
    sp = sentencepieces.processor(PIECES)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in sentencepieces.encode(docs, PIECES).collect()}
    assert got == {d: sp.encode(t) for d, t in texts.items()}
    for r in sentencepieces.decode(sentencepieces.encode(docs, PIECES), PIECES).collect():
        assert r.text == texts[r.doc_id]
    rows = sentencepieces.encode(awkward, PIECES).collect()
    assert sorted((r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == sorted((i or 0, sp.encode(t or "")) for i, t in AWKWARD)
    assert sentencepieces.encode(nothing, PIECES).count() == 0


def test_many_blocks_and_regions_give_the_same_ids(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(sentencepieces, "REGION_BLOCKS", 2)
    sp = sentencepieces.processor(PIECES)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in sentencepieces.encode(docs, PIECES, block_bytes=20_000).collect()}
    assert got == {d: sp.encode(t) for d, t in texts.items()}


def test_words_that_the_library_encodes(spark):
    """Long words with and without a mark before them, runs of marks and line breaks."""
    long = "andheration" * 30
    some = [long, f"a\n{long}\n\n{long}  b", "\n", "   ", " \n  x\n", f"é\x00{long}", "▁▁a ▁", "\r\n\t\n", "日本語テキスト" * 40]
    sp = sentencepieces.processor(PIECES)
    rows = sentencepieces.encode(spark.createDataFrame(list(enumerate(some)), "doc_id int, text string"), PIECES).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == dict(enumerate(map(sp.encode, some)))


def test_unigram_vocabulary_on_a_whole_table(spark, docs, texts, tmp_path):
    """The public pieces read as a unigram vocabulary: the sum of scores of every document is the best one."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(PIECES, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    assert sentencepieces.vocabulary(path).unigram
    score = [p.score if p.type == 1 else 0.0 for p in model.pieces]
    known = {p.piece: p.score for p in model.pieces if p.type == 1}
    longest = max(map(len, known))

    def best(word):
        if not sentencepieces._usual(word):
            return sum(score[k] for k in sentencepieces.library_ids(word, path))
        sums = [(0, 0.0)]  # unknown characters, the fewer the better, and the sum of scores
        for end in range(1, len(word) + 1):
            ways = []
            for first in range(max(0, end - longest), end):
                n, total = sums[first]
                if word[first:end] in known:
                    ways.append((n, total + known[word[first:end]]))
                elif end - first == 1:
                    ways.append((n - 1, total))
            sums.append(max(ways))
        return sums[-1][1]

    encoded = sentencepieces.encode(docs, path)
    assert {r.doc_id: r.text for r in sentencepieces.decode(encoded, path).collect()} == texts
    for r in encoded.collect():
        ours = sum(score[k] for k in np.frombuffer(r.ids, "<u4").tolist())
        assert ours == pytest.approx(sum(map(best, sentencepieces.borders(path).words(texts[r.doc_id]))), rel=1e-12)


def test_viterbi_finds_the_best_sum(spark):
    vocab = sentencepieces.Vocabulary((("a", 1, -2.0), ("b", 2, -2.5), ("ab", 3, -3.0), ("abc", 4, -7.0), ("ba", 5, -2.2), ("c", 6, -1.0)), 100, True)
    scores = {p: (s, k) for p, k, s in vocab.pieces}

    def best(word):
        if not word:
            return 0.0, []
        ways = []
        for n in range(1, min(3, len(word)) + 1):
            score, k = scores.get(word[:n], (-1e6, word[:n]) if n == 1 else (None, None))
            if score is not None:
                total, way = best(word[n:])
                ways.append((score + total, [k, *way]))
        return max(ways, key=lambda w: w[0])

    some = ["a", "abab", "abc", "cabba", "bxab", "aabbaabbc"]
    path = sentencepieces.viterbi_path(sentencepieces.edges(spark.createDataFrame([(w,) for w in some], "word string"), vocab))
    for r in path.collect():
        assert [e.unknown if e.id is None else e.id for e in r.path] == best(r.word)[1]


def test_neighbours_that_share_a_cell_with_a_piece(spark):
    """A character before a mark or beside a line break, in a cell that two characters of a piece also fill."""
    may_join = sentencepieces.borders(PIECES).may_join
    chars = [chr(c) for c in [*range(0xA1, 0xD800), *range(0xE000, 0x110000)]]
    shares = lambda a, b: may_join[((ord(a) * 4099 + ord(b)) & 0xFFFFFFFF) % sentencepieces.PAIR_CELLS]
    before_mark = [c for c in chars if shares(c, sentencepieces.MARK)][:3]
    before_line, behind_line = [c for c in chars if shares(c, "\n")][:3], [c for c in chars if shares("\n", c)][:3]
    assert before_mark and before_line and behind_line
    some = [f"a{c} b {c} the{c}  x" for c in before_mark] + [f"a{c}\nb {c}\n" for c in before_line] + [f"a\n{c}b \n{c}" for c in behind_line]
    some.append(" ".join([f"a{c} b {c} the" for c in before_mark]))
    sp = sentencepieces.processor(PIECES)
    rows = sentencepieces.encode(spark.createDataFrame(list(enumerate(some)), "doc_id int, text string"), PIECES).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == dict(enumerate(map(sp.encode, some)))
