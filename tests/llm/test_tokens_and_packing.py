import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelens.llm import idfiles, packing, tokens, unigram
from pagelens.llm.tokens import ChunkEncoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " \n", "Hello, World!  it's 42", "ÉCOLE naïve Straße", "x" * 9000, "a<|endoftext|>B <|ENDOFTEXT|>", "café H̱", "tab\x1cfile sep wide", "It's *** DON'T***'s", "the cat " * 3000, "the cat " * 3000]
SCHEMA = "doc_id long, text string, length string, _bucket int"


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(WORDS)
    return lambda t: made.encode(t or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def small_encoder():
    return ChunkEncoder(WORDS, cache_chunks=8)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abTHE'sre<|>endoftext .,!\t\n\x1c\x85 ̱́éÉß1½İ"), st.characters(codec="utf-8")), max_size=40), max_size=4))
def test_chunks_give_the_library_ids(library, small_encoder, texts):
    got = [x.tolist() for x in small_encoder.encode_batch([t.encode() for t in texts])]
    assert got == [library(t) for t in texts]


def test_a_table_that_forgets_gives_the_same_ids(library):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("alpha Beta gamma, delta* éa zürich 7 it's".split()) + str(rng.randrange(40)) for _ in range(60)) for _ in range(40)]
    made = ChunkEncoder(WORDS, cache_chunks=30)
    for t in texts:
        assert next(made.encode_batch([t.encode()])).tolist() == library(t)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_blocks_round_trip(values):
    import struct

    block = idfiles.encode_block(np.array(values, np.uint32))
    head = struct.calcsize("<IIq")
    n, control, data = struct.unpack("<IIq", block[:head])
    body = np.frombuffer(block[head:], np.uint8)
    assert n == len(values) and len(body) == control + data
    assert idfiles.decode_block(n, body[:control], body[control:]).tolist() == values


def test_id_files(spark, library):
    _, entries = idfiles.write_ids(docs(spark), WORDS, 1, shard_ids=3000)
    got = {r.doc_id: r for r in idfiles.read_ids(spark, entries, digest=True).collect()}
    start = 0
    for i, t in enumerate(TEXTS):
        ids = [*library(t), 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(entries) > 1 and sum(e["ids"] for e in entries) == start
    assert {r.doc_id: r.ids for r in idfiles.read_ids(spark, entries).collect()}[3] == [*library(TEXTS[3]), 1]


def test_id_files_of_odd_tables(spark):
    _, entries = idfiles.write_ids(docs(spark, []), WORDS, 1)
    assert idfiles.read_ids(spark, entries, digest=True).count() == 0
    twice = docs(spark, ["b", "a"]).selectExpr("7L AS doc_id", "text")
    _, entries = idfiles.write_ids(twice, WORDS, 1)
    assert sorted((r.doc_id, r.start) for r in idfiles.read_ids(spark, entries).collect()) == [(7, 0), (7, 2)]
    with pytest.raises(ValueError):
        idfiles.write_ids(twice.selectExpr("CAST(NULL AS long) AS doc_id", "text"), WORDS, 1)


def check_plan(counts, capacity, rows, sequences):
    fill, placed = np.zeros(sequences, np.int64), {}
    slots = []
    for length, rank, n, sequence, offset in rows.tolist():
        placed.setdefault(length, []).append((rank, n))
        slots += [(sequence + k, offset, length) for k in range(n)]
    for sequence, offset, length in sorted(slots):
        assert fill[sequence] == offset
        fill[sequence] += length
    assert fill.max(initial=0) <= capacity and (fill > 0).all()
    for length, runs in placed.items():
        ends = 0
        for rank, n in sorted(runs):
            assert rank == ends
            ends += n
        assert ends == counts[length]
    assert {k for k in placed} == set(np.flatnonzero(counts).tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 64), st.integers(1, 30)), max_size=20))
def test_plans_are_gapless_and_whole(pairs):
    counts = np.zeros(65, np.int64)
    for length, n in pairs:
        counts[length] += n
    for groups in (4, 0):
        rows, sequences = packing.make_plan(counts, 64, groups)
        check_plan(counts, 64, rows, sequences)
    total = int((counts * np.arange(65)).sum())
    _, best = packing.make_plan(counts, 64, 4)
    assert -(-total // 64) <= best <= int(counts.sum())


def test_configurations_beat_best_fit():
    # three sizes that only the right configurations fill: 1024 = 512 + 341 + 171
    counts = np.zeros(1025, np.int64)
    counts[512] = counts[341] = counts[171] = 60
    assert packing.make_plan(counts, 1024, share=1 / 6)[1] == 60


def test_grouped_plans_need_no_more_than_best_fit():
    import pyarrow.parquet as pq

    enc = tokens.encoder(WORDS)
    for sf, times in (("sf0.001", 1), ("sf0.01", 1), ("sf0.01", 10)):
        texts = tokens.arrow_texts(pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"]).column(0).combine_chunks())
        sizes = np.array([len(ids) + 1 for a, b in tokens.slices(texts) for ids in enc.encode_batch(texts[a:b])])
        counts = np.bincount((sizes - 1) % 2048 + 1, minlength=2049)
        counts[2048] += int(((sizes - 1) // 2048).sum())
        rows, sequences = packing.make_plan(counts * times, 2048)
        check_plan(counts * times, 2048, rows, sequences)
        assert sequences <= packing.make_plan(counts * times, 2048, 0)[1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(20, 100), st.integers(1, 40)), min_size=1, max_size=8, unique_by=lambda x: x[0]))
def test_configurations_hold_the_demand(pairs):
    sizes, demand = (np.array(x) for x in zip(*sorted(pairs), strict=True))
    found = packing.configurations(sizes, demand, 100)
    assert (sum(column * times for column, times in found) == demand).all() and all(column @ sizes <= 100 for column, _ in found)


def test_pack(spark, library):
    got = packing.pack(docs(spark), WORDS, 0, 64).collect()
    want = {}
    for i, t in enumerate(TEXTS):
        ids = np.array([*library(t), 0], "<u4")
        for k, s in enumerate(range(0, len(ids), 64)):
            want[i, k] = (s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 64 and len(fill) == -(-sum(fill.values()) // 64)


def test_pack_odd_tables(spark):
    assert packing.pack(docs(spark, []), WORDS).count() == 0
    same = docs(spark, ["a", "a", "a"]).selectExpr("CAST(NULL AS long) AS doc_id", "text")
    got = packing.pack(same, WORDS).collect()
    assert sorted(r.offset for r in got) == [0, 2, 4] and {r.doc_id for r in got} == {None}


@pytest.fixture(scope="module")
def pieces():
    return unigram.load_pieces(PIECES)


def forward(word, pieces):
    best = [(0.0, 0)] + [None] * len(word)
    unknown = min(pieces.values()) - 10
    for i in range(len(word)):
        for j in range(i + 1, len(word) + 1):
            s = pieces.get(word[i:j])
            if s is not None and (best[j] is None or best[i][0] + s > best[j][0]):
                best[j] = (best[i][0] + s, best[i][1] + 1)
        if word[i] not in pieces and (best[i + 1] is None or best[i][0] + unknown > best[i + 1][0]):
            best[i + 1] = (best[i][0] + unknown, best[i][1] + len(word[i].encode()))
    return best[-1][1]


def test_token_counts(spark, pieces):
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in unigram.token_counts(docs(spark, [*TEXTS[:5], *TEXTS[6:], "\U0001f600 ok"]), PIECES).collect()}
    for i, t in enumerate([*TEXTS[:5], *TEXTS[6:], "\U0001f600 ok"]):
        words = (t or "").encode().split()
        assert got[i] == (len(words), sum(forward(unigram.MARK + w.decode(), pieces) for w in words))
    assert unigram.token_counts(docs(spark, []), PIECES).count() == 0


def test_trie_agrees_with_the_public_model(pieces):
    from tokenizers import models

    model = models.Unigram([("<unk>", 0.0), *pieces.items()], 0, False)
    words = sorted({unigram.MARK + w for w in "then there these them theme internationally counter counted counting a".split()})
    assert unigram.TrieCounter(pieces).terminal_counts(words) == [len(model.tokenize(w)) for w in words]


def test_caches_are_bounded_by_bytes():
    enc = ChunkEncoder(WORDS, cache_bytes=3000)
    count = unigram.TrieCounter({"▁": -1.0, "a": -2.0, "aa": -2.5}, cache_bytes=3000)
    for k in range(30):
        text = bytes([97 + k % 26]) * 500 + b" a"
        ids = next(enc.encode_batch([text]))
        assert ids.tolist() == next(ChunkEncoder(WORDS).encode_batch([text])).tolist()
        assert count.count_batch([text]) == unigram.TrieCounter({"▁": -1.0, "a": -2.0, "aa": -2.5}).count_batch([text])
        assert enc._number.bytes <= 4000 and count._bytes <= 4000
