"""Merge rounds against the library, and against merging one pair at a time for vocabularies of any order."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netloom.llm import piece_bpe

EDGES = [
    None, "", " ", "  a  b ", "Hello world", "a\nb\tc", "日本 é ́ x", "<s> </s> <unk>", "\x00a", "a▁b ▁", "ﬁ", "x" * 5000, " " * 3000, "▁" * 37 + "hello" + " " * 21, "thththththth " * 50, "퟿", "😀😀 é", "12345 678", "the " * 10, "<0x41>",
]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_path())


@pytest.fixture(scope="module")
def model():
    return piece_bpe.loaded(piece_bpe.default_path())


def texts(library):
    r = random.Random(3)
    pieces = [p for p in (library.id_to_piece(i) for i in range(3, library.get_piece_size())) if not p.startswith("<0x")]
    made = ["".join(r.choice(pieces).replace("▁", " ") for _ in range(r.randrange(20))) for _ in range(400)]
    made += ["".join(r.choice("abcdeinrst  ▁\n😀") for _ in range(r.randrange(60))) for _ in range(600)]
    return EDGES + made


def test_equals_library_both_ways(library, model):
    rows = texts(library)
    ids, at = model.encode(pa.array(rows, pa.string()))
    decoded, spelled = model.decode(ids, at), model.spelled(ids, at)
    for i, text in enumerate(rows):
        want = library.encode(text or "", add_eos=True)
        assert ids[at[i] : at[i + 1]].tolist() == want, text
        assert decoded[i].decode() == library.decode(want) and spelled[i].decode() == " ".join(map(str, want))


def test_any_ids_decode_as_the_library_does(library, model):
    r = random.Random(4)
    for _ in range(1500):
        ids = [r.choice([r.randrange(32000), r.randrange(260), 259, 28705, 2, 0]) for _ in range(r.randrange(12))]
        assert model.decode(np.array(ids, np.int64), np.array([0, len(ids)]))[0].decode() == library.decode(ids), ids


class Toy(piece_bpe.PieceBpe):
    """Pairs of a made-up vocabulary: the merged text has the rank that the order of pieces gives, ties included."""

    def __init__(self, pieces, ranks):
        names = ["a", "b", "c", *pieces]
        number, self.size = {p: i for i, p in enumerate(names)}, len(names)
        rank = dict(zip(pieces, ranks))
        self.pairs = {(number[p[:k]], number[p[k:]]): (rank[p], number[p]) for p in pieces for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        table = np.array([(a * self.size + b, r, i) for (a, b), (r, i) in self.pairs.items()], np.int64).reshape(-1, 3)
        self.keys, self.rank, self.merged = table.T
        self._hashed()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=2, max_size=5), unique=True, min_size=1, max_size=14), st.data())
def test_rounds_are_one_pair_at_a_time(pieces, data):
    toy = Toy(pieces, data.draw(st.lists(st.integers(0, 6), min_size=len(pieces), max_size=len(pieces))))
    words = data.draw(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=25), min_size=1, max_size=6))
    flat = np.array([s for w in words for s in w], np.int64)
    word = np.repeat(np.arange(len(words)), [len(w) for w in words])
    want = [toy.merge_long(list(w))[1] for w in words]
    got, of = toy.merge_rounds(flat, word)
    assert [got[of == i].tolist() for i in range(len(words))] == want


def test_long_words_go_to_the_heap(library, model, monkeypatch):
    monkeypatch.setattr(piece_bpe, "LONG", 8)
    monkeypatch.setattr(piece_bpe, "ROUNDS", 2)
    rows = ["internationalisation" * 40, " " * 200 + "abc" * 100, "short words beside"]
    for text, raw in zip(rows, model.encode_words(["▁" + t.replace(" ", "▁") for t in rows])):
        assert np.frombuffer(raw, model.dtype).tolist() == library.encode(text)


def test_frames(spark, library):
    schema = "doc_id long, text string, ids string, word string, _key long"
    rows = [(i if i != 4 else None, t, "x", "y", 1) for i, t in enumerate(EDGES)] + [(7, EDGES[7], "x", "y", 1)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    got = piece_bpe.round_trip_digests(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(EDGES[4 if r.doc_id is None else r.doc_id] or "", add_eos=True)
        hexed = [hashlib.sha256(t.encode()).hexdigest() for t in (" ".join(map(str, ids)), library.decode(ids))]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *hexed)
    encoded = piece_bpe.encode(docs)
    back = {r.doc_id: r.text for r in piece_bpe.decode(encoded).collect()}
    assert all(back[r.doc_id] == library.decode(list(r.ids)) for r in encoded.collect())
    nothing = spark.createDataFrame([], schema)
    assert piece_bpe.round_trip_digests(nothing).count() == piece_bpe.decode(piece_bpe.encode(nothing)).count() == 0
    assert [tuple(r) for r in piece_bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()] == [(1, "")]
