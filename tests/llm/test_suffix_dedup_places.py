"""Places of repeats in texts beyond the width of a key's place."""

import numpy as np
import pytest

from netloom.llm import suffix_dedup


def text_of(n, seed):
    return np.random.default_rng(seed).integers(97, 123, n, dtype=np.uint8).tobytes().decode()


def test_anchors_do_not_depend_on_the_place(monkeypatch):
    data = np.frombuffer(text_of(5000, 1).encode() + b"a" * 600 + text_of(300, 2).encode(), np.uint8)
    want = [v.tolist() for v in suffix_dedup.anchors(data, 200, 100)]
    monkeypatch.setattr(suffix_dedup, "_POSITION", 8)  # a line after every 156 windows
    hashes, at, first, last = suffix_dedup.anchors(data, 200, 100)
    windows = np.repeat(at - first, last - first + 1) + first.repeat(last - first + 1)
    places = suffix_dedup.Rolling(data).all(100)
    low = np.uint64(255)
    for w in range(len(data) - 199):
        part = places[w : w + 101] & ~low
        assert windows[w] == w + int(part.argmin())
    assert first[0] == 0 and last[-1] == len(data) - 200 and (first[1:] == last[:-1] + 1).all() and len(want) == 4


@pytest.mark.parametrize("before", [(1 << 24) - 50, (1 << 24) - 200, 5])
def test_a_repeat_across_the_line_goes(spark, before):
    run, letters = "q" * 200, text_of(1 << 24, 3)
    first = letters[:before] + run + "0" + letters[before : before + 5000]
    docs = spark.createDataFrame([(1, first), (2, "start" + run + "1" + text_of(500, 4))], "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.digests(docs).collect()}
    assert got[1] == (len(first), 200, 1) and got[2][1:] == (200, 1)
