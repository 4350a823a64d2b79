"""When a task of the pipeline's Python operators has ended, its worker holds little memory that it does not use."""

import random
import re
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from netloom.llm import library_tokens, ngram_join, packing, quality


class Frame:
    """Stands for a DataFrame and gives the function of batches that the operator hands to Spark."""

    columns, schema = ["doc_id", "text", "queue"], None

    def select(self, *_) -> "Frame":
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def held() -> float:
    """MB of this process, without mapped files."""
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def released() -> None:
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def batches():
    drawn = random.Random(5)
    words = ["".join(drawn.choices("abcdefghijklmnopqrstuvwxyz", k=drawn.randint(2, 9))) for _ in range(20_000)]
    for at in range(0, 6_000, 2_000):
        texts = [" ".join(drawn.choices(words, k=400)) for _ in range(2_000)]
        yield pa.RecordBatch.from_arrays([pa.array(range(at, at + 2_000), pa.int64()), pa.array(texts), pa.array(["="] * 2_000)], ["doc_id", "text", "queue"])


OPERATORS = {
    "sets": lambda: ngram_join.sets(Frame(), with_keys=True),
    "hash_sets": lambda: ngram_join.hash_sets(Frame()),
    "accepted": lambda: quality.accepted(Frame(), quality.train(np.zeros((0, len(quality.FEATURES))), np.zeros(0))),
    "tokenized": lambda: packing.tokenized(Frame(), packing.default_path(), 1),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_memory_is_given_back(name, monkeypatch, spark):
    monkeypatch.setattr(packing, "materialize", lambda run: run)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    run = OPERATORS[name]()
    released()
    for _ in run(batches()):
        pass
    del _
    after = held()
    released()
    assert after - held() < 8


def test_pipeline_packs_with_fewer_words(monkeypatch):
    asked = {}
    monkeypatch.setattr(packing, "pack", lambda docs, **given: asked.update(given))
    corpus_pipeline.packed(None, None, "")
    tokens = library_tokens.loaded(packing.default_path(), asked["cached_words"])
    assert 2 * tokens.cache.most == 400_000
    assert asked["block_bytes"] <= 4 << 20
    assert 2 * library_tokens.loaded(packing.default_path()).cache.most == library_tokens.CACHED_WORDS
