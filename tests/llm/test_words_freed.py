"""A Python worker keeps no words for tokenization once it turns to another stage."""

import pyarrow as pa

from netloom.llm import library_tokens, packing


def test_words_are_freed():
    path = packing.default_path()
    tokens = library_tokens.loaded(path)
    before = tokens.encode_batch(pa.array(["some words here"]))
    assert library_tokens._LOADED
    library_tokens.dropped()
    assert not library_tokens._LOADED
    assert library_tokens.loaded(path).encode_batch(pa.array(["some words here"])) == before
