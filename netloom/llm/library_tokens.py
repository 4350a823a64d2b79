"""Ids as the tokenizers library gives them, with each distinct word encoded once per worker.

A text is cut before every space that stands before something else than white space, where the pre-tokenizers of
both supported kinds always split, so the ids of a text are those of its pieces. Arrow cuts a block of texts and
lists its distinct pieces; only these become Python objects, are taken apart into the pre-tokenizer's own words, and
are looked up or given to the library. The block's ids are gathered in numpy. Texts that hold a special token's
string go to the library whole.
"""

from __future__ import annotations

import codecs
import gc
import itertools
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from netloom.llm.bpe import ODD_SPACE, WHITE, byte_alphabet
from netloom.llm.common import TwoGenerations, freed

#: A run of these is a word of its own to either pre-tokenizer.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space in Arrow's regular expressions.
_WHITE = r"\s\x0b\x{85}\pZ"
#: Stands before a cut space where texts hold runs of white space.
_CUT = "\x00"
#: Texts are taken together up to so many bytes.
BLOCK_BYTES = 8 << 20
#: Words that a Python worker keeps, in two generations.
CACHED_WORDS = 1_200_000


def blocks(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of the text column, or of one longer text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes, dtype=np.int64) // most
        at = 0
        while at < len(block):
            to = max(at + 1, int(np.searchsorted(block, block[at], side="right")))
            yield batch.slice(at, to - at)
            at = to


def gathered(ids: np.ndarray, sizes: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids holds runs of these sizes; the runs numbered by code, one after the other, and where each begins, with the end."""
    starts, each = np.cumsum(sizes) - sizes, sizes[code]
    ends = np.concatenate([[0], np.cumsum(each)])
    small = np.int32 if max(int(ends[-1]), len(ids)) < 1 << 31 else np.int64
    place = np.repeat((starts[code] - ends[:-1]).astype(small), each)
    place += np.arange(len(place), dtype=small)
    return ids[place], ends


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class LibraryTokens:
    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        gc.set_threshold(1_000_000, 50, 50)  # the cache holds many small objects and no cycles
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size()
        self.width = 2 if self.size <= 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        self.special = [t["content"] for t in spec["added_tokens"]]
        # a pre-tokenizer that keeps white space puts one space before the word; the other kind drops white space
        self.keeps_space = (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel"
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        self.lowers = not self.keeps_space and [n["type"] for n in steps] == ["NFC", "Replace", "Lowercase"]
        white = rf"[{WHITE}]"
        self.kept = re.compile(rf" ?[^{WHITE}]+|{white}+(?![^{WHITE}])|{white}+")
        self.quick = re.compile(r" ?\S+|\s+(?!\S)|\s+")
        self.dropped = re.compile(rf"[^{WHITE}]+")
        self.cache = TwoGenerations(cached_words)
        # the model takes words spelled in the byte alphabet; only known kinds of files are spelled here
        self.direct = self.keeps_space or self.lowers
        self.letters = "".join("\n" if b == 10 else c for b, c in enumerate(byte_alphabet()))

    def chunks(self, text: str) -> list[str]:
        """The text cut at white space."""
        odd = ODD_SPACE.search(text)
        if self.keeps_space:
            return (self.kept if odd else self.quick).findall(text)
        return self.dropped.findall(text) if odd else text.split()

    def words(self, piece: str) -> list[str]:
        """Parts of a piece that the pre-tokenizer splits too; letters and the marks behind them are two words."""
        out = []
        for chunk in self.chunks(piece):
            word = chunk.rstrip(MARKS)
            if len(word) < len(chunk) and word.removeprefix(" ").isalpha() and "İ" not in word:
                out += (word, chunk[len(word) :])
            else:
                out.append(chunk)
        return out

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def plain(self, words: pa.Array) -> np.ndarray:
        """Which words are letters only, at most after a space, and normalised: one word to the pre-tokenizer, as it stands."""
        good = pc.match_substring_regex(words, r"^ ?\pL+$" if self.keeps_space else r"^\pL+$")
        if not self.keeps_space:
            same = pc.equal(pc.utf8_normalize(words, "NFC"), words)
            good = pc.and_(good, pc.and_(same, pc.equal(pc.utf8_lower(words), words)))
            good = pc.and_(good, pc.invert(pc.match_substring_regex(words, "[İΣς]")))
        return good.to_numpy(zero_copy_only=False)

    def learn(self, words: list[str]) -> None:
        """Puts the library's ids of new words into the cache; words of letters go to its model at once."""
        plain = self.plain(pa.array(words, pa.string())).tolist() if self.direct else [False] * len(words)
        letters = [w for w, p in zip(words, plain, strict=True) if p]
        spelled = codecs.charmap_decode("\n".join(letters).encode(), "strict", self.letters)[0].split("\n") if letters else []
        tokenize = self.tokenizer.model.tokenize
        found = [[t.id for t in tokenize(w)] for w in spelled]
        rest = [w for w, p in zip(words, plain, strict=True) if not p]
        for at in range(0, len(rest), 5000):
            found += [e.ids for e in self.tokenizer.encode_batch_fast(rest[at : at + 5000], add_special_tokens=False)]
        ends = list(itertools.accumulate((self.width * len(ids) for ids in found), initial=0))
        raw = np.fromiter(itertools.chain.from_iterable(found), self.dtype).tobytes()
        self.cache.update(zip(letters + rest, [raw[a:b] for a, b in itertools.pairwise(ends)], strict=True))

    def of_words(self, words: list[str]) -> list[bytes]:
        """Little-endian ids of distinct words, or of other pieces of text, which are taken apart."""
        cache = self.cache
        cache.turn()
        old = cache.old
        cache[""] = b""
        values = list(map(cache.get, words))
        fresh = [i for i, v in enumerate(values) if v is None]
        if old:
            for i in fresh:
                if (value := old.get(words[i])) is not None:
                    cache[words[i]] = values[i] = value
            fresh = [i for i in fresh if values[i] is None]
        if fresh:
            new = [words[i] for i in fresh]
            mixed = [(i, self.words(w)) for i, w, plain in zip(fresh, new, self.plain(pa.array(new, pa.string())).tolist(), strict=True) if not plain]
            apart = {i for i, row in mixed if len(row) > 1}
            parts = {w for i, row in mixed if i in apart for w in row if w not in cache}
            cache.update([(w, old[w]) for w in parts if w in old])
            self.learn(list(dict.fromkeys([w for i, w in zip(fresh, new, strict=True) if i not in apart] + [w for w in parts if w not in cache])))
            for i, w in zip(fresh, new, strict=True):
                if i not in apart:
                    values[i] = cache[w]
            for i, row in mixed:
                if i in apart:
                    values[i] = b"".join([cache[w] for w in row])
        return values

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin, with the end of the last."""
        texts = pc.fill_null(texts, "")
        special = np.zeros(len(texts), bool)
        for content in [*self.special, _CUT]:
            special |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        if special.any():
            # the others are encoded without them, then all are laid out in order
            rest, at = self._plain(texts.filter(pa.array(~special)))
            sizes, whole = np.diff(at), [self.whole(t) for t in texts.filter(pa.array(special)).to_pylist()]
            parts, own, other = [], iter(whole), iter(np.split(rest, at[1:-1]) if len(sizes) else [])
            parts = [next(own) if s else next(other) for s in special.tolist()]
            return np.concatenate(parts), np.cumsum([0, *map(len, parts)], dtype=np.int64)
        return self._plain(texts)

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        if self.lowers:  # as the normalizer does; fewer distinct words
            quick = [t if "Σ" in t or "İ" in t or not unicodedata.is_normalized("NFC", t) else t.lower() for t in strings(texts)]
            texts = pc.replace_substring(pa.array(quick, texts.type), "\n", " ")
        runs = self.keeps_space and pc.any(pc.match_substring_regex(texts, f"[{_WHITE}] ([{_WHITE}]|$)")).as_py()
        if runs:
            texts = pc.replace_substring_regex(texts, f"( [^{_WHITE}])", f"{_CUT}\\1")
        lists = pc.split_pattern(texts, _CUT if runs else " ")
        first = lists.offsets.to_numpy().astype(np.int64)
        first -= first[0]
        coded = lists.flatten().dictionary_encode()
        code, pieces = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        stems, tails = self.split_marks(pieces)
        lead = " " if self.keeps_space and not runs else ""
        words = [lead + w for w in strings(stems.dictionary)]
        pairs = np.stack([stems.indices.to_numpy(), tails.indices.to_numpy() + len(words)], axis=1)
        words += strings(tails.dictionary)
        if lead:  # all pieces but a text's first have a space before them
            begins = strings(pieces.take(pa.array(code[first[:-1]])))
            code[first[:-1]] = np.arange(len(pieces), len(pieces) + n)
            pairs = np.concatenate([pairs, np.stack([np.arange(len(words), len(words) + n), np.full(n, len(words) + n)], axis=1)])
            words += [*begins, ""]
        values = self.of_words(words)
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // self.width
        ids, ends = gathered(np.frombuffer(b"".join(values), self.dtype), sizes, pairs.ravel())
        ids, ends = gathered(ids, np.diff(ends[::2]), code)
        return ids, ends[first]

    def split_marks(self, pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Pieces as words of letters and the marks behind them, both dictionary encoded; other pieces stay whole."""
        stems = pc.utf8_rtrim(pieces, MARKS)
        stems = pc.if_else(pa.array(self.plain(stems)), stems, pieces)
        size, whole = (pc.binary_length(a).to_numpy().astype(np.int64) for a in (stems, pieces))
        left = whole - size
        at = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces)] + size
        ends = np.concatenate([[0], np.cumsum(left)])
        place = np.repeat(at - ends[:-1], left) + np.arange(ends[-1])
        text = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[place]
        tails = pa.StringArray.from_buffers(len(pieces), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(text.tobytes()))
        return stems.dictionary_encode(), tails.dictionary_encode()

    def encode_batch(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Little-endian ids of each text, `width` bytes each."""
        ids, at = self.encode(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        raw, at = ids.tobytes(), (at * self.width).tolist()
        return [raw[a:b] for a, b in itertools.pairwise(at)]


_LOADED: dict[str, LibraryTokens] = {}


def loaded(path: str, cached_words: int = CACHED_WORDS) -> LibraryTokens:
    """One for each file and Python worker, with as many words as were asked for last."""
    if path not in _LOADED:
        _LOADED[path] = LibraryTokens(path, cached_words)
    _LOADED[path].cache.most = cached_words // 2
    return _LOADED[path]


def dropped() -> None:
    """Frees the words that a Python worker keeps, at the beginning of a task of an operator that needs none of them."""
    if _LOADED:
        _LOADED.clear()
        gc.collect()
        freed()
