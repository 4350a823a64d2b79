"""BPE encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of a word. A proposal is the BPE result if every token is the
encoding of its own text and every adjacent pair is compatible, i.e. no merge across the pair's boundary
would run before the merges on either side take their symbols away. Pairs are checked for all new words of
a batch at once in numpy; only the words with a failing pair are merged exactly.

Rows: a null text counts as empty; empty texts have no tokens. Repeated rows are encoded alike. Texts of any length are
encoded whole; an empty table gives no rows. Other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from netloom.llm.common import TwoGenerations, slices

#: White space as the tokenizer's patterns see it (Unicode White_Space).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ODD_SPACE = re.compile("[\x1c-\x1f]")
CHUNK = re.compile(f"[^{WHITE}]+")
NEVER = 1 << 40


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = itertools.count(256)
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A word-level BPE tokenizer (lower case, white space dropped, word-end marks) from its JSON file."""

    def __init__(self, path: str, cached_words: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.text = [""] * size
        for table in (self.vocab, self.special):
            for token, i in table.items():
                self.text[i] = token
        self.digits = [str(i) for i in range(size)]
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.words = regex.compile(splits[0].replace(r"\s", WHITE))
        self.alphabet = byte_alphabet()
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.size = size
        self._derive()
        self.cache, self.word_cache = TwoGenerations(cached_words), TwoGenerations(cached_words)

    def _derive(self) -> None:
        """Each token's own derivation (last merge), and which tokens encode themselves."""
        self.rank, self.left, self.right = (np.full(self.size, -1, np.int64) for _ in range(3))
        self.inner, self.final = {}, {}
        made = {}
        for (a, b), (rank, token) in self.ranks.items():
            made.setdefault(token, (rank, a, b))
        for token, i in self.vocab.items():
            last = bool(self.end) and token.endswith(self.end) and len(token) > len(self.end)
            body = token[: -len(self.end)] if last else token
            ids = self._symbols(body, last)
            if ids is None or len(ids) > 1 and self.merge(ids, stop_at=i) != [i]:
                continue
            if len(ids) > 1:
                rank, a, b = made[i]
                if self.last_merge != (a, b) or rank <= max(self.rank[a], self.rank[b]):
                    continue
                self.rank[i], self.left[i], self.right[i] = rank, a, b
            (self.final if last or not self.end else self.inner)[body] = i
            if not self.end:
                self.inner[body] = i
        self.longest = max(map(len, [*self.inner, *self.final]), default=1)
        self.reach: dict[str, int] = {}
        for body in self.inner:
            self.reach[body[:2]] = max(len(body), self.reach.get(body[:2], 1))
        self._fill_pair_table()

    def _fill_pair_table(self) -> None:
        """Open addressing over the merge pairs, probed a whole array at a time."""
        self.bits = max(8, (4 * len(self.ranks)).bit_length())
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, NEVER, np.int64)
        self.slot_token = np.full(1 << self.bits, -1, np.int64)
        keys = np.array([a * self.size + b for a, b in self.ranks], np.int64)
        self.probes = 1
        for key, at, (rank, token) in zip(keys.tolist(), self._slots(keys).tolist(), self.ranks.values(), strict=True):
            probe = 1
            while self.slot_key[at] >= 0:
                at, probe = (at + 1) & ((1 << self.bits) - 1), probe + 1
            self.slot_key[at], self.slot_rank[at], self.slot_token[at] = key, rank, token
            self.probes = max(self.probes, probe)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and token of each pair's merge; NEVER and -1 where there is none or a symbol is negative."""
        keys = a * self.size + b
        keys[(a < 0) | (b < 0)] = -2
        at = self._slots(keys)
        rank, token = np.full(len(keys), NEVER), np.full(len(keys), -1)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            slot = at[open_]
            there = self.slot_key[slot]
            hit = there == keys[open_]
            rank[open_[hit]], token[open_[hit]] = self.slot_rank[slot[hit]], self.slot_token[slot[hit]]
            open_ = open_[~hit & (there >= 0)]
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        return rank, token

    def _symbols(self, body: str, last: bool) -> list[int] | None:
        try:
            return [self.vocab[c] for c in body[:-1]] + [self.vocab[body[-1] + self.end * last]]
        except (KeyError, IndexError):
            return None

    def merge(self, ids: list[int], stop_at: int = -1) -> list[int]:
        """Exact merging: the adjacent pair of lowest rank first, the leftmost of equals."""
        ids, ranks = list(ids), self.ranks
        self.last_merge = None
        while len(ids) > 1:
            best, at, token = NEVER, -1, -1
            for i in range(len(ids) - 1):
                found = ranks.get((ids[i], ids[i + 1]))
                if found and found[0] < best:
                    best, at, token = found[0], i, found[1]
            if at < 0:
                break
            self.last_merge = (ids[at], ids[at + 1])
            ids[at : at + 2] = [token]
        return ids

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match over the word's byte characters."""
        out, i, n, inner, longest, reach = [], 0, len(word), self.inner, self.longest, self.reach
        while i < n:
            if n - i <= longest and (token := self.final.get(word[i:])) is not None:
                out.append(token)
                return out
            for j in range(min(n - (1 if self.end else 0), i + reach.get(word[i : i + 2], 1)), i, -1):
                if (token := inner.get(word[i:j])) is not None:
                    out.append(token)
                    i = j
                    break
            else:
                return None
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the tokens of each pair stay apart when their texts are encoded together.

        Walks down the right spine of a and the left spine of b from the latest merge to the earliest. Of equal
        ranks the left pair merges first.
        """
        x, y = a.copy(), b.copy()
        x_until, y_until = np.full(len(a), NEVER), np.full(len(a), NEVER)
        good, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            rank, _ = self.find(x[live], y[live])
            crossed = (rank < x_until[live]) & (rank <= y_until[live]) & (rank < NEVER)
            good[live[crossed]] = False
            live = live[~crossed]
            rx, ry = self.rank[x[live]], self.rank[y[live]]
            live, rx, ry = (v[(rx >= 0) | (ry >= 0)] for v in (live, rx, ry))
            down_x = rx > ry
            i, j = live[down_x], live[~down_x]
            x_until[i], x[i] = rx[down_x], self.right[x[i]]
            y_until[j], y[j] = ry[~down_x], self.left[y[j]]
        return good

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of words that are already lower case and in the byte alphabet."""
        proposed = [self.propose(w) for w in words]
        lengths = np.array([len(p) if p else 0 for p in proposed], np.int64)
        flat = np.fromiter(itertools.chain.from_iterable(p or () for p in proposed), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        fails = ~self.compatible(pairs // self.size, pairs % self.size)
        wrong = {*owner[inside[fails[which]]].tolist()} | {i for i, p in enumerate(proposed) if p is None}
        symbols = []
        for i in (again := sorted(wrong)):
            ids = self._symbols(words[i], True)
            symbols.append(ids if ids is not None else [self.vocab[c] for c in words[i] if c in self.vocab])
        for i, ids in zip(again, self.merge_all(symbols), strict=True):
            proposed[i] = ids
        return list(map(tuple, proposed))

    def merge_all(self, words: list[list[int]]) -> list[list[int]]:
        """merge() of many words, those of like length together as the rows of a matrix."""
        out: list[list[int]] = [[]] * len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        order = np.argsort(lengths, kind="stable")
        at = int(np.searchsorted(lengths[order], 1))
        while at < len(order):
            longest = int(lengths[order[at]]) * 5 // 4 + 2
            to = min(int(np.searchsorted(lengths[order], longest, side="right")), at + max(1, 2_000_000 // longest))
            part = order[at:to]
            width = int(lengths[part[-1]])
            if width > 2000:
                for i in part:
                    out[i] = self.merge_long(words[i])
            else:
                for i, ids in zip(part.tolist(), self._merge_rows([words[i] for i in part], width), strict=True):
                    out[i] = ids
            at = to
        return out

    def _merge_rows(self, words: list[list[int]], width: int) -> list[list[int]]:
        ids = np.full((len(words), width + 1), -1, np.int64)
        for row, word in enumerate(words):
            ids[row, : len(word)] = word
        done, rows = np.empty((len(words), width + 1), np.int64), np.arange(len(words))
        rank, token = (v.reshape(len(words), width) for v in self.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()))
        while True:
            best = rank.argmin(axis=1)
            line = np.arange(len(rows))
            go = rank[line, best] < NEVER
            if not go.all():
                stop = ~go
                done[rows[stop], : ids.shape[1]], done[rows[stop], ids.shape[1] :] = ids[stop], -1
                rows, ids, rank, token, best = rows[go], ids[go], rank[go], token[go], best[go]
                line = np.arange(len(rows))
            if not len(rows):
                break
            ids[line, best] = token[line, best]
            columns = np.arange(rank.shape[1])
            shift = columns[None, :] + (columns[None, :] > best[:, None])
            ids = np.take_along_axis(ids, shift, axis=1)
            ids_next = np.concatenate([ids, np.full((len(rows), 1), -1)], axis=1)
            shift = columns[None, :] + (columns[None, :] > best[:, None])
            shift = np.minimum(shift, rank.shape[1] - 1)
            rank, token = np.take_along_axis(rank, shift, axis=1), np.take_along_axis(token, shift, axis=1)
            rank[:, -1], token[:, -1] = NEVER, -1
            ids = ids_next
            for column in (np.maximum(best - 1, 0), best):
                rank[line, column], token[line, column] = self.find(ids[line, column], ids[line, column + 1])
        return [[x for x in row if x >= 0] for row in done.tolist()]

    def merge_long(self, ids: list[int]) -> list[int]:
        """merge() of a very long word: a heap over a linked list instead of a scan for each merge."""
        n = len(ids)
        ids, after, before = list(ids), [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(found[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (found := self.ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.ranks[a, b][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (found := self.ranks.get((ids[k], ids[after[k]]))):
                    heapq.heappush(heap, (found[0], k, ids[k], ids[after[k]]))
        return [x for x in ids if x >= 0]

    def byte_words(self, chunk: str) -> list[str]:
        """The words of a text without white space or special tokens, normalised, in the byte alphabet."""
        chunk = unicodedata.normalize("NFC", chunk)
        low = "".join(c.lower() for c in chunk) if "Σ" in chunk else chunk.lower()
        if low.isascii() and low.isprintable():
            return self.words.findall(low)
        letters = self.alphabet
        return ["".join([letters[b] for b in w.encode()]) for w in self.words.findall(low)]

    def learn(self, chunks: set[str]) -> None:
        """Encodes chunks into the cache."""
        parts: dict[str, list] = {}
        words: dict[str, tuple] = {}
        for chunk in chunks:
            row = []
            for piece in self.special_split.split(chunk) if "<" in chunk and self.special_split else (chunk,):
                if piece in self.special:
                    row.append(self.special[piece])
                elif piece:
                    row += self.byte_words(piece)
            parts[chunk] = row
            words.update(dict.fromkeys(w for w in row if isinstance(w, str)))
        known = self.word_cache
        known.turn()
        fresh = [w for w in words if w not in known and w not in known.old]
        known.update(zip(fresh, self.encode_words(fresh), strict=True))
        words = {w: known[w] for w in words}
        for chunk, row in parts.items():
            self.cache[chunk] = (
                words[row[0]]
                if len(row) == 1 and isinstance(row[0], str)
                else tuple(itertools.chain.from_iterable(words[w] if isinstance(w, str) else (w,) for w in row))
            )

    def encode_batch(self, texts: list[str | None]) -> Iterator[list[int]]:
        """Ids of each whole text."""
        chunked = [CHUNK.findall(t) if ODD_SPACE.search(t) else t.split() for t in (t or "" for t in texts)]
        cache = self.cache
        cache.turn()
        old = cache.old
        met = set()
        for row in chunked:
            met.update(row)
        self.learn({c for c in met if c not in cache and c not in old})
        for row in chunked:
            yield list(itertools.chain.from_iterable(map(cache.__getitem__, row)))

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings with a space between; the file names no decoder."""
        return " ".join(map(self.text.__getitem__, ids))

    def spell(self, ids: list[int]) -> str:
        return " ".join(map(self.digits.__getitem__, ids))


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """One tokenizer for each file and Python worker."""
    if path not in _LOADED:
        gc.set_threshold(1_000_000, 50, 50)  # the caches hold many small tuples and no cycles
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) of each whole text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(path)
        for batch in slices(batches):
            ids = list(tokenizer.encode_batch(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text decoded from ids."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(path)
        for batch in slices(batches):
            texts = [tokenizer.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes each whole text, decodes the ids, and returns digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = path or default_path()
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(path)
        for batch in slices(batches):
            n, ids_hex, text_hex = [], [], []
            for ids in tokenizer.encode_batch(batch.column(1).to_pylist()):
                n.append(len(ids))
                ids_hex.append(hexed(tokenizer.spell(ids)))
                text_hex.append(hexed(tokenizer.decode(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex), pa.array(text_hex)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
