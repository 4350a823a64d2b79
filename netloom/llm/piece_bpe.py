"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The new words of a block of texts become one flat numpy array of symbols. In each round every word finds the least
rank of its pairs (a segmented minimum) and merges the places that have it, from the left, in all words at once;
words without a pair that merges leave the arrays, until none is left. Several places of a word merge in one round
only up to the first whose new neighbours would have to merge before the places behind it, so that the result is
that of merging one pair at a time, best score first and leftmost first, for any vocabulary.

A word here is a stretch that no piece of the vocabulary crosses: texts are cut before white space marks (if no
piece has one behind another letter), and wherever no piece holds the two letters side by side.

Rows: a null text counts as empty; an empty text is the end id alone. Texts of any length are encoded whole. Repeated
rows are encoded alike, an empty table gives an empty result, and other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from netloom.llm.common import TwoGenerations
from netloom.llm.library_tokens import blocks, gathered, strings

SPACE = "▁"
NEVER = 1 << 30
#: Words with this many symbols left after so many rounds are merged with a heap, one pair at a time.
LONG, ROUNDS = 1024, 256
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceBpe:
    """A BPE model with byte fallback from its file; identity normalisation with a white space mark in front."""

    def __init__(self, path: str, cached_words: int = 600_000):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules, pieces = model.normalizer_spec, model.pieces
        plain = rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
        kinds = np.array([p.type for p in pieces])
        if not plain or model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or np.isin(kinds, (USER, UNUSED)).any():
            raise ValueError("only BPE models with byte fallback, identity normalisation and neither user-defined nor unused pieces are read")
        self.size, self.end = len(pieces), model.trainer_spec.eos_id
        self.kinds = kinds
        normal = {p.piece: i for i, p in enumerate(pieces) if p.type == NORMAL}
        self.letters = {p: i for p, i in normal.items() if len(p) == 1}
        self.bytes = np.zeros(256, np.int32)
        for i in np.flatnonzero(kinds == BYTE).tolist():
            self.bytes[int(pieces[i].piece[1:-1], 16)] = i
        # equal scores have equal ranks; the best score has the least
        ranks = np.unique([-pieces[i].score for i in normal.values()], return_inverse=True)[1]
        rank = dict(zip(normal.values(), ranks.tolist(), strict=True))
        pairs = [(normal[p[:k]] * self.size + normal[p[k:]], rank[i], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        self.keys, self.rank, self.merged = table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()
        self._hashed()
        self.pairs = {(k // self.size, k % self.size): (r, i) for k, r, i in pairs}
        beside = {(a, b) for p in normal for a, b in itertools.pairwise(p)}
        #: Whether a piece has a mark behind another letter: then a text is one word until its letters are looked at.
        self.crossed = any(b == SPACE and a != SPACE for a, b in beside)
        self.beside = np.unique(np.array([self.letters[a] * self.size + self.letters[b] for a, b in beside if a in self.letters and b in self.letters], np.int64))
        text = [b"" if k == CONTROL else model.trainer_spec.unk_surface.encode() if k == UNKNOWN else p.piece.replace(SPACE, " ").encode() for p, k in zip(pieces, kinds, strict=True)]
        for b, i in enumerate(self.bytes.tolist()):
            text[i] = bytes([b])
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.text_sizes = np.array([len(t) for t in text], np.int64)
        self.marked = np.array([k == NORMAL and p.piece.startswith(SPACE) for p, k in zip(pieces, kinds, strict=True)])
        digits = [str(i).encode() + b" " for i in range(self.size)]
        self.digits, self.digit_sizes = np.frombuffer(b"".join(digits), np.uint8), np.array([len(d) for d in digits], np.int64)
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.letter_table = np.full(0x110000, -1, np.int32)
        for c, i in self.letters.items():
            self.letter_table[ord(c)] = i
        self.cache = TwoGenerations(cached_words)

    def _hashed(self) -> None:
        """Lays the pairs out by a hash: a pair stands at its place or at one of the next few, up to a free one."""
        self.shift = 64 - max(8, int(4 * len(self.keys)).bit_length())
        places = 1 << (64 - self.shift)
        self.slots = np.full((places, 3), (-1, NEVER, -1), np.int64)
        left = np.arange(len(self.keys))
        at = self._slot(self.keys)
        while len(left):
            free = self.slots[at[left], 0] < 0
            takes, first = np.unique(at[left[free]], return_index=True)
            taken = left[free][first]
            self.slots[takes] = np.stack([self.keys[taken], self.rank[taken], self.merged[taken]], axis=1)
            left = np.setdiff1d(left, taken, assume_unique=True)
            at[left] = (at[left] + 1) % places

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of pairs of symbols; NEVER where no piece is their text."""
        key = np.where((left >= 0) & (right >= 0), left * self.size + right, -1)
        at = self._slot(key)
        held = self.slots[at, 0]
        look = np.flatnonzero((held != key) & (held >= 0) & (key >= 0))
        while len(look):
            at[look] = (at[look] + 1) % len(self.slots)
            held = self.slots[at[look], 0]
            look = look[(held != key[look]) & (held >= 0)]
        known = (self.slots[at, 0] == key) & (key >= 0)
        return np.where(known, self.slots[at, 1], NEVER), np.where(known, self.slots[at, 2], -1)

    def merge_rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their words (numbers that do not fall) after all merges, in the order given."""
        place = np.arange(len(symbols))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank, into = np.full(len(symbols), NEVER), np.full(len(symbols), -1)
        if len(symbols) > 1:
            rank[:-1], into[:-1] = self.find(symbols[:-1], symbols[1:])
            rank[:-1][word[1:] != word[:-1]] = NEVER
        for turn in itertools.count():
            if not len(symbols):
                break
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(starts, len(symbols)))
            best = np.minimum.reduceat(rank, starts)
            goes = best < NEVER
            if turn >= ROUNDS and (long := goes & (sizes > LONG)).any():
                for a, n in zip(starts[long].tolist(), sizes[long].tolist(), strict=True):
                    left, ids = self.merge_long(symbols[a : a + n].tolist())
                    done.append((place[a : a + n][left], np.array(ids, symbols.dtype), word[a : a + n][left]))
                goes &= ~long
                stays = np.repeat(goes | long, sizes)
            else:
                stays = np.repeat(goes, sizes)
            if not stays.all():
                done.append((place[~stays], symbols[~stays], word[~stays]))
            keep = np.repeat(goes, sizes)
            if not keep.all():
                place, symbols, word, rank, into = place[keep], symbols[keep], word[keep], rank[keep], into[keep]
                best, sizes = best[goes], sizes[goes]
                if not len(symbols):
                    break
            of = np.repeat(np.arange(len(best)), sizes)
            at = np.flatnonzero(rank == best[of])
            # places side by side share a symbol: every second one, from the left
            first = np.concatenate([[True], np.diff(at) != 1])
            run = np.flatnonzero(first)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            new, own = into[at], of[at]
            if len(at) > len(best):  # some word merges at several places
                before = np.where(at > 0, symbols[at - 1], -1)
                before[(at == 0) | (of[at - 1] != own)] = -1
                touching = np.flatnonzero(np.diff(at) == 2) + 1
                touching = touching[own[touching] == own[touching - 1]]
                before[touching] = new[touching - 1]
                behind = np.minimum(at + 2, len(symbols) - 1)
                after = np.where((at + 2 < len(symbols)) & (of[behind] == own), symbols[behind], -1)
                stop = (self.find(before, new)[0] <= best[own]) | (self.find(new, after)[0] <= best[own])
                if stop.any():
                    count = np.cumsum(stop) - stop
                    head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                    ok = count == np.repeat(count[head], np.diff(np.append(head, len(own))))
                    at, new, own = at[ok], new[ok], own[ok]
            symbols[at] = new
            left = np.ones(len(symbols), bool)
            left[at + 1] = False
            at = (np.cumsum(left) - 1)[at]
            place, symbols, word, rank, into, of = place[left], symbols[left], word[left], rank[left], into[left], of[left]
            touched = np.zeros(len(symbols), bool)
            touched[at] = touched[np.maximum(at - 1, 0)] = True
            changed = np.flatnonzero(touched)
            last = changed == len(symbols) - 1
            nxt = np.minimum(changed + 1, len(symbols) - 1)
            rank[changed], into[changed] = self.find(symbols[changed], symbols[nxt])
            rank[changed[last | (of[nxt] != of[changed])]] = NEVER
        place, symbols, word = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in range(3))
        order = np.argsort(place, kind="stable")
        return symbols[order], word[order]

    def merge_long(self, ids: list[int]) -> tuple[list[int], list[int]]:
        """One word, one pair at a time: which places are left, and their symbols."""
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(found[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (found := self.pairs.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.pairs[a, b][1], -2
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (found := self.pairs.get((ids[k], ids[after[k]]))):
                    heapq.heappush(heap, (found[0], k, ids[k], ids[after[k]]))
        left = [i for i, x in enumerate(ids) if x != -2]
        return left, [ids[i] for i in left]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Little-endian 16-bit or 32-bit ids of each word, as it stands (marks for spaces, no mark added)."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        symbols = self.letter_table[points].astype(np.int64)
        odd = np.flatnonzero(symbols < 0)
        symbols[odd] = -3 - odd  # letters without a piece merge with nothing; the number tells which letter it was
        pair = symbols[:-1] * self.size + symbols[1:]
        near = np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)
        joined = (self.beside[near] == pair) & (owner[1:] == owner[:-1]) & (symbols[:-1] >= 0) & (symbols[1:] >= 0) if len(pair) else np.zeros(0, bool)
        piece = np.concatenate([[0], np.cumsum(~joined)]) if len(symbols) else np.zeros(0, np.int64)
        first = np.flatnonzero(np.concatenate([[True], ~joined])) if len(symbols) else np.zeros(0, np.int64)
        ids, piece = self.merge_rounds(symbols, piece)
        owner = owner[first][piece]
        if len(odd):
            other = ids < 0
            spelled = [c.encode() for c in points[-3 - ids[other]].astype("<u4").tobytes().decode("utf-32-le")]
            many = np.ones(len(ids), np.int64)
            many[other] = [len(s) for s in spelled]
            flat = np.repeat(ids, many)
            flat[np.repeat(other, many)] = self.bytes[np.frombuffer(b"".join(spelled), np.uint8)]
            ids, owner = flat, np.repeat(owner, many)
        width = self.dtype.itemsize
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))]) * width
        raw = ids.astype(self.dtype).tobytes()
        return [raw[a:b] for a, b in itertools.pairwise(ends.tolist())]

    @property
    def dtype(self) -> np.dtype:
        return np.dtype("<u2" if self.size <= 1 << 16 else "<u4")

    def of_words(self, words: list[str]) -> list[bytes]:
        """encode_words for distinct words, each new one once while the cache holds it."""
        cache = self.cache
        cache.turn()
        old = cache.old
        values = list(map(cache.get, words))
        fresh = []
        for i, v in enumerate(values):
            if v is None:
                if (value := old.get(words[i])) is None:
                    fresh.append(i)
                else:
                    cache[words[i]] = values[i] = value
        if fresh:
            new = [words[i] for i in fresh]
            for i, word, value in zip(fresh, new, self.encode_words(new), strict=True):
                values[i] = cache[word] = value
        return values

    def _split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words of all texts, dictionary encoded, and where each text's begin, with the end of the last."""
        spaced = pc.match_substring(texts, "  ")
        for odd in (pc.match_substring(texts, SPACE), pc.starts_with(texts, " "), pc.ends_with(texts, " "), pc.equal(texts, "")):
            spaced = pc.or_(spaced, odd)
        if not self.crossed and not pc.any(spaced).as_py():
            lists = pc.split_pattern(texts, " ")
            at = lists.offsets.to_numpy().astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            return pa.DictionaryArray.from_arrays(coded.indices, pc.binary_join_element_wise(SPACE, coded.dictionary, "")), at - at[0]
        rows = []
        for text in texts.to_pylist():
            marked = (SPACE + text.replace(" ", SPACE)) if text else ""
            rows.append(([marked] if marked else []) if self.crossed else self.cut.findall(marked))
        flat = pa.array(list(itertools.chain.from_iterable(rows)), pa.string())
        return flat.dictionary_encode(), np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with the end id, and where each text's begin, with the end of the last."""
        texts = pc.fill_null(texts, "")
        n = len(texts)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        words, at = self._split(texts)
        values = self.of_words(strings(words.dictionary))
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // self.dtype.itemsize
        code = words.indices.to_numpy().astype(np.int64)
        # the end id is one more word, behind those of each text
        sizes, code = np.append(sizes, 1), np.insert(code, at[1:], len(values))
        flat = np.append(np.frombuffer(b"".join(values), self.dtype), np.array([self.end], self.dtype))
        ids, ends = gathered(flat, sizes, code)
        return ids, ends[at + np.arange(n + 1)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each run of ids; byte pieces that are no UTF-8 become U+FFFD, one for each byte."""
        ids = ids.astype(np.int64)
        raw, ends = gathered(self.text, self.text_sizes, ids)
        data, begins = raw.tobytes(), ends[at].tolist()
        # a mark at the very front is the one that encoding puts there; control ids before it do not count
        shown = np.append(np.flatnonzero(self.kinds[ids] != CONTROL), len(ids))
        first = shown[np.searchsorted(shown, at[:-1])]
        lead = ((first < at[1:]) & self.marked[ids[np.minimum(first, max(len(ids) - 1, 0))]]).astype(int).tolist() if len(ids) else [0] * (len(at) - 1)
        out = [data[a + k : b] for (a, b), k in zip(itertools.pairwise(begins), lead, strict=True)]
        if (self.kinds[ids] == BYTE).any():
            inside = np.concatenate([[0], np.cumsum(self.kinds[ids] == CONTROL)])
            parted = (inside[np.maximum(at[1:] - 1, at[:-1])] > inside[at[:-1]]).tolist()  # a control id parts runs of bytes
            for i, text in enumerate(out):
                try:
                    broken = parted[i] or text.decode() is None
                except UnicodeDecodeError:
                    broken = True
                if broken:
                    out[i] = self._spelled(ids[at[i] : at[i + 1]].tolist(), lead[i])
        return out

    def _spelled(self, ids: list[int], lead: int) -> bytes:
        """decode() of one run with broken bytes: runs of byte pieces apart from the rest."""
        starts = np.cumsum(self.text_sizes) - self.text_sizes
        out = []
        for of_bytes, run in itertools.groupby(ids, lambda i: self.kinds[i] == BYTE):
            data = b"".join(self.text[starts[i] : starts[i] + self.text_sizes[i]].tobytes() for i in run)
            while of_bytes and data:
                try:
                    data.decode()
                    break
                except UnicodeDecodeError as e:
                    out += [data[: e.start], "�".encode()]
                    data = data[e.start + 1 :]
            out.append(data)
        return b"".join(out)[lead:]

    def spelled(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The decimal ids of each run, joined by one space."""
        raw, ends = gathered(self.digits, self.digit_sizes, ids.astype(np.int64))
        data = raw.tobytes()
        return [data[a : max(a, b - 1)] for a, b in itertools.pairwise(ends[at].tolist())]


_LOADED: dict[str, PieceBpe] = {}


def loaded(path: str) -> PieceBpe:
    """One model for each file and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = PieceBpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int, the end id last) of each whole text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in blocks(batches):
            ids, at = model.encode(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text decoded from ids; null ids count as none, and ids outside the vocabulary raise."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            lists = pc.fill_null(batch.column(1), pa.scalar([], pa.list_(pa.int32())))
            at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)])
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            if len(ids) and not (0 <= ids.min() and ids.max() < model.size):
                raise ValueError("an id is not in the vocabulary")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode() for t in model.decode(ids, at)], pa.string())], ["doc_id", "text"])

    return encoded.selectExpr("doc_id", "cast(ids as array<int>) AS ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes each whole text, decodes the ids, and returns digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = path or default_path()
    hexed = lambda parts: pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in blocks(batches):
            ids, at = model.encode(batch.column(1))
            columns = [batch.column(0), pa.array(np.diff(at), pa.int64()), hexed(model.spelled(ids, at)), hexed(model.decode(ids, at))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
