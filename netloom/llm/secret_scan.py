"""Secret scan: patterns, and dictionary-primed compression novelty.

The base spans come from three fixed patterns. The method adds spans: in a sensitive context (a key-like word
just before) a candidate string is measured by its marginal compressed bytes: the zstandard frame of
"surrounding text + candidate" less that of the surrounding text alone, under a dictionary of key words, common prose
and the word parts of the corpus' own identifiers (`corpus_words`, counted over all documents). A string
that neither its surroundings nor the dictionary explain costs what random strings of its length over its own alphabet
cost there; names, paths and words cost less. Candidates that cost SHARE of that or more are reported as kind novel,
whole, unless a base span covers all of them. Long candidates are measured in pieces.

Offsets are code points, end exclusive; a base span is the whole match. Rows: a null text counts as empty and
has no spans; repeated rows are scanned alike, and copies of a text count once for the dictionary; texts of any length
are scanned whole; an empty table has an empty word list and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm import library_tokens
from netloom.llm.common import discard, materialize, slices, spread_join, tidy

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_CHARS = 16
#: Rulers and the like have fewer different characters; 16 random digits have more but once in 10,000.
DISTINCT = 5
#: A string of 16 characters or more without white space, which counts if a key-like word stands in the REACH characters before it, on the same line.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=!#$%&*@^~?.:-]{16,}")
#: Marks that end a sentence or clause are no part of a candidate's end.
CLAUSE = ".:?"
REACH = 60
#: Longer candidates are cut into pieces of at most so many characters; one novel piece makes the whole novel.
PIECE = 200
HINTS = re.compile("bearer|auth|credential|private[_ -]?key|client[_ -]?id|passphrase|pwd|access[_ -]?key|signature|webhook|session[_ -]?id|secret|token|passw|api[_ -]?key")
#: Characters of surrounding text on either side that prime the compressor.
CONTEXT = 256
#: A candidate is novel from this share of the mean marginal size of DRAWS random strings on.
SHARE, DRAWS, SHORT = 0.85, 4, 24
#: The alphabet of a string is the first that holds it, else the union of the CLASSES it has characters of.
ALPHABETS = tuple(map(frozenset, ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789ABCDEF", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz234567")))
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", *"+/_=-!#$%&*@^~?.:")
#: Strings that identifiers and prose are made of; primes the compressor, so that they cost little.
DICTIONARY = (
    b"abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 11111111 12345678 "
    b"https://www.example.com/index.html http://localhost:8080/api/v1 org net .json .yaml .py user_name first_name last_name user_id client_id account_id session_id "
    b"getElementById addEventListener toString valueOf className function return const import export default "
    b"config settings example placeholder changeme your_token_here your_api_key_here YOUR_SECRET_KEY xxxxxxxxxxxxxxxx "
    b"environment variable process.env os.environ localhost database connection string private public protected "
    b"authorization bearer access_key secret_key api_key auth_token refresh_token password passphrase credential "
    b"the and ing tion ment ence able with from that this have which there their would about other into than "
    b"die der und den mit ist des ein eine nicht auf sich werden que los las del por con para una les des dans pour "
)
#: The corpus' words are the commonest of all documents, in LEAST of them or more each, and fill WORD_BYTES at most.
LEAST, WORD_BYTES = 3, 8192
#: Identifiers, and the parts of their names that count as words; shorter parts occur in secrets by chance.
IDENTIFIER, PART = "[A-Za-z_][A-Za-z0-9_]{3,}", "[A-Z]?[a-z]{3,19}|[A-Z]{4,20}"


def spelled_words(words: list[str]) -> bytes:
    """The words for the dictionary, the first ones last, where the compressor reaches them at least cost."""
    held = words[:]
    while sum(map(len, held)) + len(held) > WORD_BYTES:
        held.pop()
    return " ".join(reversed(held)).encode()


def corpus_words(docs: DataFrame) -> bytes:
    """The commonest parts of identifiers over all distinct texts. Only texts that repeat are shuffled, once each."""
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0)))
    parts = F.array_distinct(F.flatten(F.transform(names, lambda name: F.regexp_extract_all(name, F.lit(PART), F.lit(0)))))
    texts = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("_text"), "text")
    several = materialize(texts.groupBy("_text").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_text"))
    single = spread_join(texts, several, ["_text"], "_text", "left_anti").select(F.explode(parts).alias("part"))
    again = spread_join(texts, several, ["_text"], "_text").dropDuplicates(["_text"]).select(F.explode(parts).alias("part"))
    counted = single.union(again).groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST)
    words = [r.part for r in counted.orderBy(F.desc("n"), "part").limit(WORD_BYTES // 4).collect()]
    discard(several)
    return spelled_words(words)


class Novelty:
    """Marginal compressed size of strings under the dictionary."""

    def __init__(self, words: bytes = b""):
        data = zstandard.ZstdCompressionDict(words + b" " + DICTIONARY, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=19)
        self.compressor = zstandard.ZstdCompressor(level=19, dict_data=data, write_content_size=False, write_dict_id=False)

    def share(self, before: str, candidate: str, after: str) -> float:
        """Marginal size of the candidate between its surroundings, as a share of that of random strings like it."""
        around = (before + "\n" + after + "\n").encode()
        alone = len(self.compressor.compress(around))
        size = lambda word: len(self.compressor.compress(around + word.encode())) - alone
        letters = alphabet(candidate)
        drawn = random.Random(f"{len(candidate)} {letters}")
        like = [size("".join(drawn.choices(letters, k=len(candidate)))) for _ in range(DRAWS)]
        # sizes are whole bytes: in a short string one byte of the mean is by chance; words of letters get no such allowance
        return (size(candidate) + (len(candidate) < SHORT and not candidate.isalpha())) * DRAWS / max(1, sum(like))

    def novel(self, before: str, candidate: str, after: str) -> bool:
        """Whether the candidate, or a piece of a long one, costs nearly what random strings cost."""
        n = -(-len(candidate) // PIECE)
        cuts = [len(candidate) * i // n for i in range(n + 1)]
        return any(self.share(before, candidate[a:b], after) >= SHARE for a, b in zip(cuts, cuts[1:], strict=False))


def alphabet(word: str) -> str:
    """The letters that random strings like the word are drawn from."""
    letters = set(word)
    fixed = next((a for a in ALPHABETS if letters <= a), None)
    return "".join(sorted(fixed)) if fixed else "".join(c for c in CLASSES if not letters.isdisjoint(c))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """(start, kind, end) of incompressible strings in a sensitive context that no base span covers."""
    found = []
    for m in CANDIDATE.finditer(text):
        word = m[0].rstrip(CLAUSE)
        start, end = m.start(), m.start() + len(word)
        if len(word) < LEAST_CHARS or len(set(word)) < DISTINCT or any(s <= start and end <= e for s, _, e in base):
            continue
        if not HINTS.search(text[max(0, start - REACH) : start].rpartition("\n")[2].lower()):
            continue
        if novelty.novel(text[max(0, start - CONTEXT) : start], word, text[end : end + CONTEXT]):
            found.append((start, 3, end))
    return found


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of docs, with a mark in the text for each run of overlapping spans."""
    place, words = docs.columns.index("text"), corpus_words(docs)

    def clean(text: str | None, novelty: Novelty) -> str | None:
        base = base_spans(text or "")
        spans = sorted(base + novel_spans(text or "", base, novelty))
        out, at = [], 0
        for start, _, end in spans:
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]]) if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library_tokens.dropped()
        novelty = Novelty(words)
        for batch in slices(batches):
            texts = pa.array([clean(t, novelty) for t in batch.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == place else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(tidy(run), docs.schema)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans of each whole text."""
    words = corpus_words(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library_tokens.dropped()
        novelty = Novelty(words)
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = sorted(base + novel_spans(text, base, novelty))
                kinds = [kind for _, kind, _ in spans]
                rows.append((*map(kinds.count, range(4)), hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(spans)))
            a, k, h, v, sha, all_ = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in (a, k, h, v)), pa.array(sha), pa.array(all_)],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"],
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)
