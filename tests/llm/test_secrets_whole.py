"""Secrets of every length and alphabet, in a sensitive context."""

import random
import string

import pytest

from netloom.llm import secret_scan

SIDE = "the quick brown fox jumps over the lazy dog and then some mor"


@pytest.mark.parametrize("letters", [string.ascii_lowercase + string.digits, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEF", string.ascii_letters + string.digits + "+/"])
@pytest.mark.parametrize("length", [40, 88, 128, 201, 250])
def test_random_strings_are_found(letters, length):
    novelty, r, found = secret_scan.Novelty(), random.Random(length), 0
    for _ in range(40):
        text = f"{SIDE} bearer {''.join(r.choices(letters, k=length))} {SIDE}"
        start = text.index("bearer ") + 7
        found += (start, 3, start + length) in secret_scan.novel_spans(text, secret_scan.base_spans(text), novelty)
    assert found >= 34


def test_long_repeats_and_identifiers_are_not_novel():
    novelty = secret_scan.Novelty()
    for word in ("a1" * 300, "refresh_token_endpoint_url", "AbstractAuthenticationProcessingFilter", "session_timeout_in_seconds_30"):
        text = f"{SIDE} bearer {word} {SIDE}"
        assert not secret_scan.novel_spans(text, secret_scan.base_spans(text), novelty)


@pytest.mark.parametrize("letters", [string.ascii_lowercase, string.ascii_uppercase, string.digits, string.ascii_letters + string.digits + "!$%&*"])
@pytest.mark.parametrize("length", [16, 20, 32, 64, 200, 500])
def test_one_class_and_punctuated_strings_are_covered(letters, length):
    novelty, r, found = secret_scan.Novelty(), random.Random(length), 0
    for _ in range(40):
        word = "".join(r.choices(letters, k=length))
        text = f"{SIDE} authorization bearer {word} {SIDE}"
        base = secret_scan.base_spans(text)
        covered = {i for s, _, e in base + secret_scan.novel_spans(text, base, novelty) for i in range(s, e)}
        start = text.index(word)
        found += covered >= set(range(start, start + length))
    assert found >= (38 if length > 16 or not letters.isalpha() else 26)  # 16 letters may be a word


def test_nothing_of_a_partly_matched_secret_stays(spark):
    secret = "Zq8Rt2LmKp9Xw4Vb0123456789abcdefYt7Nc3QsHd5Gj1Wz"
    docs = spark.createDataFrame([(1, f"{SIDE} authorization bearer {secret} and {SIDE}."), (2, SIDE), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secret_scan.redacted(docs).collect()}
    assert got == {1: f"{SIDE} authorization bearer [SECRET] and {SIDE}.", 2: SIDE, 3: None}
    kinds = {r.doc_id: (r.n_hex, r.n_novel) for r in secret_scan.scan(docs).collect()}
    assert kinds == {1: (1, 1), 2: (0, 0), 3: (0, 0)}


def test_false_alarms_on_words_and_paths_are_few():
    parts = ["internation", "configuration", "ization", "settings", "connection", "example", "represent", "responsib", "element", "identifier", "client", "com"]
    novelty = secret_scan.Novelty(secret_scan.spelled_words(parts))
    words = ["internationalization", "responsibilities", "getelementbyidentifier", "https://www.example.com/index.html", "configuration-settings.example", "com.example.client.ConnectionSettings"]
    words += ["################", "----------------", "................", "misrepresentations", "client.connection.settings.example", "user_name@example.com/configuration"]
    alarms = []
    for word in words:
        text = f"{SIDE} the token and the {word} {SIDE}"
        alarms += [word] * bool(secret_scan.novel_spans(text, secret_scan.base_spans(text), novelty))
    assert len(alarms) <= 2, alarms


def test_words_come_from_all_documents(spark):
    """Ten words of three documents each among 6,000: none is missed, and copies of a text count once."""
    rows = [(i, f"text {i}" + (f" word_{chr(97 + i % 10) * 5}" if i >= 5_970 else "")) for i in range(6_000)]
    rows += [(10_000 + i, "onlycopies") for i in range(5)]
    words = secret_scan.corpus_words(spark.createDataFrame(rows, "doc_id long, text string")).decode().split()
    assert set(words) == {"text", "word", *(chr(97 + i) * 5 for i in range(10))}
