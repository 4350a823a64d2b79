"""Stages of the pipeline on small frames: line templates against SQL, near copies against all pairs, secrets by spans."""

import random
import re

import duckdb
import pytest

from netloom.llm import line_dedup, secret_scan

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(12)
    words = [f"w{i}x" for i in range(300)]
    base = [" ".join(r.choice(words) for _ in range(r.choice([3, 5, 9, 30, 60, 120]))) for _ in range(24)]
    out = base[:]
    for t in base[:14]:  # copies with a few words changed, around the threshold
        for share in (0.0, 0.01, 0.03, 0.06, 0.12):
            out.append(" ".join(r.choice(words) if r.random() < share else w for w in t.split(" ")))
    lines = ["Served {} users in {} ms today.", "Visit our site for more information", "The user {} has logged in from {}"]
    out = [t + "".join("\n" + line.format(i, 3 * i + k) for k, line in enumerate(lines) if (i + k) % 3 == 0) for i, t in enumerate(out)]
    return [*out, None, "", "  ", "one", out[3], out[3]]


def test_near_copies_keep_the_least_of_each_component(spark, texts):
    import corpus_pipeline as P

    sets = []
    for t in texts:
        ws = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set())
    part = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    part[i] = part[j] = min(part[i], part[j])
        new = [part[p] for p in part]
        if new == part:
            break
        part = new
    want = {i for i, p in enumerate(part) if p == i}
    got = P.near_copies(spark, frame(spark, texts), "")
    assert got.columns == P.COLUMNS and {r.doc_id for r in got.collect()} == want and len(want) <= len(texts) - 20


def test_template_lines_against_sql(spark, texts):
    import corpus_pipeline as P

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = {}
    for doc_id, _, dropped, text in con.execute("SELECT doc_id, n_lines, n_dropped, text FROM (" + line_dedup.SQL + ")").fetchall():
        if not (dropped and re.sub(r"\s+", " ", text).strip() == ""):
            want[doc_id] = (text, len(text))
    got = {r.doc_id: (r.text or "", r.n_chars or 0) for r in P.template_lines(spark, frame(spark, texts), "").collect()}
    assert got == want and any(texts[i] != t for i, (t, _) in want.items())


def test_secrets_go_and_clean_texts_stay(spark, texts):
    import corpus_pipeline as P

    r = random.Random(3)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    planted = ["".join(r.choice(alnum) for _ in range(32)) for _ in range(20)]
    rows = [f"before it the bearer {s} and after it" for s in planted[:10]] + [f'config {{"api_key": "{s}"}} end' for s in planted[10:]] + list(texts)
    got = {x.doc_id: x for x in P.secrets_redacted(spark, frame(spark, rows), "").collect()}
    assert len(got) == len(rows)
    left = [s for s in planted if any(s[i : i + 12] in (got[k].text or "") for k in range(20) for i in range(20))]
    assert not left
    for k, text in enumerate(rows):
        assert got[k].n_chars == (None if got[k].text is None else len(got[k].text))
        if k >= 20:
            spans = secret_scan.base_spans(text or "")
            want, at = [], 0
            for start, _, end in spans:
                if start >= at:
                    want += [(text or "")[at:start], "[SECRET]"]
                at = max(at, end)
            assert got[k].text == ("".join([*want, text[at:]]) if spans else text)


def test_edge_rows_have_their_results(spark, tmp_path):
    import corpus_pipeline as P

    rows = [None, "", "", "some words to keep here today", "word " * 5000, "some words to keep here today"]
    spark.createDataFrame([(9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, rows)
    sizes = []
    for name, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        sizes.append((name, docs.count()))
    # without labels all scores are 0.5 and accepted; the copy of the fourth document goes
    assert sizes[:4] == [("quality_filter", 6), ("template_lines", 6), ("near_copies", 5), ("secrets_redacted", 5)]
    packed = docs.select("doc_id", "length").groupBy("doc_id").sum("length").collect()
    assert {r.doc_id for r in packed} == {0, 1, 2, 3, 4} and {r["sum(length)"] for r in packed if r.doc_id < 3} == {1}
