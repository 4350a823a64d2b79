"""The audit against brute force in plain whole numbers."""

import re
from collections import Counter, defaultdict

import pytest

from netloom.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, shard int, term string, n long, place long"


def brute(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [(lang or "", source or "", re.findall(D.TERM, (text or "").translate(lower))) for text, lang, source in rows]
    out = []
    for lang in {w[0] for w in words}:
        of = [w for w in words if w[0] == lang]
        seen = Counter(t for _, _, ts in of for t in set(ts))
        kept = {t for t, n in seen.items() if n >= least}
        count = defaultdict(Counter)
        for _, source, ts in of:
            count[source].update(t for t in ts if t in kept)
        whole = sum(count.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        ps, q = {s: p(c) for s, c in count.items()}, p(whole)
        for s in ps:
            pairs = [(sum((ps[s][t] - ps[o][t]) ** 2 // (ps[s][t] + ps[o][t]) for t in kept), o) for o in ps if o != s]
            terms = [((ps[s][t] - q[t]) ** 2 // (ps[s][t] + q[t]), t) for t in kept if count[s][t] and ps[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    texts = ["The the THE cat's naïve Émile zoë x1y", "the dog; the cat", "Über über ÜBER the", "", None, "  12 _ 3 ", "a\x00b c\x7fd e f the", "only here", "the 漢字 漢字 cat dog " * 300]
    rows = [(t, lang, f"s{(i + j) % 5}" if (i + j) % 7 else None) for i, lang in enumerate(("en", "de", None, "xx")) for j, t in enumerate(texts * (2 if lang == "en" else 1))]
    rows += [("just this", "lone", "a"), (None, "lone", "b"), ("one source", "single", "a")]
    df = spark.createDataFrame([(i, *r, 1, "t", 2, 3) for i, r in enumerate(rows)], SCHEMA).repartition(4)
    for least, top, shard in ((2, 10, D.SHARD_ROWS), (1, 3, 5), (10, 10, 1)):
        monkeypatch.setattr(D, "SHARD_ROWS", shard)
        got = sorted(tuple(r) for r in D.audit(df, least, top).collect())
        assert got == brute(rows, least, top), (least, shard)
    assert {r[0] for r in got} >= {"lone", "xx", ""} and D.audit(df.limit(0)).count() == 0


def test_counts_given_away_early_are_the_same(spark, monkeypatch):
    words = [" ".join(chr(97 + (i * j) % 26) * (1 + j % 3) for j in range(40)) for i in range(60)]
    rows = [(w, "en", f"s{i % 3}") for i, w in enumerate(words)]
    df = spark.createDataFrame([(i, *r, 1, "t", 2, 3) for i, r in enumerate(rows)], SCHEMA).coalesce(1)
    monkeypatch.setattr("netloom.llm.library_tokens.BLOCK_BYTES", 300)
    partial = D.counts(df)
    whole = Counter()
    for r in partial.collect():
        whole[r.lang, r.source, r.term] += r.n
    want = Counter((lang, s, t) for text, lang, s in rows for t in text.split())
    assert +whole == want
    assert sorted(tuple(r) for r in D.audit(df).collect()) == brute(rows, 10, 10)


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_divergence"])
def test_sql(spark, sf, name):
    import duckdb

    from netloom.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    frame = queries.queries()[name](spark, sf)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(want.columns)
    assert sorted(tuple(r) for r in frame.collect()) == sorted(want.project(", ".join(frame.columns)).fetchall())
