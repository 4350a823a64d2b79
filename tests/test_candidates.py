"""Candidates beside the frozen features, on small frames."""

import hashlib
import struct

import pytest

from netloom.operators import alerts as A
from netloom.operators import candidates as C


def test_structured_identity_is_the_digest_of_its_parts(spark):
    rows = [(1.0, -0.0, "a", "bc"), (1.0, 0.0, "ab", "c"), (1.0, 0.0, "a", "bc")]
    got = [r["identity"] for r in C.with_structured_identity(spark.createDataFrame(rows, "x double, y double, p string, q string"), ["x", "y"], ["p", "q"], "v1").collect()]
    parts = b"".join(len(t).to_bytes(4, "big") + t for t in (b"a", b"bc"))
    assert got[0] == got[2] == hashlib.sha256(b"v1" + struct.pack("<dd", 1.0, 0.0) + parts).hexdigest() and got[1] != got[0]
    with pytest.raises(Exception, match="finite"):
        C.with_structured_identity(spark.createDataFrame([(float("nan"), "a")], "x double, p string"), ["x"], ["p"], "v1").collect()


def test_vector_problem_in_order(spark):
    rows = [(None,), ([],), ([1.0, float("inf")],), ([1.0, None, 2.0],), ([1.0],), ([1.0, 2.0, 3.0],)]
    got = [r["problem"] for r in C.with_vector_problem(spark.createDataFrame(rows, "v array<double>"), "v", 3).collect()]
    assert got == ["no features", "no features", "features are not finite", "features are not finite", "expected 3 features, received 1", None]


def test_universe_raises_without_support(spark):
    rows = [("a", "DoS"), ("a", "Worms"), ("b", "DoS"), ("c", "Normal")]
    universe = C.family_universe(spark.createDataFrame(rows, "identity string, label string"))
    by = {r["label"]: r for r in universe.collect()}
    assert (by["Worms"]["retained_identities"], by["DoS"]["retained_rows"], by["Normal"]["is_attack_family"]) == (0, 1, False)
    for least in (1, 3):
        with pytest.raises(ValueError, match="attack families"):
            C.require_universe(universe, least)


def test_unknown_alert_raises(spark):
    missing = spark.createDataFrame([("A-1",)], "alert_id string")
    with pytest.raises(ValueError, match="A-1"):
        A.require_known(missing)
    A.require_known(missing.limit(0))
