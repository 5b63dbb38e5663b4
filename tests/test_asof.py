"""The as-of join against a loop over all versions: ties, nulls, clashing names, one key that most rows have."""

import random
from datetime import datetime, timedelta

import pytest

from ledgerloom.operators.asof import as_of

START = datetime(2027, 1, 1)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("unit", ["hour", "month"])
def test_as_of_equals_a_loop(spark, strict, unit):
    rng = random.Random(3)
    when = lambda: rng.choice([None, START + timedelta(hours=rng.randrange(200) / 2)])
    key = lambda: rng.choice(["hot", "hot", "hot", "a", "b", None])
    rows = [(k, key(), when(), "x") for k in range(150)]
    versions = [(key(), when(), rng.randrange(4)) for _ in range(80)]
    out = as_of(spark.createDataFrame(rows, "seq long, k string, t timestamp, version_of string"), spark.createDataFrame(versions, "k string, t timestamp, value int"), "k", "t", unit, strict)
    assert out.columns == ["seq", "k", "t", "version_of", "version"]
    want = {}
    for seq, k, t, _ in rows:
        fits = [(u, v) for j, u, v in versions if k is not None and j == k and t is not None and u is not None and (u < t or (u == t and not strict))]
        want[seq] = max(fits) if fits else None
    assert {r.seq: (r.version.t, r.version.value) if r.version else None for r in out.collect()} == want


def test_empty_sides(spark):
    rows = spark.createDataFrame([(1, "a", START)], "seq long, k string, t timestamp")
    none = spark.createDataFrame([], "k string, t timestamp, value int")
    assert [r.version for r in as_of(rows, none, "k", "t").collect()] == [None]
    assert as_of(rows.limit(0), none, "k", "t").collect() == []
