"""JOI-14's first match in a band: against all pairs, over odd values, and in proportion to its input."""

import random

import pytest

from tallyforge.plans import joins

FOUND, LISTED = "number long, kind string, value double", "position long, name string, kind string, value double"


def brute(found, known, claims, width):
    listed = [(0, *r) for r in known] + [(1, p, n, k, v * 100 if v is not None and k is not None and k != "count" and v < 1 else v) for p, n, k, v in claims]
    met = {}
    for number, kind, v in found:
        for rank, position, name, k, w in listed:
            if None in (number, kind, v, k, w) or (kind == "count") != (k == "count"):
                continue
            if v == w if kind == "count" else abs(v - w) < width:
                met[number] = min(met.get(number, (9,)), (rank, position, name))
    return sorted(((n, *((("known", "claim")[met[n][0]], met[n][2]) if n in met else ("unverified", None))) for n, _, _ in found), key=str)


@pytest.mark.parametrize("block", [1 << 20, 5])
def test_first_matches_are_those_of_all_pairs(spark, block):
    rng = random.Random(4)
    odd = [float("inf"), float("-inf"), float("nan"), 1e300, -1e300, 1e19, 2.0**60, 0.0, -0.0, None]
    near = [k * 0.15 + e for k in (-2, -1, 0, 1, 2, 7) for e in (0.0, 5e-17, -5e-17, 1e-12, -1e-12)]
    number = lambda: rng.choice([rng.choice(odd), rng.choice(near), round(rng.uniform(-3, 9), 2), rng.uniform(0, 1)])
    kind = lambda: rng.choice(["count", "percent", "percent", "ci", None])
    found = [(rng.choice([None, *range(900)]), kind(), number()) for _ in range(800)]
    known = [(k, f"k{k}", kind(), number()) for k in rng.sample(range(500), 60)]
    claims = [(k, f"c{k}", kind(), number()) for k in rng.sample(range(500), 60)]
    got = joins.matched_claims(spark.createDataFrame(found, FOUND), spark.createDataFrame(known, LISTED), spark.createDataFrame(claims, LISTED), 0.15, block)
    assert sorted(map(tuple, got.collect()), key=str) == brute(found, known, claims, 0.15)
    none = spark.createDataFrame([], LISTED)
    assert {r.source for r in joins.matched_claims(spark.createDataFrame(found, FOUND), none, none).collect()} == {"unverified"}
    assert joins.matched_claims(spark.createDataFrame([], FOUND), none, none).count() == 0


def test_one_crowded_band_makes_no_pairs(spark):
    n = 60_000  # 3.6 billion pairs in the band, as many of equal counts
    rows = spark.range(n).selectExpr("id", "concat('k', id) AS name", "if(id % 2 = 0, 'percent', 'count') AS kind", "if(id % 2 = 0, 50 + id / 1e6, 7D) AS value")
    found, known = rows.selectExpr("id AS number", "kind", "value"), rows.selectExpr("id AS position", "name", "kind", "value")
    got = joins.matched_claims(found, known, known.where("false"), block=1 << 13).groupBy("source", "claim").count().collect()
    assert sorted(map(tuple, got)) == [("known", "k0", n // 2), ("known", "k1", n // 2)]
