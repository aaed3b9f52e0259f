"""Running sums, ranks and percentiles by ranges: one hot key, null keys, ties and no values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import ordered, ranks
from quillmark.sources import staging


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = [("hot", float(rng.randrange(400)) / 7) for _ in range(3000)] + [("tied", 2.0)] * 500 + [("one", 5.0), ("none", None), ("none", None), (None, 1.0), (None, 4.0)]
    return out + [("some", rng.choice([None, -0.5, 0.0, 3.0, 1e300, -1e300])) for _ in range(50)]


@pytest.fixture
def spread(spark):
    """Partitions that adaptive execution doesn't merge, so that keys span several."""
    key, before = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(key, False)
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    yield spark
    spark.conf.unset(key)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def by_key(rows):
    out = {}
    for k, v in rows:
        out.setdefault(k, []).append(v)
    return out


def test_percentiles(spread, rows):
    shares = {"low": 0.025, "q1": 0.25, "med": 0.5, "high": 0.975}
    got = {r.k: r for r in ordered.percentiles(spread.createDataFrame(rows, "k string, v double"), ["k"], "v", shares).collect()}
    for k, values in by_key(rows).items():
        there = [v for v in values if v is not None]
        for name, q in shares.items():
            assert got[k][name] == (pytest.approx(np.quantile(there, q), rel=1e-12) if there else None), (k, name)
    whole = ordered.percentiles(spread.createDataFrame(rows, "k string, v double"), [], "v", shares).first()
    assert whole.q1 == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.25))
    agreed = spread.createDataFrame(rows, "k string, v double").groupBy("k").agg(F.percentile("v", F.lit(0.3)).alias("p"))
    mine = ordered.percentiles(spread.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p": 0.3})
    assert sorted(map(tuple, agreed.collect()), key=repr) == sorted(map(tuple, mine.collect()), key=repr)


def test_a_hot_key_is_cut_into_ranges(spread, rows):
    r = ordered.ranged(spread.createDataFrame([(k, v) for k, v in rows if k == "hot"], "k string, v double"), ["k"], "v")
    assert r.select("_range").distinct().count() >= 5
    assert r.groupBy("v").agg(F.countDistinct("_range").alias("n")).agg(F.max("n")).first()[0] == 1


def test_ranks_and_sums(spread, rows):
    got = {(r.k, r.v): (r["rank"], r.n) for r in ranks.value_ranks(spread.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    for k, values in by_key(rows).items():
        there = sorted(v for v in values if v is not None)
        for v in set(there):
            places = [i + 1 for i, x in enumerate(there) if x == v]
            assert got[k, v] == (sum(places) / len(places), len(there))
    assert ("none", None) not in got
    numbers = ordered.numbered(spread.createDataFrame([(f"u{i:03d}",) for i in range(300)], "uid string"), "uid", "at").collect()
    assert {r.uid: r.at for r in numbers} == {f"u{i:03d}": i for i in range(300)}


def test_knots_across_ranges(spread):
    """Values whose knots lie in other ranges, or all on one side."""
    rng = random.Random(4)
    train = [("a", float(rng.randrange(60))) for _ in range(40)] + [("b", 3.0)] * 4
    held = [("a", rng.uniform(-5, 70)) for _ in range(300)] + [("a", None), ("b", 2.0), ("b", 9.0)]
    knots, med = ranks.fit_knots(spread.createDataFrame(train, "k string, value double"), ["k"])
    got = ranks.apply_knots(spread.createDataFrame(held, "k string, value double"), knots, med, ["k"]).collect()
    xs = sorted({v for k, v in train if k == "a"})
    table = {r.x: r.p for r in knots.where("k = 'a'").collect()}
    for r in got:
        x = r.value if r.value is not None else float(np.median([v for k, v in train if k == "a"]))
        assert r.p == pytest.approx(np.interp(x, xs, [table[v] for v in xs]) if r.k == "a" else 0.5)
    assert len(got) == len(held)


def test_empty(spread):
    none = spread.createDataFrame([], "k string, v double")
    assert ordered.percentiles(none, ["k"], "v", {"m": 0.5}).count() == 0 and ranks.value_ranks(none, ["k"], "v").count() == 0


def test_staged_tables_go_when_cleared(spark, monkeypatch):
    monkeypatch.setattr(staging, "_places", [])
    table = staging.staged(spark.range(5), "some")
    place = staging._places[0]
    assert table.count() == 5 and place.rpartition("/")[2].startswith("some-")
    staging.cleared(spark)
    assert not staging._places
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(place)
