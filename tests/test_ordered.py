import random
import time

import pytest
from pyspark.sql import functions as F

from slotcast.operators import ordered as O


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 5), rng.choice(["a", "b"])) for i in range(500)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k int, v int, s string").repartition(5)


@pytest.mark.parametrize("chunks", [None, 1, 3, 7])
def test_running_and_previous(numbers, chunks):
    seq = O.in_order(numbers, "k", chunks=chunks)
    if chunks and chunks > 1:
        assert seq.select(O.CHUNK).distinct().count() > 1
    out = O.with_previous(O.with_running(seq, {"total": "v"}), ["v", "s"]).collect()
    rows = sorted(out, key=lambda x: x.k)
    total, prev = 0, None
    for place, row in enumerate(rows):
        total += row.v
        assert row[O.POSITION] == place == row.k
        assert row.total == total
        assert (row.prev and tuple(row.prev)) == prev
        prev = (row.v, row.s)


@pytest.mark.parametrize("chunks", [None, 1, 3, 7])
def test_buckets_keep_the_order(spark, numbers, chunks):
    seq = O.in_buckets(numbers, "k", chunks=chunks)
    out = O.with_previous(O.with_running(seq, {"total": "v"}), ["v"]).collect()
    rows = sorted(out, key=lambda x: x.k)
    assert [x[O.POSITION] for x in rows] == list(range(500))
    assert all(b.total == a.total + b.v and b.prev.v == a.v for a, b in zip(rows, rows[1:]))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("slotcast_")]


@pytest.mark.parametrize("length", [1, 60, 500])
def test_stretches_over_many_chunks(numbers, length):
    rows = numbers.withColumn("run", F.floor(F.col("k") / length)).withColumn("w", F.when(F.col("v") > 1, F.col("v")))
    seq = O.with_position(O.in_buckets(rows, "k", chunks=9))
    out = sorted(O.with_stretches(seq, "run", {"total": "w"}, "place").collect(), key=lambda x: x.k)
    for row in out:
        own = [x.w for x in out[row.k // length * length:][:length] if x.w is not None]
        assert (row.total, row.place) == (sum(own) if own else None, row.k % length + 1)


@pytest.mark.parametrize("n", [1, 50, 499, 600])
def test_top_positions(numbers, n):
    got = O.top_positions(numbers, "v", ["k"], n).collect()
    rows = sorted(numbers.collect(), key=lambda x: (-x.v, x.k))[:n]
    assert [x.k for x in sorted(got, key=lambda x: x[O.POSITION])] == [x.k for x in rows]


def test_top_positions_after_a_cut(spark):
    df = spark.range(60_000).selectExpr("id", "cast(pmod(id * 7919, 50021) as double) as s")
    got = {x.id for x in O.top_positions(df, "s", ["id"], 9).collect()}
    rows = sorted(df.collect(), key=lambda x: (-x.s, x.id))[:9]
    assert got == {x.id for x in rows}


@pytest.mark.parametrize("bins", [2, 7, 4096])
def test_cut_keeps_the_top_and_little_else(spark, bins):
    rng = random.Random(40)
    odd = [float("inf"), float("-inf"), float("nan"), None, 0.0, -0.0]
    values = [rng.choice([rng.gauss(0, 1), 10.0 ** rng.randint(-5, 9), 3.0, rng.choice(odd)]) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(values)), "k int, s double")
    for n in (1, 40, 700, 1990):
        near = O._near_top(df, "s", n, bins)
        assert near.count() >= n
        got = [r.k for r in near.orderBy(O.F.desc_nulls_last("s"), "k").limit(n).collect()]
        assert got == [r.k for r in df.orderBy(O.F.desc_nulls_last("s"), "k").limit(n).collect()]
    plain = spark.range(60_000).selectExpr("id", "cast(pmod(id * 7919, 50021) as double) as s")
    assert O._near_top(plain, "s", 9, 4096).count() <= 27


def test_top_positions_with_nulls(spark):
    df = spark.createDataFrame([(i, float(i) if i < 5 else None) for i in range(200)], "k int, s double")
    got = O.top_positions(df, "s", ["k"], 8).collect()
    assert [x.k for x in sorted(got, key=lambda x: x[O.POSITION])] == [4, 3, 2, 1, 0, 5, 6, 7]


def test_quantiles_match_interpolation(spark):
    import numpy as np

    rng = random.Random(9)
    values = [rng.choice([rng.random() * 100, 7.0]) for _ in range(333)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(4)
    shares = [0.0, 0.05, 0.5, 0.7, 0.999, 1.0]
    got = O.quantiles(df, "x", shares).first()
    assert np.allclose(list(got), np.quantile(values, shares))


@pytest.mark.parametrize("bins, few", [(2, 1), (7, 3), (4096, 10_000)])
def test_order_statistics_of_odd_values(spark, bins, few):
    rng = random.Random(77)
    inf = float("inf")
    wild = [inf, -inf, float("nan"), None, 0.0, -0.0, 5e-324, -1.7e308, 1.7e308, 1e-300]
    a = [rng.choice([rng.gauss(0, 1), 3.0, 10.0 ** rng.randint(-9, 9), rng.choice(wild)]) for _ in range(700)]
    b = [rng.choice([1, 1, 1, rng.randint(-5, 50), None]) for _ in a]
    df = spark.createDataFrame([(*x, None) for x in zip(a, b)], "a double, b int, c double").repartition(3)
    got = O.order_statistics(df, {c: lambda n: range(0, n, 13) for c in "abc"}, bins, few)
    high = lambda v: (v != v, v if v == v else 0.0)  # NaN above all numbers
    for name, values in (("a", a), ("b", b), ("c", [])):
        right = sorted((float(v) for v in values if v is not None), key=high)
        n, found = got[name]
        assert n == len(right) and sorted(found) == list(range(0, n, 13))
        assert all(found[k] == right[k] or (found[k] != found[k] and right[k] != right[k]) for k in found)


def test_quantiles_of_nothing_and_of_one_row(spark):
    df = spark.createDataFrame([(None, 4.5)], "x double, y double")
    assert O.quantiles_of(df, {"x": [0.5, 1.0], "y": [0.0, 0.3]}) == {"x": [None, None], "y": [4.5, 4.5]}
    assert tuple(O.quantiles(df, "x", [0.5]).first()) == (None,)
    assert O.quantiles(df.where("false"), "y", [0.5, 0.1]).dtypes == [("q0", "double"), ("q1", "double")]


def test_empty_input(spark):
    df = spark.createDataFrame([], "k int, v int")
    assert O.with_running(O.in_order(df, "k"), {"t": "v"}).count() == 0


def test_firsts_of_stretches_across_chunks(spark):
    rows = [(i, i // 7, None if i % 7 == 0 and i % 2 else i * 10) for i in range(60)]
    df = O.in_order(spark.createDataFrame(rows, "k int, run int, v int").repartition(3), "k", chunks=9)
    got = O.with_stretches(O.with_position(df), "run", {"total": "v"}, "place", firsts={"head": "v", "at": "k"}).collect()
    assert len(got) == 60
    for r in got:
        mine = [v for k, run, v in rows if run == r.run]
        assert (r.at, r.head, r.total, r.place) == (r.run * 7, mine[0], sum(v for v in mine if v is not None), r.k % 7 + 1)


def test_shuffle_files_go_with_each_stored_table(spark):
    from slotcast import session

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        found = manager.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before = shuffled()
    setting = spark.conf.get(session.SWEEP, None)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    for make in (session.stored, session.settle, lambda x: O.in_buckets(x, "k", chunks=3)):
        assert make(df).count() == 7
        assert spark.conf.get(session.SWEEP, None) == setting
    for _ in range(50):  # files are removed by messages
        own = {n for n in shuffled() - before if n.endswith(".data")}
        if len(own) <= 3:  # those of the three counts, which are no stored tables
            break
        time.sleep(0.1)
    assert len(own) <= 3
