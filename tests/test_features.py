"""How the feature plan stores, orders and spreads its rows."""

import datetime
import pathlib

import pytest
from pyspark.sql import DataFrameWriter, functions as F

from slotcast import constants as K, session
from slotcast.operators import lags
from slotcast.plans import features as FE
from slotcast.workload import encodings, planning


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Events of 30 days and their products, 20 a day."""
    folder = str(tmp_path_factory.mktemp("tables"))
    first = datetime.datetime(2024, 1, 1)
    events = [
        (i, first + datetime.timedelta(minutes=72 * i), i * 7 % 11, ("view", "click", "error")[i * i % 3], 5.0 + i % 40, '{"k": %d}' % (i % 100))
        for i in range(600)
    ]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(events, schema).write.parquet(f"{folder}/events.parquet")
    parts = [(i, f"red {i % 3}", f"Brand#{i % 2}", ("LARGE", "SMALL")[i % 2], i % 4, 900.0 + i) for i in range(11)]
    schema = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    spark.createDataFrame(parts, schema).write.parquet(f"{folder}/part.parquet")
    return folder


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def staged(spark, tables):
    aired, rows = planning._base_rows(spark, tables)
    side = planning._side(spark, tables, aired, rows)
    return rows.select(*planning.RAW), side, FE.stage(rows.select(*planning.RAW), side, planning.CONFIG)


def test_passes_over_a_stage_read_their_own_columns(spark, tables):
    raw, _, base = staged(spark, tables)
    plan = physical(base.groupBy("months").sum("sales"))
    assert "ReadSchema: struct<sales:double,months:int>" in plan
    calendar = FE.calendar_columns(raw, planning.CONFIG).columns
    assert base.columns[: len(calendar)] == calendar
    # the calendar is a function of the row, wherever in the plan it is made
    again = FE.calendar_columns(base.select(*planning.RAW), planning.CONFIG).select(*calendar)
    assert again.exceptAll(base.select(*calendar)).count() == 0


def test_large_lookups_meet_narrow_rows(spark, tables, monkeypatch):
    _, side, base = staged(spark, tables)
    seen = {}

    def watch(name):
        plain = getattr(lags, name)

        def watched(df, *args, **more):
            seen[name] = df.columns
            return plain(df, *args, **more)

        monkeypatch.setattr(lags, name, watched)

    for name in ("prev_week", "prev_show_mean_price"):
        watch(name)
    made = FE.finish(base, side, planning.CONFIG).frame
    for columns in seen.values():
        assert not {"hours_inweek", "weekdays", "men", "luxury", "dup_times", "freq"} & set(columns)
    # columns come in the order of the steps, and no row is lost or doubled
    order = ["hours_inweek", "primetime", "freq", "sales_power", "dup_times", "lag_scode_price", "lag_all_price_day", "small_click_r", "exposed_t", "rolling_mean_7"]
    places = [made.columns.index(c) for c in order]
    assert places == sorted(places)
    assert made.select("ts", "product_code").exceptAll(base.select("ts", "product_code")).count() == 0
    assert made.count() == base.count()


def test_products_are_spread_before_they_unfold(spark, tables, monkeypatch):
    rows = planning._base_rows(spark, tables)[1]
    monkeypatch.setattr(planning, "_years", lambda *_: (rows, None, None, {}, FE.SideTables()))
    monkeypatch.setattr(FE, "run_candidates", lambda cells, *_: cells)
    cells = planning._candidates(spark, tables, "hungarian")[2]
    # the groups are exchanged by product, then their rows by number, which is never coalesced
    assert "RoundRobinPartitioning" in physical(cells)
    filled = cells.groupBy(F.spark_partition_id()).count().count()
    assert filled == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert cells.count() == rows.select("product_code").distinct().count() * 30 * 24


def test_model_rows_are_read_by_column(spark, tables):
    rows = encodings.modelled(spark, tables)
    assert rows.count() == 600
    assert "ReadSchema: struct<unit_price:double,sales:double>" in physical(rows.select("unit_price", "sales"))


def test_rows_with_shows_are_stored_before_the_categories(spark, tables, monkeypatch):
    plans = {}

    def watched(df, label="stored"):
        plans[label] = physical(df)
        return session.stored(df, label)

    monkeypatch.setattr(FE, "stored", watched)
    base = staged(spark, tables)[2]
    assert list(plans) == ["shown", "stage"]
    assert "small_c" not in plans["shown"] and "parttime" in plans["shown"]
    # the categories' run reads rows with shows, and makes neither shows nor their windows
    assert "Window" not in plans["stage"] and "/shown-" in plans["stage"]
    rows = planning._base_rows(spark, tables)[1].where("sales IS NOT NULL AND sales != 50000")
    named = ["ts", "product_code", "sales", *planning.TREE]
    assert base.select(*named).exceptAll(rows.select(*named)).count() == 0
    assert base.count() == rows.count()


def test_large_lookups_are_stored_one_by_one(spark, tables, monkeypatch):
    base, labels = staged(spark, tables)[2], []

    def watched(df, label="stored"):
        labels.append((label, [c for c in df.columns if c not in base.columns]))
        return session.stored(df, label)

    monkeypatch.setattr(FE, "stored", watched)
    df = FE.lag_columns(base.select("ts", "ymd", "product_code", "mother_code", "category", "small_c", "show_id"), base)
    assert labels == [("shows", ["lag_all_price_show"]), ("weeks", ["lag_all_price_show", "lag_scode_price", "lag_scode_count"])]
    assert df.columns[7:10] == ["lag_scode_price", "lag_scode_count", "lag_mcode_price"]
    assert df.columns[-3:] == ["lag_bigcat_count_day", "lag_all_price_show", "lag_all_price_day"]
    # rows of a later show have the mean price of the show before, rows of the first one 0
    shows = sorted((r.at, r.show_id, r.mean) for r in base.groupBy("show_id").agg(F.min("ts").alias("at"), F.avg("unit_price").alias("mean")).collect())
    prices = {name: before[2] if before else 0.0 for before, (_, name, _) in zip([None, *shows], shows)}
    got = df.collect()
    assert len(got) == base.count() and all(r.lag_all_price_show == pytest.approx(prices[r.show_id]) for r in got)


def test_tables_that_nobody_reads_again_are_gone(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    made = planning.train_features_undivided(spark, tables)
    # airings, slots, rows with shows and the stage are read by no later step, the rows with large lags are
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert left == {"weeks"}
    monkeypatch.undo()
    rows = planning._base_rows(spark, tables)[1].where("sales IS NOT NULL AND sales != 50000")
    assert made.select("ts", "product_code", "sales").exceptAll(rows.select("ts", "product_code", "sales")).count() == 0
    assert made.count() == rows.count()


def test_wide_joins_are_stored_in_slices(spark, tables, monkeypatch):
    whole = planning.train_features_undivided(spark, tables)
    seen, plain = [], DataFrameWriter.parquet

    def watched(writer, path, *args, **more):
        seen.append((path.rsplit("/", 1)[1].rsplit("-", 1)[0], writer._df.count()))
        return plain(writer, path, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    monkeypatch.setattr(K, "SLICE_ROWS", 200)
    cut = planning.train_features_undivided(spark, tables)
    n = whole.count()
    for label in ("shown", "stage", "shows", "weeks"):
        own = [rows for name, rows in seen if name == label]
        assert len(own) == 3 and sum(own) == n and max(own) < n, label
    # what is not joined by the key is stored at once
    assert [name for name, _ in seen].count("slots") == [name for name, _ in seen].count("airings") == 1
    rounded = [F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in whole.dtypes]
    assert cut.columns == whole.columns and cut.count() == n
    assert cut.select(*rounded).exceptAll(whole.select(*rounded)).count() == 0


def test_slices_hold_every_row_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "SLICE_ROWS", 10)
    rows = [(None if i % 5 == 0 else i % 7, i) for i in range(35)] + [(3, 1), (None, 0)]
    df = spark.createDataFrame(rows, "k int, v int")
    with session.sliced("k", len(rows)):
        got = session.stored(df)
        assert session.stored(df.where("false")).count() == 0
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    with session.scratch(spark) as made:
        first, second = session.stored(df), session.stored(df)
        with session.scratch(spark):
            third = session.stored(df, "third")
        session.discard(got)  # not made inside, so it stays
        made.free(second)
    assert got.count() == second.count() == len(rows)
    for gone in (first, third):
        assert not pathlib.Path(gone.inputFiles()[0].removeprefix("file:")).exists()


def test_written_features_are_sorted_by_day_and_level(spark, tables, tmp_path):
    made = planning._train(spark, tables, planning.CONFIG)
    FE.write_features(made, str(tmp_path / "out"))
    for file in (tmp_path / "out/features").rglob("*.parquet"):
        found = [(r.ymd, r.small_c, r.middle_c) for r in spark.read.parquet(str(file)).select("ymd", "small_c", "middle_c").coalesce(1).collect()]
        assert found == sorted(found)
    back = FE.read_features(spark, str(tmp_path / "out")).select("ts", "product_code", "show_id")
    assert back.exceptAll(made.frame.select("ts", "product_code", "show_id")).count() == 0 and back.count() == made.frame.count()
