"""Hand-made frames: ties, empty sides, zero sizes, gaps, unknown orders, sinks and streams."""

import datetime as dt
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import scalar as S
from tidemark.operators import book, feed, pages, quality, sample, select, summary
from tidemark.sources import fixtures, tables
from tidemark.streaming import kept, keyed, live

T0 = dt.datetime(2024, 1, 1)
TRADE = "timestamp timestamp_ntz, exchange string, symbol string, price double, size double, side string, trade_id string"
CHANGE = "timestamp timestamp_ntz, event_id long, exchange string, symbol string, side string, price double, amount double"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def trades(spark, *rows):
    return spark.createDataFrame([(at(s), "KRAKEN", "BTC-USD", float(p), float(z), "buy", i) for s, p, z, i in rows], TRADE)


def test_durations():
    assert [S.duration(x) for x in ("5s", "1m", "1 HOURS", "2d")] == ["5 seconds", "1 minutes", "1 hours", "2 days"]
    for bad in ("", "5", "0s", "5 weeks", "s5"):
        with pytest.raises(ValueError):
            S.duration(bad)


def test_candles_ties_zero_sizes_and_empty(spark):
    rows = sample.candles(trades(spark, (0, 10, 0, "a"), (0, 12, 0, "b"), (4.9, 11, 0, "c"), (5, 20, 2, "d")), "5s").orderBy("ts").collect()
    assert [(r["openp"], r["closep"], r["lowp"], r["highp"], r["vwap"], r["volume_base"]) for r in rows] == [(10, 11, 10, 12, None, 0), (20, 20, 20, 20, 20, 2)]
    assert sample.candles(trades(spark), "5s").collect() == []


def test_limits_and_filters(spark):
    df = trades(spark, (3, 1, 1, "c"), (1, 2, 1, "a"), (2, 3, 1, "b"))
    assert [r["trade_id"] for r in select.last_rows(df, -2, "timestamp", "trade_id").collect()] == ["b", "c"]
    assert [r["trade_id"] for r in select.newest_first(df, "timestamp").collect()] == ["c", "b", "a"]
    assert select.by_exchanges(df, ["kraken"]).count() == 3 and select.by_exchanges(df, []).count() == 3 and select.by_exchanges(df, ["x"]).count() == 0
    assert [(r["trade_id"], r["row_number"]) for r in select.numbered(df, "timestamp").orderBy("row_number").collect()] == [("a", 1), ("b", 2), ("c", 3)]
    assert [r["trade_id"] for r in select.positions(df, 1, 5, "timestamp").collect()] == ["b", "c"]


def test_depth_arrays(spark):
    rows = [(s, p, a) for s, p, a in [("bid", 10.0, 1.0), ("bid", 11.0, 2.0), ("bid", 9.0, 3.0), ("ask", 12.0, 4.0)]]
    levels = spark.createDataFrame([("K", "B", *r) for r in rows] + [("K", "E", "ask", 1.0, 1.0)], "exchange string, symbol string, side string, price double, amount double")
    got = {r["symbol"]: (r["bids"], r["asks"]) for r in book.book_arrays(levels, 2, *book.PAIR).collect()}
    assert got == {"B": ([[11, 10], [2, 1]], [[12], [4]]), "E": ([[], []], [[1], [1]])}
    assert {r["symbol"]: r["bids"] for r in book.book_arrays(levels, None, *book.PAIR).collect()}["B"] == [[11, 10, 9], [2, 1, 3]]
    best = {r["symbol"]: (r["best_bid"], r["best_ask"]) for r in select.best_quotes(book.book_arrays(levels, 0, *book.PAIR)).collect()}
    assert best == {"B": (11, 12), "E": (None, 1)}


def test_replay_deletes_ignores_negative_and_ties(spark):
    rows = [(at(1), 1, "K", "B", "bid", 10.0, 1.0), (at(1), 2, "K", "B", "bid", 10.0, 2.0), (at(12), 3, "K", "B", "bid", 10.0, -5.0), (at(20), 4, "K", "B", "bid", 10.0, 0.0), (at(30), 5, "K", "B", "bid", 9.0, 1.0)]
    got = book.replay(spark.createDataFrame(rows, CHANGE), "10s").orderBy("ts").collect()
    assert [(r["ts"], r["price"], r["amount"]) for r in got] == [(at(10), 10, 2), (at(30), 9, 1)]


def test_orders_unknown_overfilled_and_market(spark):
    rows = [(1, "a", "match", 5, 1), (2, "a", "change", 5, 3), (3, "a", "open", 5, 10), (4, "a", "match", 5, 4), (5, "a", "match", 5, 9), (6, "a", "match", 5, 1), (7, "a", "open", 6, 2), (8, "a", "done", None, 0), (9, "b", "open", 7, 1), (10, "b", "change", 7, 8), (11, "b", "done", 7, 0)]
    events = spark.createDataFrame(rows, "sequence long, order_id string, type string, price long, size long")
    steps = book.order_transitions(events).orderBy("sequence").collect()
    assert [(r["sequence"], r["remaining"]) for r in steps] == [(3, 10), (4, 6), (5, 0), (7, 2), (8, 2), (9, 1), (10, 8), (11, 0)]
    assert sorted(r["sequence"] for r in book.rejected_matches(events).collect()) == [1, 6]
    assert [tuple(r) for r in book.levels_from_orders(book.order_transitions(events)).collect()] == [(6, 1, 2)]


def test_sequence_gaps_and_snapshots(spark):
    rows = [("B", i, s) for i, s in enumerate([1, 2, 2, 3, 6, 5, 7, 8])]
    clean = feed.in_sequence(spark.createDataFrame(rows, "symbol string, event_id long, seq long"))
    assert [r["seq"] for r in clean.orderBy("seq").collect()] == [1, 2, 3, 6, 7, 8]
    gaps = feed.gaps(clean)
    assert [tuple(r) for r in gaps.collect()] == [("B", 6, 3, 2)]
    snaps = spark.createDataFrame([("B", 7)], "symbol string, snap_seq long")
    assert sorted(r["seq"] for r in feed.usable_rows(clean, gaps, snaps).collect()) == [1, 2, 3, 7, 8]


def test_messages(spark):
    raw = spark.createDataFrame([('{"type":"match","product_id":"B-U","price":"1.5","size":"x","side":"buy","time":"2024-01-01T00:00:01.000001Z","sequence":1}',), ("broken",), ('{"type":"activate"}',), (None,)], "raw string")
    parsed = feed.parse(raw)
    assert sorted(r["route"] for r in parsed.collect()) == ["ignored", "invalid", "invalid", "trade"]
    t = feed.matches_to_trades(parsed).first()
    assert (t["price"], t["size"], t["side"], t["timestamp"]) == (1.5, None, "sell", T0 + dt.timedelta(seconds=1, microseconds=1))
    assert feed.rejects(raw).count() == 2


def test_quality(spark):
    schema = "timestamp timestamp_ntz, exchange string, symbol string, bids array<array<double>>, asks array<array<double>>"
    books = spark.createDataFrame([(T0, "K", "B", [[2.0, 1.0], [1.0, 1.0]], [[3.0], [1.0]]), (T0, "K", "B", [[1.0, 2.0], [1.0]], [[1.0]]), (T0, "K", "B", None, [[], []])], schema)
    assert tuple(quality.shape_violations(books, 1).first()) == (3, 2, 1, 2)
    assert tuple(quality.order_violations(books).first()) == (1, 0, 1)
    assert quality.schema_problems(books.drop("asks").withColumn("symbol", F.lit(1)), schemas.ORDERBOOKS) == ["missing column asks", "symbol is int, not string"]
    with pytest.raises(ValueError):
        quality.assert_schema(books.drop("bids"), schemas.ORDERBOOKS)
    stats = summary.chart_stats(trades(spark, (0, 1, 1, "a")), ["Kraken", "Nowhere"]).orderBy("exchange").collect()
    assert [tuple(r) for r in stats] == [("KRAKEN", 1, 1, 1), ("NOWHERE", 0, 1, 1)]


def test_tables_sinks_retention(spark, tmp_path):
    tables.drop_tables(spark)
    tables.create_tables(spark)
    tables.create_tables(spark)
    columns = {(r["table"], r["position"]): r["column"] for r in tables.describe(spark).collect()}
    assert columns["trades", 0] == "timestamp" and columns["orderbooks", 3] == "bids"
    tables.drop_tables(spark)
    assert tables.describe(spark).count() == 0
    path = str(tmp_path / "t")
    tables.append_trades(trades(spark, (0, 1, 1, "a"), (90_000, 2, 1, "b")), path)
    tables.append_trades(trades(spark, (7_200, 3, 1, "c")), path)
    page = tables.read_between(spark, path, schemas.TRADES, at(0), at(8_000))
    assert sorted(r["trade_id"] for r in page.collect()) == ["a", "c"]
    assert "PartitionFilters: [isnotnull(dt" in page._jdf.queryExecution().toString()
    assert [r["trade_id"] for r in tables.retain(spark.read.parquet(path), "24h").orderBy("trade_id").collect()] == ["b", "c"]
    assert tables.export(page, 1).num_rows == 1
    books = spark.createDataFrame([(at(3_600 * h), "K", "B", [[1.0], [1.0]], [[2.0], [1.0]]) for h in range(4)], "timestamp timestamp_ntz, exchange string, symbol string, bids array<array<double>>, asks array<array<double>>")
    tables.append_books(books, str(tmp_path / "b"))
    assert tables.drop_expired_hours(spark, str(tmp_path / "b"), "1h", at(3_600 * 3)) == 2
    assert [r["hour"] for r in spark.read.parquet(str(tmp_path / "b")).collect()] == [3]


def test_coerce_and_live_columns(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([("1.5", "x", 1)], "a string, b string, _rowid int")
    schema = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.LongType()), T.StructField("c", T.LongType())])
    assert tuple(select.coerce(select.public(df), schema).first()) == (1.5, None)
    view = select.live_view(trades(spark, (0, 1, 1, "a")), F.expr("timestamp_ntz'2024-01-01 00:00:02'"))
    assert view.first()["latency_seconds"] == 2


def test_symbol_reference_join_beyond_the_broadcast_bound(spark):
    df, names = trades(spark, (0, 1, 1, "a")), spark.createDataFrame([("BTC-USD", "XBT"), ("X", "Y")], "id string, standard string")
    for limit in (10, 1):
        assert feed.normalise_symbols(df, names, limit).first()["symbol"] == "XBT"


def test_streams_grow_and_equal_batch(spark, tmp_path):
    src, table, ledger = (str(tmp_path / n) for n in ("src", "table", "ledger"))
    rows = [(i, at(i), "K", "BTC-USD" if i % 3 else "ETH-USD", float(i), 1.0) for i in range(60)]
    schema = "event_id long, timestamp timestamp_ntz, exchange string, symbol string, price double, size double"
    part = lambda a, b: spark.createDataFrame(rows[a:b], schema).coalesce(1)
    kind = part(0, 1).schema
    for n, (a, b) in enumerate([(0, 25), (25, 60)], 1):
        part(a, b).write.mode("append").parquet(src)
        kept.ingest(live.live_table(spark, src, kind), table, ledger, str(tmp_path / "c1")).awaitTermination()
        log = spark.read.schema(schemas.LEDGER).parquet(ledger)
        assert log.count() == n and log.agg(F.sum("row_count")).first()[0] == b
    assert [r["row_count"] for r in live.changes_since(log, 0).collect()] == [35]
    assert live.next_size(log, 0, 25, lambda: -1) == 60 and live.next_size(log, 5, 60, lambda: -1) == 60
    assert live.next_size(log.withColumn("row_count", F.lit(None).cast("long")), 0, 25, lambda: 77) == 77
    whole = live.live_table(spark, src, kind, refreshing=False)
    q = live.run_once(live.candles(live.live_table(spark, src, kind), "5s"), str(tmp_path / "o"), str(tmp_path / "c2"))
    assert sum(p[1] for p in live.progress(q)) == 60 and live.progress(q)[-1][3] == 60
    closed = spark.read.parquet(str(tmp_path / "o")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    batch = sample.candles(whole, "5s")
    assert 0 < closed.count() < batch.count() and closed.select(*batch.columns).exceptAll(batch).count() == 0
    live.stop_all(spark)
    assert spark.streams.active == []


def test_streaming_book_state_over_many_batches(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [(at(i), i, "K", "B" if i % 2 else "E", "bid" if i % 3 else "ask", float(i % 7), [1.0, 0.0, 2.0, -1.0][i % 4]) for i in range(80)]
    rows += [(at(100 + i), 100 + i, "K", "Z", "bid", 1.0, float(i)) for i in range(3)] + [(at(99), 99, "K", "G", "bid", 1.0, 5.0), (at(200), 200, "K", "G", "bid", 1.0, 0.0)]
    df = spark.createDataFrame(rows, CHANGE)
    for part in ("event_id >= 60", "event_id < 25", "event_id between 25 and 59"):  # newest changes first
        df.where(part).coalesce(1).write.mode("append").parquet(src)
    live.run_once(live.book_state(live.live_table(spark, src, df.schema, max_files=1)), str(tmp_path / "o"), str(tmp_path / "c"), "update")
    written = spark.read.parquet(str(tmp_path / "o"))
    assert written.select("batch").distinct().count() == 3
    got = sorted(tuple(r) for r in live.standing(written).select("exchange", "symbol", "side", "price", "amount").collect())
    want = book.level_intervals(df, *book.PAIR).where("valid_to is null").select("exchange", "symbol", "side", "price", "amount")
    assert got == sorted(tuple(r) for r in want.collect()) and ("K", "Z", "bid", 1.0, 2.0) in got and not any(r[1] == "G" for r in got)


def test_streaming_sequence_over_batches(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [("B", i, s, s == 9) for i, s in enumerate([1, 2, 2, 3, 6, 5, 7, 9, 10, 12])]
    df = spark.createDataFrame(rows, "symbol string, event_id long, seq long, snapshot boolean")
    for part in ("event_id < 5", "event_id >= 5"):
        df.where(part).coalesce(1).write.mode("append").parquet(src)
    with keyed.rocksdb(spark):
        live.run_once(keyed.sequenced(live.live_table(spark, src, df.schema, max_files=1)), str(tmp_path / "o"), str(tmp_path / "c"))
    got = [r["status"] for r in spark.read.parquet(str(tmp_path / "o")).orderBy("event_id").collect()]
    assert got == ["ok", "ok", "stale", "ok", "gap", "stale", "blank", "ok", "ok", "gap"]


def test_running_values_across_chunks(spark):
    from tidemark.operators import running

    rows = [(k, i, v) for k in ("a", None) for i, v in enumerate([3, None, 1, 5, 2, 9, 4])]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    for chunk in (1, 2, 100):
        of = lambda d, c: {(r["k"], r["i"]): r[c] for r in d.collect()}  # noqa: B023, E731
        tops = of(running.running_max(df, ("k",), ("i",), {"m": F.col("v")}, chunk=chunk), "m")
        sums = of(running.running_sum(df, ("k",), ("i",), F.col("v"), "s", chunk), "s")
        before = of(running.previous(df, ("k",), ("i",), "v", "p", chunk), "p")
        for k in ("a", None):
            assert [tops[k, i] for i in range(7)] == [None, 3, 3, 3, 5, 5, 9]
            assert [sums[k, i] for i in range(7)] == [3, 3, 4, 9, 11, 20, 24]
            assert [before[k, i] for i in range(7)] == [None, 3, None, 1, 5, 2, 9]
        n = of(running.numbered(df, ("k",), ("i",), "n", chunk), "n")
        assert all(v == i + 1 for (_, i), v in n.items())
        assert sorted(r["n"] for r in running.numbered(df, (), ("i",), "n", chunk).collect()) == list(range(1, 15))
    with pytest.raises(ValueError):
        running.position(df, "k")


def test_order_type_of_the_latest_earlier_message(spark):
    t = spark.createDataFrame([(1, "x"), (5, "x"), (9, "x"), (9, None), (7, "y")], "sequence long, taker_order_id string")
    said = [(2, "x", "limit"), (5, "x", "stop"), (6, "x", "stop"), (8, "x", None), (7, "y", "market"), (3, None, "limit")]
    parsed = spark.createDataFrame([(s, o, k, "order", "received") for s, o, k in said], "sequence long, order_id string, order_type string, route string, type string")
    got = sorted(((r["sequence"], r["taker_order_id"], r["order_type"]) for r in feed.enrich_order_type(t, parsed).collect()), key=str)
    assert got == sorted([(1, "x", None), (5, "x", "limit"), (9, "x", None), (9, None, None), (7, "y", None)], key=str)


def test_entry_works_without_the_training_data_part(tmp_path):
    repo = Path(__file__).resolve().parents[1]
    shutil.copytree(repo / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), any(n.startswith('op') for n in q))"], cwd=tmp_path, capture_output=True, text=True)
    assert said.stdout.split()[-1] == "False" and int(said.stdout.split()[-3]) > 80, said.stderr


def test_series_json_in_chunks(spark):
    from tidemark.operators import summary

    df = spark.createDataFrame([("K", at(60 * i), float(i)) for i in range(30)], "exchange string, timestamp timestamp_ntz, price double")
    rows = summary.series_json(summary.series_chunks(df, ["K"], 600)).orderBy("chunk").collect()
    assert len(rows) >= 3 and sum(r["json"].count("time") for r in rows) == 30


# Keyed state and kept tables ---------------------------------------------------------------------

def arriving(spark, path, df, *parts):
    for part in parts:
        df.where(part).coalesce(1).write.mode("append").parquet(path)
    return live.live_table(spark, path, df.schema, max_files=1)


def test_stream_order_types_come_out_after_the_watermark(spark, tmp_path):
    said = [(1, "x", 2, "limit"), (3, "x", 5, "stop"), (90, "y", 40, "late"), (60, "x", 30, "market")]
    asks = [(0, "x", 1, "a"), (2, "x", 4, "b"), (5, "x", 5, "c"), (6, "x", 6, "d"), (7, None, 7, "e"), (8, "z", 8, "f"), (70, "x", 31, "g"), (100, "x", 50, "h")]
    rows = [(at(s), o, n, None, k, True) for s, o, n, k in said] + [(at(s), o, n, t, None, False) for s, o, n, t in asks]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, id string, sequence long, trade_id string, order_type string, received boolean")
    stream = arriving(spark, str(tmp_path / "s"), df, "sequence in (4, 6, 31, 1)", "sequence in (2, 5, 7, 8)", "sequence in (30, 40)", "sequence = 50")
    trades_ = stream.where("not received").withColumnRenamed("id", "taker_order_id")
    heard = stream.where("received").withColumnRenamed("id", "order_id")
    with keyed.rocksdb(spark):
        q = live.run_once(keyed.order_types(trades_, heard, "120s", "1d"), str(tmp_path / "none"), str(tmp_path / "c0"))
        assert spark.read.parquet(str(tmp_path / "none")).count() == 0  # nothing is past the watermark
        q = live.run_once(keyed.order_types(trades_, heard, "80s", "1d", 2), str(tmp_path / "o"), str(tmp_path / "c"))
    got = {r["trade_id"]: r["order_type"] for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got == {"a": None, "b": "limit", "c": "limit", "d": "stop", "e": None, "f": None}
    assert spark.conf.get(keyed.PROVIDER) != keyed.ROCKSDB and q.exception() is None


def test_stream_orders_equal_batch_and_leave_the_state(spark, tmp_path):
    rows = [(1, "a", "match", 5, 1), (2, "a", "change", 5, 3), (3, "a", "open", 5, 10), (4, "a", "match", 5, 4), (5, "a", "match", 5, 9), (6, "a", "match", 5, 1), (7, "a", "open", 6, 2), (8, "a", "done", None, 0), (9, "b", "open", 7, 1), (10, "b", "change", 7, 8), (11, "b", "done", 7, 0), (12, "c", "open", 9, 4), (13, "c", "open", 8, 3), (14, "c", "match", 8, 1)]
    df = spark.createDataFrame(rows, "sequence long, order_id string, type string, price long, size long")
    stream = arriving(spark, str(tmp_path / "s"), df, "sequence < 5", "sequence between 5 and 9", "sequence > 9")  # orders are split over batches
    with keyed.rocksdb(spark):
        q = live.run_once(keyed.order_transitions(stream, buckets=2), str(tmp_path / "o"), str(tmp_path / "c"))
    columns = ["order_id", "sequence", "type", "price", "remaining"]
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "o")).select(*columns).collect())
    assert got == sorted(tuple(r) for r in book.order_transitions(df).select(*columns).collect())
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # only order c lives


def test_stream_levels_shrink_and_reset(spark, tmp_path):
    rows = [(at(i), i, "K", "B", "bid", float(i), 1.0) for i in range(20)] + [(at(30 + i), 30 + i, "K", "B", "bid", float(i), 0.0) for i in range(15)]
    rows += [(at(2), 100, "K", "B", "bid", 16.0, 0.0), (at(31), 60, "K", "E", "ask", 5.0, 2.0), (at(33), 61, "K", "E", "ask", 6.0, -1.0), (at(200), 200, "K", "E", "ask", 7.0, 2.0), (at(400), 400, "K", "F", "bid", 1.0, 1.0), (at(401), 401, "K", "F", "bid", 2.0, 1.0)]
    df = spark.createDataFrame(rows, CHANGE)
    parts = ("event_id between 30 and 99", "event_id < 30 or event_id = 100", "event_id = 200", "event_id = 400", "event_id = 401")  # deletions come before what they delete
    with keyed.rocksdb(spark):
        q = kept.keep_levels(keyed.book_levels(arriving(spark, str(tmp_path / "s"), df, *parts), delay="60s"), str(tmp_path / "b"), str(tmp_path / "c"))
        got = sorted((r["symbol"], r["price"], r["amount"]) for r in kept.Versions(spark, str(tmp_path / "b")).read().collect())
        assert got == [("B", float(p), 1.0) for p in range(15, 20)] + [("E", 5.0, 2.0), ("E", 7.0, 2.0), ("F", 1.0, 1.0), ("F", 2.0, 1.0)]
        assert len(kept.Versions(spark, str(tmp_path / "b")).finished()) <= 2
        totals = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
        assert max(totals) >= 20 and totals[-1] <= 9 + 1  # 15 deleted levels are forgotten
        snap = F.col("event_id") == 40
        stream = arriving(spark, str(tmp_path / "s2"), df, "event_id < 30", "event_id between 30 and 50", "event_id between 3 and 4")
        kept.keep_levels(keyed.book_levels(stream.where(~snap), stream.where(snap).withColumn("amount", F.lit(9.0)), delay="600s"), str(tmp_path / "b2"), str(tmp_path / "c2"))
    assert [(r["price"], r["amount"]) for r in kept.Versions(spark, str(tmp_path / "b2")).read().collect()] == [(10.0, 9.0)]


def test_kept_rows_and_repeated_batches(spark, tmp_path):
    rows = [(at(i), i) for i in range(50)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, event_id long")
    stream = arriving(spark, str(tmp_path / "s"), df, "event_id >= 40", "event_id < 20", "event_id between 20 and 39")
    kept.keep_last(stream, 15, str(tmp_path / "last"), str(tmp_path / "c"))
    table = kept.Versions(spark, str(tmp_path / "last"))
    assert sorted(r["event_id"] for r in table.read().collect()) == list(range(35, 50)) and table.finished() == [1, 2]
    (tmp_path / "last" / f"v={3:012d}").mkdir()  # a version that was not finished
    assert table.finished() == [1, 2] and table.read(2).count() == 15


def test_exact_candles_rewrite_only_what_late_rows_touch(spark, tmp_path):
    df = trades(spark, *[(20 * i, 10 + i % 7, 1, str(i)) for i in range(200)])
    first, late = "size > 0 and (timestamp < timestamp_ntz'2024-01-01 00:05:00' or timestamp > timestamp_ntz'2024-01-01 00:06:00')", "timestamp between timestamp_ntz'2024-01-01 00:05:00' and timestamp_ntz'2024-01-01 00:06:00'"
    out = str(tmp_path / "candles")
    kept.keep_candles(arriving(spark, str(tmp_path / "s"), df, first), "5s", str(tmp_path / "r"), out, str(tmp_path / "c"), "10m")
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "candles").rglob("*.parquet")}
    kept.keep_candles(arriving(spark, str(tmp_path / "s"), df, late), "5s", str(tmp_path / "r"), out, str(tmp_path / "c"), "10m")
    after = {p for p in (tmp_path / "candles").rglob("*.parquet")}
    gone = {p.parent.name for p in before if p not in after}
    assert len(gone) == 1 and len({p.parent.name for p in after}) == 7
    batch = sample.candles(df, "5s")
    got = spark.read.parquet(out).drop("span").select(*batch.columns)
    assert got.count() == batch.count() and got.exceptAll(batch).count() == 0
    with pytest.raises(ValueError):
        kept.keep_candles(df, "7s", "", "", "", "10m")


def test_ledger_is_observed_not_reread(spark, tmp_path):
    df = trades(spark, (1, 1, 1, "a"), (5, 2, 1, "b"))
    kept.ingest(arriving(spark, str(tmp_path / "s"), df, "true"), str(tmp_path / "t"), str(tmp_path / "l"), str(tmp_path / "c")).awaitTermination()
    row = spark.read.schema(schemas.LEDGER).parquet(str(tmp_path / "l")).first()
    assert (row["txn_id"], row["row_count"], row["min_ts"], row["max_ts"]) == (0, 2, at(1), at(5))


def test_every_update_reaches_the_progress_table(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.range(24).withColumnRenamed("id", "n")
    stream = arriving(spark, path, df, *[f"n % 12 = {k}" for k in range(12)])
    was = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    listener = kept.ProgressTable(spark, str(tmp_path / "p"), "counted")
    spark.streams.addListener(listener)
    try:
        q = stream.writeStream.queryName("counted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("noop").start()
        q.awaitTermination()
        listener.finish()
    finally:
        spark.streams.removeListener(listener)
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", was)
    assert len(q.recentProgress) <= 3
    assert [tuple(r) for r in listener.read().orderBy("batch_id").collect()] == [(i, 2, 2 * i, 2 * i + 2) for i in range(12)]
    assert kept.ProgressTable(spark, str(tmp_path / "p"), "counted").size == 24


def test_stored_pages_read_only_their_files(spark, tmp_path):
    rows = [(at(0 if i < 600 else i), i, float(i)) for i in range(1000)]  # more than half share one time
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, event_id long, price double").repartition(5)
    path = str(tmp_path / "p")
    pages.store(df, path, files=10)
    assert pages.index(spark, path).count() == 10 and pages.index(spark, path).agg(F.max("rows")).first()[0] < 250
    page = pages.page(spark, path, 430, 150)
    assert [(r["row_number"], r["event_id"]) for r in page.orderBy("row_number").collect()] == [(i + 1, i) for i in range(430, 580)]
    assert len(page.inputFiles()) <= 4
    assert pages.page(spark, path, 995, 50).count() == 5 and pages.page(spark, path, 2000, 5).count() == 0
    assert sorted((r["row_number"], r["event_id"]) for r in pages.numbered(spark, path).collect()) == [(i + 1, i) for i in range(1000)]
    some = pages.between(spark, path, at(700), at(709))
    assert some.count() == 10 and len(some.inputFiles()) <= 2
    pages.store(df.limit(0), str(tmp_path / "none"))
    assert pages.page(spark, str(tmp_path / "none"), 0, 5).count() == 0


@pytest.mark.parametrize("stop", ["prepare", "_rename", "finish"])
def test_retention_completes_an_interrupted_run(spark, tmp_path, monkeypatch, stop):
    books = spark.createDataFrame([(at(60 * i), "K", "B", [[1.0], [1.0]], [[2.0], [1.0]]) for i in range(180)], "timestamp timestamp_ntz, exchange string, symbol string, bids array<array<double>>, asks array<array<double>>")
    path = str(tmp_path / "b")
    tables.append_books(books, path)

    class Stopped(Exception):
        pass

    real = tables._Cut.finish
    if stop == "prepare":  # kept rows are written, nothing is marked
        def prepare(self, cut):
            spark.range(3).write.parquet(f"{self.aside}/kept")
            raise Stopped
        monkeypatch.setattr(tables._Cut, "prepare", prepare)
    else:
        def finish(self):
            if stop == "_rename":  # the old files are gone, the new ones have not moved
                for f in self.fs.listStatus(self.hour):
                    self.fs.delete(f.getPath(), False)
            raise Stopped
        monkeypatch.setattr(tables._Cut, "finish", finish)
    with pytest.raises(Stopped):
        tables.drop_expired_hours(spark, path, "90m", at(60 * 180))
    assert spark.read.parquet(path).groupBy("timestamp").count().where("count > 1").count() == 0
    monkeypatch.undo()
    assert tables._Cut.finish is real
    tables.drop_expired_hours(spark, path, "90m", at(60 * 180))
    got = sorted(r["timestamp"] for r in spark.read.parquet(path).collect())
    assert got == [at(60 * i) for i in range(91, 180)] and not list((tmp_path / "b").glob("_cut-*"))
    tables.drop_expired_hours(spark, path, "90m", at(60 * 180))
    assert spark.read.parquet(path).count() == 89


def test_running_values_leave_other_columns_alone(spark):
    from tidemark.operators import running

    df = spark.createDataFrame([(i, i % 3, "u", "v") for i in range(6)], "i long, v long, `__chunk` string, `___c` string")
    for out in (running.numbered(df, (), ("i",), "n", 2), running.running_max(df, (), ("i",), {"m": F.col("v")}, chunk=2), running.running_sum(df, (), ("i",), F.col("v"), "s", 2), running.previous(df, (), ("i",), "v", "p", 2)):
        assert {(r["__chunk"], r["___c"]) for r in out.collect()} == {("u", "v")}


def test_row_numbers_with_outliers_and_one_common_time(spark):
    rows = [(at(-9e8), 0)] + [(at(5), i) for i in range(1, 700)] + [(at(i), i) for i in range(700, 1000)] + [(None, 2000)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, event_id long").withColumn("position", F.lit("x")).repartition(4)
    got = sorted((r["row_number"], r["event_id"], r["position"]) for r in select.numbered(df).collect())
    assert got == [(1, 2000, "x")] + [(i + 2, i, "x") for i in range(1000)]
    plan = select.numbered(df)
    assert plan.columns == ["timestamp", "event_id", "position", "row_number"]
    assert select.numbered(df.limit(0)).collect() == []
    same = df.withColumn("timestamp", F.lit(T0).cast("timestamp_ntz"))
    assert sorted(r["row_number"] for r in select.numbered(same).collect()) == list(range(1, 1002))


def test_chosen_fields_are_parsed_alone(spark):
    raw = spark.createDataFrame([('{"type":"match","product_id":"B-U","price":"1.5","size":"2","side":"buy","time":"2024-01-01T00:00:01.000001Z","sequence":1}',)], "raw string")
    whole, part = feed.parse(raw), feed.parse(raw, fields=feed.MATCH)
    assert "bids" not in part.columns and feed.matches_to_trades(whole).collect() == feed.matches_to_trades(part).collect()


def test_waiting_trades_are_stored_packed(spark, tmp_path):
    rows = [(at(i), f"o{i % 3}" if i % 7 else None, i, None if i % 5 == 0 else f"t{i}", f"k{i}" if i % 5 == 0 else None) for i in range(400)]
    df = spark.createDataFrame([*rows, (None, "o1", 9, "timeless", None)], "timestamp timestamp_ntz, id string, sequence long, trade_id string, order_type string")
    stream = arriving(spark, str(tmp_path / "s"), df, "sequence < 200", "sequence between 200 and 398", "sequence = 399")
    trades_ = stream.where("trade_id is not null").withColumnRenamed("id", "taker_order_id")
    heard = stream.where("trade_id is null").withColumnRenamed("id", "order_id")
    with keyed.rocksdb(spark):
        q = live.run_once(keyed.order_types(trades_, heard, "50s", "1d", 1), str(tmp_path / "o"), str(tmp_path / "c"))
    got = {r["trade_id"]: r["order_type"] for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    said, want = {}, {}
    for _, order, n, trade, kind in rows:
        if trade is None:
            said[order] = kind
        elif n <= 399 - 50:
            want[trade] = said.get(order) if order else None
    assert got == want
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) < 30  # one value a batch, not one a trade


def test_books_dealt_by_time_make_few_files(spark, tmp_path):
    rows = [(at(60 * i), "K", "B", 100.0 + i, i) for i in range(60 * 30)]  # a row a minute for 30 hours
    moments = spark.createDataFrame(rows, "timestamp timestamp_ntz, exchange string, symbol string, price double, event_id long")
    whole, dealt = str(tmp_path / "whole"), str(tmp_path / "dealt")
    tables.append_books(fixtures.books_from(moments), whole)
    tables.append_books(fixtures.books_from(tables.by_time(moments, len(rows), "event_id", size=200)), dealt, dealt=True)
    got, want = (spark.read.parquet(p).select("timestamp", "bids", "asks", "dt", "hour") for p in (dealt, whole))
    assert got.count() == len(rows) and got.exceptAll(want).count() == 0
    assert len([*(tmp_path / "dealt").rglob("*.parquet")]) <= 30 + 9  # hours and spans
    plan = fixtures.books_from(tables.by_time(moments, len(rows)))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("bids") < plan.index("Exchange") and "bids" not in plan[plan.index("Exchange"):]  # made after the rows are dealt
    assert tables.drop_expired_hours(spark, dealt, "3h", at(60 * 60 * 29)) == 26
    assert sorted(r["timestamp"] for r in spark.read.parquet(dealt).collect()) == [at(60 * i) for i in range(60 * 26 + 1, 60 * 30)]


def test_book_changes_are_reduced_before_the_state(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    row = lambda i, price, amount, reset=False: {"exchange": "K", "symbol": None, "side": "bid", "bucket": 0, "price": price, "reset": reset, "ignored": not reset and not (amount or -1) >= 0, "micros": i, "event_id": i, "amount": amount}
    rows = [row(i, float(i % 10), 1.0 + i) for i in range(1000)] + [row(2000, 3.0, None), row(1500, 0.0, 0.0, True)]
    monkeypatch.setattr(keyed, "CHUNK", 50)
    told = [r for b in keyed._newest(iter(pa.RecordBatch.from_pylist(rows[k:k + 30], keyed.CHANGES) for k in reversed(range(0, 1002, 30)))) for r in b.to_pylist()]
    assert sorted((r["price"], r["micros"], r["reset"]) for r in told) == sorted([(float(p), 990 + p, False) for p in range(10)] + [(3.0, 2000, False), (0.0, 1500, True)])
    assert [*keyed._newest(iter(()))] == []
    changes = [(at(i), i, "K", "B", "bid", float(i % 3), 1.0 + i) for i in range(60)]
    changes += [(at(100), 100, "K", "B", "bid", 0.0, -1.0), (at(101), 101, "K", "B", "bid", 1.0, float("nan")), (at(102), 102, "K", "B", "bid", 2.0, None)]
    df = spark.createDataFrame(changes, CHANGE)
    with keyed.rocksdb(spark):
        levels = keyed.book_levels(arriving(spark, str(tmp_path / "s"), df, "event_id < 40", "event_id >= 40"), delay="60s")
        assert "MapInArrow" in levels._jdf.queryExecution().analyzed().toString()
        kept.keep_levels(levels, str(tmp_path / "b"), str(tmp_path / "c"))
    assert sorted((r["price"], r["amount"]) for r in kept.Versions(spark, str(tmp_path / "b")).read().collect()) == [(0.0, 58.0), (1.0, 59.0), (2.0, 60.0)]
