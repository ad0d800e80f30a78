"""Every reference operator as a query over the driver tables, with independent DuckDB SQL."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import scalar as S
from tidemark.operators import book, feed, pages, quality, running, sample, select, summary
from tidemark.sources import fixtures as X
from tidemark.sources import tables
from tidemark.streaming import kept, keyed, live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TRADE_COLUMNS = ("timestamp", "exchange", "symbol", "price", "size", "side")


def _query(name: str, ctes: str | None = None, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"WITH {ctes} {sql}" if ctes else sql
        return f

    return add


def _now():
    return F.expr("timestamp_ntz'2024-02-01'")


# Scans and live views ---------------------------------------------------------

@_query("scan_sql", X.TRADES_SQL, "SELECT exchange, symbol, count(*) AS n FROM trades WHERE price > 50 GROUP BY 1, 2")
def _(spark, d):
    return tables.run_query(spark, "SELECT exchange, symbol, count(*) AS n FROM tm_trades WHERE price > 50 GROUP BY 1, 2", tm_trades=X.trades(spark, d))


@_query("live_trades_view", X.TRADES_SQL, "SELECT timestamp, trade_id, price, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(timestamp)) / 1e6 AS latency_seconds FROM trades ORDER BY timestamp DESC LIMIT 1000")
def _(spark, d):
    view = _ran(spark, "live_trades", select.live_view(_growing(spark, d), _now()), "append")
    return select.newest_first(view).limit(1000).select("timestamp", "trade_id", "price", "latency_seconds")


@_query("live_books_view", X.TRADES_SQL, "SELECT timestamp, event_id, exchange, symbol, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(timestamp)) / 1e6 AS latency_seconds FROM trades")
def _(spark, d):
    view = _ran(spark, "live_books", select.live_view(X.books_from(_growing(spark, d)), _now()), "append")
    return view.select("timestamp", "event_id", "exchange", "symbol", "latency_seconds")


@_query("static_view", X.TRADES_SQL, "SELECT timestamp, trade_id, price FROM trades")
def _(spark, d):
    return live.live_table(spark, f"{d}/events.parquet", schemas.EVENTS, refreshing=False).transform(X.trades_from).select("timestamp", "trade_id", "price")


_ROUTES = "CASE WHEN event_id % 20 < 10 THEN 'trade' WHEN event_id % 20 < 12 THEN 'ticker' WHEN event_id % 20 < 15 THEN 'book' WHEN event_id % 20 < 19 THEN 'order' WHEN event_id % 40 = 19 THEN 'ignored' ELSE 'invalid' END"


@_query("message_routes", X.TRADES_SQL, f"SELECT {_ROUTES} AS route, count(*) AS n FROM trades GROUP BY 1")
def _(spark, d):
    return feed.parse(X.messages(spark, d)).groupBy("route").agg(F.count("*").alias("n"))


@_query("message_rejects", X.TRADES_SQL, "SELECT event_id AS receipt FROM trades WHERE event_id % 40 = 39")
def _(spark, d):
    return feed.rejects(X.messages(spark, d)).select("receipt")


@_query("retention_1h", X.TRADES_SQL, "SELECT timestamp, trade_id FROM trades WHERE timestamp > (SELECT max(timestamp) FROM trades) - INTERVAL 1 HOUR")
def _(spark, d):
    return tables.retain(X.trades(spark, d), "1h").select("timestamp", "trade_id")


@_query("retention_10m", X.TRADES_SQL, "SELECT timestamp, trade_id FROM trades WHERE timestamp > (SELECT max(timestamp) FROM trades) - INTERVAL 10 MINUTE")
def _(spark, d):
    return tables.retain(X.trades(spark, d), "10m").select("timestamp", "trade_id")


@_query("books_after_retention", X.TRADES_SQL, """SELECT timestamp, symbol, price AS mid FROM (SELECT date_trunc('microsecond', ts) AS timestamp, symbol, price FROM trades JOIN (SELECT event_id AS id, ts FROM events) ON id = event_id)
  WHERE timestamp > (SELECT max(ts) FROM events) - INTERVAL 36 HOUR""")
def _(spark, d):
    at = X.events(spark, d).select(F.col("event_id"), F.col("ts").alias("timestamp"))
    path = _scratch(spark, "books")
    newest, n = at.agg(F.max("timestamp"), F.count("*")).first()
    moments = X.trades(spark, d).drop("timestamp").join(at, "event_id")
    tables.append_books(X.books_from(tables.by_time(moments, n, "event_id")), path, dealt=True)
    tables.drop_expired_hours(spark, path, "36h", newest)
    kept = select.best_quotes(spark.read.parquet(path))
    return kept.select("timestamp", "symbol", F.round((F.col("best_bid") + F.col("best_ask")) / 2, 6).alias("mid"))


@_query("stored_tables", X.TRADES_SQL, """SELECT 'trades' AS table_name, 8::BIGINT AS columns, count(*) AS rows FROM trades
  UNION ALL SELECT 'orderbooks', 7, 0""")
def _(spark, d):
    database = f"tm_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{_scratch(spark, database)}'")
    try:
        tables.create_tables(spark, database)
        tables.with_partitions(X.trades(spark, d).select(*schemas.TRADES.fieldNames())).write.mode("append").insertInto(f"{database}.trades")
        columns = tables.describe(spark, database).groupBy(F.col("table").alias("table_name")).agg(F.count("*").alias("columns"))
        counts = quality.table_counts({t: spark.table(f"{database}.{t}") for t in ("trades", "orderbooks")})
        out = spark.createDataFrame(columns.join(counts, "table_name").collect(), "table_name string, columns long, rows long")  # two rows
    finally:
        tables.drop_tables(spark, database)
        spark.sql(f"DROP DATABASE {database}")
    return out


@_query("any_rows", X.TRADES_SQL, "SELECT count(*) AS rows, count(*) FILTER (price IS NOT NULL) AS priced FROM (SELECT * FROM trades LIMIT 100)")
def _(spark, d):
    return X.trades(spark, d).limit(100).agg(F.count("*").alias("rows"), F.count("price").alias("priced"))


# Projections and filters --------------------------------------------------------

@_query("trade_columns", X.TRADES_SQL, "SELECT timestamp, exchange, symbol, price, size, side FROM trades")
def _(spark, d):
    return X.trades(spark, d).select(*TRADE_COLUMNS)


@_query("symbol_filter", X.TRADES_SQL, "SELECT timestamp, trade_id, price FROM trades WHERE symbol = 'BTC-USD'")
def _(spark, d):
    return select.by_symbol(X.trades(spark, d), "BTC-USD").select("timestamp", "trade_id", "price")


@_query("exchange_filter", X.TRADES_SQL, "SELECT trade_id, exchange FROM trades WHERE exchange IN ('COINBASE', 'KRAKEN')")
def _(spark, d):
    return select.by_exchanges(X.trades(spark, d), ["Coinbase", "kraken"]).select("trade_id", "exchange")


@_query("exchange_filter_empty", X.TRADES_SQL, "SELECT trade_id, exchange FROM trades")
def _(spark, d):
    return select.by_exchanges(X.trades(spark, d), []).select("trade_id", "exchange")


@_query("filter_chain_tail", X.TRADES_SQL, "SELECT timestamp, trade_id, exchange, price FROM trades WHERE symbol = 'ETH-USD' AND exchange IN ('BITSTAMP', 'KRAKEN') ORDER BY timestamp DESC, event_id DESC LIMIT 500")
def _(spark, d):
    return select.last_rows(select.by_exchanges(select.by_symbol(X.trades(spark, d), "ETH-USD"), ["BITSTAMP", "KRAKEN"]), 500).select("timestamp", "trade_id", "exchange", "price")


@_query("where_count", X.TRADES_SQL, "SELECT count(*) AS rows FROM trades WHERE symbol = 'BTC-USD' AND price > 20")
def _(spark, d):
    return summary.row_count(X.trades(spark, d).where("symbol = 'BTC-USD' AND price > 20"))


@_query("renamed_columns", X.TRADES_SQL, "SELECT timestamp AS ts, price AS px, size AS qty FROM trades")
def _(spark, d):
    return X.trades(spark, d).select(F.col("timestamp").alias("ts"), F.col("price").alias("px"), F.col("size").alias("qty"))


_LEVELS = "SELECT event_id, cast(i AS INT) AS level, bid, ask, volume FROM levels"


@_query("book_columns", X.BOOKS_SQL, _LEVELS)
def _(spark, d):
    cols = select.book_columns(X.orderbooks(spark, d))
    rows = cols.select("event_id", F.posexplode(F.arrays_zip("bid_prices", "ask_prices", "bid_sizes")).alias("p", "z"))
    return rows.select("event_id", (F.col("p") + 1).alias("level"), F.col("z.bid_prices").alias("bid"), F.col("z.ask_prices").alias("ask"), F.col("z.bid_sizes").alias("volume"))


@_query("best_quotes", X.BOOKS_SQL, "SELECT event_id, bid AS best_bid, volume AS best_bid_size, ask AS best_ask, volume AS best_ask_size FROM levels WHERE i = 1")
def _(spark, d):
    return select.best_quotes(X.orderbooks(spark, d)).drop("timestamp", "exchange", "symbol")


@_query("coerced_rows", X.TRADES_SQL, "SELECT trade_id, cast(price AS DOUBLE) AS price, cast(size AS VARCHAR)::DOUBLE AS size FROM trades")
def _(spark, d):
    from pyspark.sql import types as T

    loose = X.trades(spark, d).select("trade_id", F.col("price").cast("string").alias("price"), F.col("size").cast("string").alias("size"), F.lit(1).alias("_rowid"))
    return select.coerce(select.public(loose), T.StructType.fromDDL("trade_id string, price double, size double"))


# Ordering, limits, positions ------------------------------------------------------

_LAST = "SELECT timestamp, trade_id, symbol, price FROM trades ORDER BY timestamp DESC, event_id DESC LIMIT 1000"


@_query("last_trades", X.TRADES_SQL, _LAST)
def _(spark, d):
    return select.last_rows(X.trades(spark, d), -1000).select("timestamp", "trade_id", "symbol", "price")


@_query("last_then_filter", X.TRADES_SQL, f"SELECT * FROM ({_LAST}) WHERE symbol = 'SOL-USD'")
def _(spark, d):
    return select.by_symbol(select.last_rows(X.trades(spark, d), 1000), "SOL-USD").select("timestamp", "trade_id", "symbol", "price")


@_query("last_books", X.BOOKS_SQL, "SELECT timestamp, event_id, bid AS best_bid, ask AS best_ask FROM levels WHERE i = 1 ORDER BY timestamp DESC, event_id DESC LIMIT 10")
def _(spark, d):
    return select.best_quotes(select.last_rows(X.orderbooks(spark, d), 10)).select("timestamp", "event_id", "best_bid", "best_ask")


@_query("newest_first", X.TRADES_SQL, "SELECT timestamp, trade_id FROM trades")
def _(spark, d):
    return select.newest_first(X.trades(spark, d)).select("timestamp", "trade_id")


@_query("top_recent", X.TRADES_SQL, "SELECT timestamp, trade_id, price FROM trades ORDER BY timestamp DESC, event_id DESC LIMIT 5")
def _(spark, d):
    return select.newest_first(X.trades(spark, d)).limit(5).select("timestamp", "trade_id", "price")


@_query("positional_slice", X.TRADES_SQL, "SELECT row_number, price FROM (SELECT price, row_number() OVER (ORDER BY timestamp, event_id) AS row_number FROM trades) WHERE row_number BETWEEN 101 AND 600")
def _(spark, d):
    return select.numbered(X.trades(spark, d)).where("row_number between 101 and 600").select("row_number", "price")


@_query("positional_page", X.TRADES_SQL, "SELECT timestamp, price FROM trades ORDER BY timestamp, event_id LIMIT 200 OFFSET 50")
def _(spark, d):
    return select.positions(X.trades(spark, d), 50, 200).select("timestamp", "price")


@_query("stored_page", X.TRADES_SQL, "SELECT row_number, timestamp, price FROM (SELECT *, row_number() OVER (ORDER BY timestamp, event_id) AS row_number, count(*) OVER () AS n FROM trades) WHERE row_number BETWEEN n // 2 + 1 AND n // 2 + 200")
def _(spark, d):
    path = _scratch(spark, "pages")
    pages.store(X.trades(spark, d), path)
    half = pages.index(spark, path).agg(F.sum("rows")).first()[0] // 2
    return pages.page(spark, path, half, 200).select("row_number", "timestamp", "price")


@_query("stored_numbers", X.TRADES_SQL, "SELECT trade_id, row_number() OVER (ORDER BY timestamp, event_id) AS row_number FROM trades")
def _(spark, d):
    path = _scratch(spark, "numbers")
    pages.store(X.trades(spark, d), path)
    return pages.numbered(spark, path).select("trade_id", "row_number")


@_query("row_numbers", X.TRADES_SQL, "SELECT trade_id, row_number() OVER (ORDER BY timestamp, event_id) AS row_number FROM trades")
def _(spark, d):
    return select.numbered(X.trades(spark, d)).select("trade_id", "row_number")


# Aggregation and sampling -----------------------------------------------------------

def _candles_sql(every: str, where: str = "") -> str:
    return f"""SELECT time_bucket(INTERVAL '{every}', timestamp) AS ts, symbol, arg_min(price, (timestamp, event_id)) AS openp, min(price) AS lowp, max(price) AS highp,
      arg_max(price, (timestamp, event_id)) AS closep, round(sum(floor(price * size * 1e6 + 0.5)::BIGINT) / nullif(sum(floor(size * 1e6 + 0.5)::BIGINT), 0), 4) AS vwap,
      sum(floor(size * 1e6 + 0.5)::BIGINT) / 1e6 AS volume_base, sum(floor(price * size * 1e6 + 0.5)::BIGINT) / 1e6 AS volume_quote FROM trades {where} GROUP BY 1, 2"""


@_query("candles_5s", X.TRADES_SQL, _candles_sql("5 seconds"))
def _(spark, d):
    return sample.candles(X.trades(spark, d), "5s")


@_query("candles_1m_symbol", X.TRADES_SQL, _candles_sql("1 minute", "WHERE symbol = 'BTC-USD'"))
def _(spark, d):
    return select.by_symbol(sample.candles(X.trades(spark, d), "1m"), "BTC-USD")


@_query("sampled_books_1s", X.BOOKS_SQL, """SELECT time_bucket(INTERVAL '1 second', timestamp) AS timestamp, exchange, symbol, cast(i AS INT) AS level,
  arg_max(bid, (timestamp, event_id)) AS bid, arg_max(ask, (timestamp, event_id)) AS ask, arg_max(volume, (timestamp, event_id)) AS volume FROM levels GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    cols = select.book_columns(sample.sample_books(X.orderbooks(spark, d), "1s"))
    rows = cols.select("timestamp", "exchange", "symbol", F.posexplode(F.arrays_zip("bid_prices", "ask_prices", "bid_sizes")).alias("p", "z"))
    return rows.select("timestamp", "exchange", "symbol", (F.col("p") + 1).alias("level"), F.col("z.bid_prices").alias("bid"), F.col("z.ask_prices").alias("ask"), F.col("z.bid_sizes").alias("volume"))


def _summary_sql(keys: str, where: str = "", source: str = "trades") -> str:
    return f"SELECT {keys}, count(*) AS trades, round(sum(floor(price * 1e6 + 0.5)::BIGINT) / count(price) / 1e6, 4) AS avg_price, sum(floor(size * 1e6 + 0.5)::BIGINT) / 1e6 AS total_size, min(price) AS min_price, max(price) AS max_price FROM {source} {where} GROUP BY {keys}"


@_query("trade_summary", X.TRADES_SQL, _summary_sql("exchange, symbol"))
def _(spark, d):
    return summary.trade_summary(X.trades(spark, d), "exchange", "symbol")


@_query("window_summary", X.TRADES_SQL, _summary_sql("exchange", source="(SELECT * FROM trades WHERE symbol = 'ETH-USD' AND exchange IN ('BITSTAMP', 'KRAKEN') ORDER BY timestamp DESC, event_id DESC LIMIT 1000)"))
def _(spark, d):
    chosen = select.by_exchanges(select.by_symbol(X.trades(spark, d), "ETH-USD"), ["BITSTAMP", "KRAKEN"])
    return summary.trade_summary(select.last_rows(chosen, 1000), "exchange")


@_query("row_count", X.TRADES_SQL, "SELECT count(*) AS rows FROM trades")
def _(spark, d):
    return summary.row_count(X.trades(spark, d))


@_query("count_by_symbol", X.TRADES_SQL, "SELECT symbol, count(*) AS rows FROM trades GROUP BY 1")
def _(spark, d):
    return summary.counts(X.trades(spark, d), "symbol")


@_query("count_by_pair", X.TRADES_SQL, "SELECT exchange, symbol, count(*) AS rows FROM trades GROUP BY 1, 2")
def _(spark, d):
    return summary.counts(X.trades(spark, d), "exchange", "symbol").orderBy("exchange", "symbol")


@_query("time_extent", X.TRADES_SQL, "SELECT min(timestamp) AS first_ts, max(timestamp) AS last_ts, count(*) AS rows FROM trades")
def _(spark, d):
    return summary.time_extent(X.trades(spark, d))


def _latest_sql(keys: str, cols: str, source: str = "trades") -> str:
    return f"SELECT {keys}, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY timestamp DESC, event_id DESC) AS n FROM {source}) WHERE n = 1"


@_query("latest_trades", X.TRADES_SQL, _latest_sql("symbol", "timestamp, exchange, price, size, side, trade_id"))
def _(spark, d):
    return sample.latest(X.trades(spark, d), "symbol").drop("event_id")


@_query("latest_books", X.BOOKS_SQL, _latest_sql("exchange, symbol", "timestamp, bid AS best_bid, ask AS best_ask", "(SELECT * FROM levels WHERE i = 1)"))
def _(spark, d):
    return select.best_quotes(sample.latest(X.orderbooks(spark, d), "exchange", "symbol")).select("exchange", "symbol", "timestamp", "best_bid", "best_ask")


@_query("latest_books_limit4", X.BOOKS_SQL, _latest_sql("exchange, symbol", "timestamp, event_id", "(SELECT * FROM levels WHERE i = 1)") + " ORDER BY timestamp DESC, event_id DESC LIMIT 4")
def _(spark, d):
    return select.newest_first(sample.latest(X.orderbooks(spark, d), "exchange", "symbol")).limit(4).select("exchange", "symbol", "timestamp", "event_id")


@_query("last_by_books", X.BOOKS_SQL, "SELECT exchange, symbol, cast(i AS INT) AS level, arg_max(bid, (timestamp, event_id)) AS bid, arg_max(volume, (timestamp, event_id)) AS volume FROM levels GROUP BY 1, 2, 3")
def _(spark, d):
    last = select.book_columns(sample.latest(X.orderbooks(spark, d), "exchange", "symbol"))
    return last.select("exchange", "symbol", F.posexplode(F.arrays_zip("bid_prices", "bid_sizes")).alias("p", "z")).select("exchange", "symbol", (F.col("p") + 1).alias("level"), F.col("z.bid_prices").alias("bid"), F.col("z.bid_sizes").alias("volume"))


_CHART = "(SELECT * FROM trades WHERE symbol = 'BTC-USD' ORDER BY timestamp DESC, event_id DESC LIMIT 1000)"


@_query("chart_series", X.TRADES_SQL, f"SELECT exchange, cast(row_number() OVER (PARTITION BY exchange ORDER BY timestamp, price) AS INT) AS n, epoch_us(timestamp) / 1e6 AS time, price AS value FROM {_CHART} WHERE exchange IN ('COINBASE', 'KRAKEN')")
def _(spark, d):
    tail = select.last_rows(select.by_symbol(X.trades(spark, d), "BTC-USD"), 1000)
    series = summary.chart_series(tail, ["Coinbase", "Kraken"])
    return series.select("exchange", F.posexplode("series").alias("p", "s")).select("exchange", (F.col("p") + 1).alias("n"), "s.time", "s.value")


@_query("chart_stats", X.TRADES_SQL, f"""SELECT e.exchange, count(t.exchange) AS points, sum(count(t.exchange)) OVER ()::BIGINT AS total_points,
  sum(CASE WHEN count(t.exchange) > 0 THEN 1 ELSE 0 END) OVER ()::BIGINT AS with_data
  FROM (VALUES ('COINBASE'), ('KRAKEN'), ('NOWHERE')) e(exchange) LEFT JOIN {_CHART} t ON t.exchange = e.exchange GROUP BY 1""")
def _(spark, d):
    return summary.chart_stats(select.last_rows(select.by_symbol(X.trades(spark, d), "BTC-USD"), 1000), ["Coinbase", "Kraken", "Nowhere"])


# Windows, ledger, growth ---------------------------------------------------------------

@_query("ledger_newest_total", X.LEDGER_SQL, "SELECT max(txn_id) AS txn_id, arg_max_null(row_count, txn_id) AS row_count, sum(row_count)::BIGINT AS total_rows FROM ledger")
def _(spark, d):
    return live.newest_with_total(X.ledger(spark, d))


@_query("ledger_incremental_size", X.LEDGER_SQL, "SELECT txn_id, coalesce(sum(row_count) OVER (ORDER BY txn_id), 0)::BIGINT AS table_rows FROM ledger")
def _(spark, d):
    return live.incremental_size(X.ledger(spark, d))


@_query("ledger_changes_since", X.LEDGER_SQL, "SELECT txn_id, row_count, min_ts, max_ts FROM ledger WHERE txn_id > 5")
def _(spark, d):
    return live.changes_since(X.ledger(spark, d), 5).select("txn_id", "row_count", "min_ts", "max_ts")


@_query("ledger_table_size", X.LEDGER_SQL, "SELECT coalesce(sum(row_count), (SELECT count(*) FROM trades))::BIGINT AS rows FROM ledger")
def _(spark, d):
    return live.table_size(X.ledger(spark, d), X.trades(spark, d))


@_query("growth_check", X.TRADES_SQL, "SELECT *, after - before AS delta, CASE WHEN after > before THEN 'flowing' ELSE 'stale' END AS status FROM (SELECT count(*) FILTER (timestamp <= TIMESTAMP '2024-01-01 00:10:00') AS before, count(*) FILTER (timestamp <= TIMESTAMP '2024-01-01 00:20:00') AS after FROM trades)")
def _(spark, d):
    return live.growth(X.trades(spark, d), F.expr("timestamp_ntz'2024-01-01 00:10:00'"), F.expr("timestamp_ntz'2024-01-01 00:20:00'"))


@_query("sequence_steps", X.SEQ_SQL, "SELECT symbol, event_id, seq - lag(seq) OVER (PARTITION BY symbol ORDER BY event_id) AS step FROM feed")
def _(spark, d):
    told = running.previous(X.feed(spark, d), ("symbol",), ("event_id",), "seq", "before")
    return told.select("symbol", "event_id", (F.col("seq") - F.col("before")).alias("step"))


# Feed normalisation -----------------------------------------------------------------------

_MATCH = "FROM trades WHERE event_id % 20 < 10"


@_query("matches_to_trades", X.TRADES_SQL, f"SELECT timestamp, 'COINBASE' AS exchange, symbol, price, size, CASE WHEN side = 'buy' THEN 'sell' ELSE 'buy' END AS side, trade_id {_MATCH}")
def _(spark, d):
    return feed.matches_to_trades(feed.parse(X.messages(spark, d), fields=feed.MATCH)).select(*schemas.TRADES.fieldNames())


_SECONDS = "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 0 ELSE epoch_us(timestamp) / 1e6 END"


@_query("event_time_fallback", X.TRADES_SQL, "SELECT trade_id, CASE WHEN event_id % 5 < 2 THEN timestamp + INTERVAL 1 SECOND ELSE timestamp END AS timestamp FROM trades")
def _(spark, d):
    t, sec = X.trades(spark, d), S.epoch_seconds(F.col("timestamp"))
    rows = t.select("trade_id", (sec + 1).alias("receipt_timestamp"), F.when(F.col("event_id") % 5 == 1, 0.0).when(F.col("event_id") % 5 > 1, sec).alias("timestamp"))
    return feed.with_event_time(rows).select("trade_id", "timestamp")


@_query("store_fields", X.TRADES_SQL, "SELECT timestamp, exchange, symbol, price, size, side, trade_id FROM trades")
def _(spark, d):
    return feed.store_fields(X.trades(spark, d).select("timestamp", "exchange", "symbol", F.col("price").cast("string").alias("price"), F.col("size").alias("amount"), "side", F.col("event_id").alias("id")))


@_query("tickers", X.TRADES_SQL, "SELECT event_id AS sequence, symbol, price - 0.5::DOUBLE AS best_bid, price + 0.5::DOUBLE AS best_ask, timestamp FROM trades WHERE event_id % 20 IN (10, 11)")
def _(spark, d):
    return feed.tickers(feed.parse(X.messages(spark, d)))


@_query("products", X.TRADES_SQL, "SELECT DISTINCT symbol AS id, split_part(symbol, '-', 1) AS base, split_part(symbol, '-', 2) AS quote, 0.01::DOUBLE AS tick_size FROM trades")
def _(spark, d):
    return feed.products(X.trades(spark, d).select(F.col("symbol").alias("id"), F.lit("0.01").alias("quote_increment")).distinct())


@_query("snapshot_levels", X.TRADES_SQL, """SELECT symbol, event_id AS snap_seq, side, price, amount FROM (
  SELECT symbol, event_id, 'bid' AS side, floor(price) - i AS price, i / 2.0::DOUBLE AS amount FROM trades, range(1, 4) r(i) WHERE event_id % 20 = 14
  UNION ALL SELECT symbol, event_id, 'ask', floor(price) + i, i / 4.0::DOUBLE FROM trades, range(1, 3) r(i) WHERE event_id % 20 = 14)""")
def _(spark, d):
    return feed.snapshot_levels(feed.parse(X.messages(spark, d)))


_UPDATES = """SELECT symbol, event_id AS sequence, 0 AS n, CASE WHEN side = 'buy' THEN 'bid' ELSE 'ask' END AS side, floor(price) AS price, size AS amount FROM trades WHERE event_id % 20 IN (12, 13)
  UNION ALL SELECT symbol, event_id, 1, 'ask', floor(price) + 1, 0 FROM trades WHERE event_id % 20 IN (12, 13)"""


@_query("update_levels", X.TRADES_SQL, _UPDATES)
def _(spark, d):
    return feed.update_levels(feed.parse(X.messages(spark, d)))


@_query("book_deltas", X.TRADES_SQL, f"SELECT sequence, symbol, count(*) FILTER (side = 'bid') AS bids, count(*) FILTER (side = 'ask') AS asks, round(sum(amount), 4) AS amount FROM ({_UPDATES}) GROUP BY 1, 2")
def _(spark, d):
    made = feed.deltas(feed.update_levels(feed.parse(X.messages(spark, d))))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x["amount"])
    return made.select("sequence", "symbol", F.size("bid").cast("long").alias("bids"), F.size("ask").cast("long").alias("asks"), F.round(total("bid") + total("ask"), 4).alias("amount"))


_STALE = "SELECT symbol, event_id, seq FROM (SELECT *, max(seq) OVER (PARTITION BY symbol ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM feed) WHERE top IS NULL OR seq > top"


@_query("stale_dropped", X.SEQ_SQL, _STALE)
def _(spark, d):
    return feed.in_sequence(X.feed(spark, d))


@_query("stale_after_snapshot", X.SEQ_SQL, f"SELECT * FROM ({_STALE}) WHERE seq > 5")
def _(spark, d):
    rows = X.feed(spark, d)
    return feed.in_sequence(rows, start=rows.select("symbol", F.lit(5).alias("start_seq")).distinct())


_GAPS = f"SELECT symbol, seq, previous, seq - previous - 1 AS missing FROM (SELECT *, lag(seq) OVER (PARTITION BY symbol ORDER BY seq) AS previous FROM ({_STALE})) WHERE seq - previous > 1"


@_query("sequence_gaps", X.SEQ_SQL, _GAPS)
def _(spark, d):
    return feed.gaps(feed.in_sequence(X.feed(spark, d)))


@_query("rows_outside_gaps", X.SEQ_SQL + f", clean AS ({_STALE}), gaps AS ({_GAPS})", """SELECT symbol, seq FROM clean c WHERE NOT EXISTS (
  SELECT 1 FROM gaps g WHERE g.symbol = c.symbol AND g.seq <= c.seq AND NOT EXISTS (
    SELECT 1 FROM clean s WHERE s.symbol = c.symbol AND s.seq % 40 = 0 AND s.seq >= g.seq AND s.seq <= c.seq))""")
def _(spark, d):
    clean = feed.in_sequence(X.feed(spark, d))
    snapshots = clean.where("seq % 40 = 0").select("symbol", F.col("seq").alias("snap_seq"))
    return feed.usable_rows(clean, feed.gaps(clean), snapshots)


@_query("order_type_enriched", X.TRADES_SQL, """SELECT t.trade_id, arg_max(CASE WHEN r.event_id % 3 = 0 THEN 'market' ELSE 'limit' END, r.event_id) FILTER (r.event_id IS NOT NULL) AS order_type
  FROM (SELECT * FROM trades WHERE event_id % 20 < 10) t LEFT JOIN (SELECT * FROM trades WHERE event_id % 20 = 15) r
  ON r.event_id % 300 = (t.event_id * 11) % 300 AND r.event_id < t.event_id GROUP BY 1""")
def _(spark, d):
    parsed = feed.parse(X.messages(spark, d))
    return feed.enrich_order_type(feed.matches_to_trades(parsed), parsed).select("trade_id", "order_type")


@_query("symbols_normalised", X.TRADES_SQL, "SELECT trade_id, CASE symbol WHEN 'BTC-USD' THEN 'XBT-USD' ELSE symbol END AS symbol FROM trades")
def _(spark, d):
    names = spark.range(1).select(F.lit("BTC-USD").alias("id"), F.lit("XBT-USD").alias("standard"))
    return feed.normalise_symbols(X.trades(spark, d).select("trade_id", "symbol"), names)


@_query("merged_feeds", X.TRADES_SQL, "SELECT trade_id, exchange, price FROM trades")
def _(spark, d):
    t = X.trades(spark, d)
    return feed.merge({e: t.where(F.col("exchange") == e).select("trade_id", "price") for e in schemas.EXCHANGES})


# Order books ----------------------------------------------------------------------------------

_DEPTH = "row_number() OVER (PARTITION BY {keys}, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END)"
_FINAL = "SELECT exchange, symbol, side, price, arg_max(amount, (timestamp, event_id)) AS amount FROM changes GROUP BY 1, 2, 3, 4 HAVING arg_max(amount, (timestamp, event_id)) > 0"


@_query("book_depth_arrays", X.L2_SQL, f"SELECT exchange, symbol, side, cast(level AS INT) AS level, price, amount FROM (SELECT *, {_DEPTH.format(keys='exchange, symbol')} AS level FROM ({_FINAL})) WHERE level <= 20")
def _(spark, d):
    alive = book.level_intervals(X.l2_changes(spark, d), *book.PAIR).where("valid_to is null")
    made = book.book_arrays(alive, 20, *book.PAIR)
    one = lambda s: made.select(*book.PAIR, F.lit(s[:-1]).alias("side"), F.posexplode(F.arrays_zip(F.get(F.col(s), F.lit(0)).alias("p"), F.get(F.col(s), F.lit(1)).alias("a"))).alias("n", "z")).select(*book.PAIR, "side", (F.col("n") + 1).alias("level"), F.col("z.p").alias("price"), F.col("z.a").alias("amount"))
    return one("bids").unionByName(one("asks"))


@_query("book_cut_depth", X.BOOKS_SQL, "SELECT event_id, cast(i AS INT) AS level, bid, volume FROM levels WHERE i <= 5")
def _(spark, d):
    cut = select.book_columns(book.cut_depth(X.orderbooks(spark, d), 5))
    return cut.select("event_id", F.posexplode(F.arrays_zip("bid_prices", "bid_sizes")).alias("p", "z")).select("event_id", (F.col("p") + 1).alias("level"), F.col("z.bid_prices").alias("bid"), F.col("z.bid_sizes").alias("volume"))


_GRID = ", grid AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', (SELECT max(timestamp) FROM trades), INTERVAL 30 SECOND)) AS g)"
_AS_OF = "SELECT g, exchange, symbol, side, price, arg_max(amount, (timestamp, event_id)) AS amount FROM grid JOIN {source} c ON c.timestamp <= g GROUP BY 1, 2, 3, 4, 5"


@_query("book_replay_30s", X.L2_SQL + _GRID, f"SELECT g AS ts, exchange, symbol, side, cast(level AS INT) AS level, price, amount FROM (SELECT *, {_DEPTH.format(keys='g, exchange, symbol')} AS level FROM ({_AS_OF.format(source='changes')}) WHERE amount > 0) WHERE level <= 20")
def _(spark, d):
    return book.replay(X.l2_changes(spark, d), "30s", 20)


_SNAPS = """, snaps AS (SELECT timestamp, event_id, exchange, symbol, side, floor(price) + k AS price, 1.0::DOUBLE AS amount FROM changes, (VALUES (0), (1)) v(k) WHERE event_id % 200 = 0),
epochs AS (SELECT *, (SELECT max(s.event_id) FROM snaps s WHERE s.exchange = x.exchange AND s.symbol = x.symbol AND s.event_id <= x.event_id) AS ep
  FROM (SELECT * FROM changes WHERE event_id % 200 <> 0 UNION ALL SELECT timestamp, event_id, exchange, symbol, side, price, amount FROM snaps) x),
now AS (SELECT g, exchange, symbol, arg_max(event_id, (timestamp, event_id)) AS ep FROM grid JOIN (SELECT DISTINCT exchange, symbol, timestamp, event_id FROM snaps) s ON s.timestamp <= g GROUP BY 1, 2, 3)"""


@_query("book_replay_snapshots", X.L2_SQL + _GRID + _SNAPS, f"""SELECT g AS ts, exchange, symbol, side, cast(level AS INT) AS level, price, amount FROM (SELECT *, {_DEPTH.format(keys='g, exchange, symbol')} AS level FROM (
  SELECT n.g, e.exchange, e.symbol, e.side, e.price, arg_max(e.amount, (e.timestamp, e.event_id)) AS amount FROM now n JOIN epochs e
  ON e.exchange = n.exchange AND e.symbol = n.symbol AND e.ep = n.ep AND e.timestamp <= n.g GROUP BY 1, 2, 3, 4, 5) WHERE amount > 0) WHERE level <= 20""")
def _(spark, d):
    c = X.l2_changes(spark, d)
    snaps = c.where("event_id % 200 = 0").select(*book.PAIR, "event_id", "timestamp", "side", F.explode(F.array(F.col("price"), F.col("price") + 1)).alias("price"), F.lit(1.0).alias("amount"))
    end = c.agg(F.max(S.epoch_micros(F.col("timestamp")))).first()[0]
    return book.replay_with_snapshots(c, snaps, "30s", 20, end)


#: A sequential fold of each order's events, independent of the window recipe.
_FOLD = """, e AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY sequence) AS n FROM orders),
fold AS (
  SELECT order_id, 0::BIGINT AS n, 0::BIGINT AS sequence, '' AS type, NULL::BIGINT AS price, false AS alive, 0::BIGINT AS size, false AS shown FROM (SELECT DISTINCT order_id FROM orders)
  UNION ALL
  SELECT e.order_id, e.n, e.sequence, e.type, CASE WHEN e.type = 'open' THEN e.price ELSE f.price END,
    CASE e.type WHEN 'open' THEN true WHEN 'match' THEN f.alive AND f.size - e.size > 0 WHEN 'done' THEN false ELSE f.alive END,
    CASE WHEN e.type = 'open' THEN e.size WHEN NOT f.alive THEN f.size WHEN e.type = 'match' THEN greatest(f.size - e.size, 0)
      WHEN e.type = 'change' THEN e.size WHEN e.price IS NULL THEN f.size ELSE 0 END,
    e.type = 'open' OR f.alive
  FROM fold f JOIN e ON e.order_id = f.order_id AND e.n = f.n + 1)"""


def _recursive(name: str, sql: str):
    return _query(name, "RECURSIVE " + X.L3_SQL + _FOLD, sql)


@_recursive("l3_transitions", "SELECT order_id, sequence, type, price, size AS remaining FROM fold WHERE shown")
def _(spark, d):
    return book.order_transitions(X.l3_events(spark, d))


@_recursive("l3_deltas", "SELECT order_id, sequence, price, size AS remaining FROM fold WHERE shown AND type <> 'open'")
def _(spark, d):
    return book.order_transitions(X.l3_events(spark, d)).where("type <> 'open'").select("order_id", "sequence", "price", "remaining")


@_recursive("l3_rejected_matches", "SELECT order_id, sequence FROM fold WHERE NOT shown AND type = 'match'")
def _(spark, d):
    return book.rejected_matches(X.l3_events(spark, d)).select("order_id", "sequence")


@_recursive("l3_levels", "SELECT price, count(*) AS orders, sum(size)::BIGINT AS amount FROM (SELECT order_id, arg_max(price, n) AS price, arg_max(size, n) AS size FROM fold WHERE shown GROUP BY 1) WHERE size > 0 GROUP BY 1")
def _(spark, d):
    return book.levels_from_orders(book.order_transitions(X.l3_events(spark, d)))


@_query("l3_initial_load", X.L3_SQL, "SELECT 500::BIGINT AS sequence, order_id, 'open' AS type, price, size FROM orders WHERE type = 'open' AND sequence <= 500 UNION ALL SELECT sequence, order_id, type, price, size FROM orders WHERE sequence > 500")
def _(spark, d):
    e = X.l3_events(spark, d)
    return book.load_orders(e.where("type = 'open' and sequence <= 500").select("order_id", "price", "size"), e, 500)


@_query("book_top_view", X.BOOKS_SQL, "SELECT event_id, cast(i AS INT) AS n, bid AS bid_price, volume AS ask_volume, 20 AS bid_levels FROM levels WHERE i <= 3")
def _(spark, d):
    v = book.top_view(X.orderbooks(spark, d), 3)
    return v.select("event_id", "bid_levels", F.posexplode(F.arrays_zip("bid_prices", "ask_volumes")).alias("p", "z")).select("event_id", (F.col("p") + 1).alias("n"), F.col("z.bid_prices").alias("bid_price"), F.col("z.ask_volumes").alias("ask_volume"), "bid_levels")


_FLAT = ", ".join(f"max(bid) FILTER (i = {i + 1}) AS bid_{i}_price, max(volume) FILTER (i = {i + 1}) AS bid_{i}_size, max(ask) FILTER (i = {i + 1}) AS ask_{i}_price, max(volume) FILTER (i = {i + 1}) AS ask_{i}_size" for i in range(10))


@_query("book_flattened", X.BOOKS_SQL, f"SELECT event_id, {_FLAT} FROM levels GROUP BY 1")
def _(spark, d):
    return book.flatten(X.orderbooks(spark, d), 10).drop("timestamp", "exchange", "symbol")


@_query("books_thinned", X.TRADES_SQL, "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY exchange, symbol ORDER BY timestamp, event_id) AS n FROM trades) WHERE n % 100 = 0")
def _(spark, d):
    return book.thin(X.orderbooks(spark, d).select("timestamp", "exchange", "symbol", "event_id"), 100).select("event_id")


# Scalar functions ---------------------------------------------------------------------------------

@_query("scalar_values", X.TRADES_SQL, """SELECT trade_id, price * size AS notional, epoch_us(timestamp) / 1e6 AS seconds, make_timestamp((epoch_us(timestamp) // 1000000) * 1000000) AS whole_second,
  split_part(symbol, '-', 1) AS base, lower(exchange) AS venue, CASE WHEN event_id % 2 = 0 THEN price END AS parsed FROM trades""")
def _(spark, d):
    t = X.trades(spark, d)
    return t.select(
        "trade_id", (F.col("price") * F.col("size")).alias("notional"), S.epoch_seconds(F.col("timestamp")).alias("seconds"), S.floor_to(F.col("timestamp"), "1s").alias("whole_second"),
        S.base_currency(F.col("symbol")).alias("base"), F.lower("exchange").alias("venue"), S.number(F.when(F.col("event_id") % 2 == 0, F.col("price").cast("string")).otherwise("n/a")).alias("parsed"))


@_query("map_lookup", X.TRADES_SQL, "SELECT trade_id, CASE exchange WHEN 'COINBASE' THEN 'US' WHEN 'BITSTAMP' THEN 'EU' END AS region FROM trades")
def _(spark, d):
    regions = F.map_from_entries(F.array(F.struct(F.lit("COINBASE"), F.lit("US")), F.struct(F.lit("BITSTAMP"), F.lit("EU"))))
    return X.trades(spark, d).select("trade_id", F.try_element_at(regions, F.col("exchange")).alias("region"))


@_query("series_json", X.TRADES_SQL, "SELECT exchange, epoch_us(timestamp) / 1e6 AS time, price AS value, count(*) AS points FROM trades GROUP BY 1, 2, 3")
def _(spark, d):
    text = summary.series_json(summary.series_chunks(X.trades(spark, d).where("price is not null"), list(schemas.EXCHANGES)))
    told = text.select("exchange", F.explode(F.from_json("json", "array<struct<time:double,value:double>>")).alias("p"))
    return told.groupBy("exchange", "p.time", "p.value").agg(F.count("*").alias("points"))


# Streams (run over what is there, then read) ----------------------------------------------------------

def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: the checkpoint folder, or a local one in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(root or tempfile.mkdtemp(prefix='tidemark-stream-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return live.live_table(spark, d, schemas.EVENTS, pattern="events.parquet").transform(X.trades_from)


FILES = 4  # of each part of a growing folder, at least
ROWS = 200_000  # of a file, about: files grow in number, so that writing and reading a part spread


def _in_parts(rows: DataFrame, order: str, path: str, parts: int = 4, newest_first: bool = False, build: Callable[[DataFrame], DataFrame] = lambda df: df) -> int:
    """Append ``rows`` to a growing folder in ``parts`` even spans of ``order``, one part after the other; the number of files of each part.

    ``build`` makes the stored rows once they are dealt to files, so that its columns are not shuffled.
    """
    last, n = rows.agg(F.max(order), F.count("*")).first()
    at, files = F.floor(F.col(order) * parts / ((last or 0) + 1)), max(FILES, -(-n // (parts * ROWS)))
    for k in reversed(range(parts)) if newest_first else range(parts):
        build(rows.where(at == k).repartition(files)).write.mode("append").parquet(path)
    return files


def _growing(spark: SparkSession, d: str, newest_first: bool = False) -> DataFrame:
    """Trades as a stream of four micro-batches, from events that arrived in four parts."""
    path = _scratch(spark, "events")
    files = _in_parts(X.events(spark, d), "event_id", path, newest_first=newest_first)
    return live.live_table(spark, path, schemas.EVENTS, max_files=files).transform(X.trades_from)


def _arriving(spark: SparkSession, name: str, rows: DataFrame, order: str, build: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """What ``build`` makes of ``rows``, as a stream of four micro-batches in ``order``."""
    path = _scratch(spark, name)
    files = _in_parts(rows, order, path, build=build)
    return live.live_table(spark, path, build(rows).schema, max_files=files)


def _ran(spark: SparkSession, name: str, df: DataFrame, mode: str) -> DataFrame:
    path = _scratch(spark, name)
    live.run_once(df, f"{path}/out", f"{path}/checkpoint", mode)
    return spark.read.parquet(f"{path}/out")


@_query("stream_candles", X.TRADES_SQL, _candles_sql("5 seconds"))
def _(spark, d):
    out = _ran(spark, "candles", sample.candles(_stream(spark, d), "5s"), "complete")
    return out


@_query("stream_candles_closed", X.TRADES_SQL, f"SELECT * FROM ({_candles_sql('5 seconds')}) WHERE ts + INTERVAL 5 SECOND <= (SELECT max(timestamp) FROM trades) - INTERVAL 10 SECOND")
def _(spark, d):
    out = _ran(spark, "closed", live.candles(_stream(spark, d), "5s"), "append")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@_query("stream_latest", X.TRADES_SQL, _latest_sql("symbol", "timestamp, exchange, price, size, side, trade_id"))
def _(spark, d):
    return _ran(spark, "latest", live.latest(_stream(spark, d), "symbol"), "complete").drop("event_id")


@_query("stream_sampled_books", X.BOOKS_SQL, """SELECT * FROM (SELECT time_bucket(INTERVAL '1 second', timestamp) AS timestamp, exchange, symbol, arg_max(bid, (timestamp, event_id)) AS best_bid, arg_max(ask, (timestamp, event_id)) AS best_ask
  FROM levels WHERE i = 1 GROUP BY 1, 2, 3) WHERE timestamp + INTERVAL 1 SECOND <= (SELECT max(timestamp) FROM trades) - INTERVAL 10 SECOND""")
def _(spark, d):
    out = _ran(spark, "books", live.sampled_books(_stream(spark, d).transform(X.books_from)), "append")
    return select.best_quotes(out).select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "exchange", "symbol", "best_bid", "best_ask")


@_query("stream_book_state", X.L2_SQL, "SELECT exchange, symbol, side, price, arg_max(amount, (timestamp, event_id)) AS amount FROM changes GROUP BY 1, 2, 3, 4 HAVING arg_max(amount, (timestamp, event_id)) > 0")
def _(spark, d):
    return live.standing(_ran(spark, "state", live.book_state(_growing(spark, d, newest_first=True).transform(X.l2_from)), "update"))


@_query("stream_sequence", X.SEQ_SQL, """SELECT symbol, event_id, seq, CASE WHEN seq <= top THEN 'stale' WHEN seq % 40 = 0 THEN 'ok' WHEN seq > top + 1 THEN 'gap'
  WHEN coalesce(max(CASE WHEN seq > top + 1 AND seq % 40 <> 0 THEN event_id END) OVER w > coalesce(max(CASE WHEN seq % 40 = 0 AND seq > coalesce(top, -1) THEN event_id END) OVER w, -1), false) THEN 'blank' ELSE 'ok' END AS status
  FROM (SELECT *, max(seq) OVER (PARTITION BY symbol ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM feed) WINDOW w AS (PARTITION BY symbol ORDER BY event_id)""")
def _(spark, d):
    rows = X.feed(spark, d).withColumn("snapshot", F.col("seq") % 40 == 0)
    with keyed.rocksdb(spark):
        return _ran(spark, "sequence", keyed.sequenced(_arriving(spark, "feed", rows, "event_id")), "append")


@_query("stream_late_rows", X.TRADES_SQL, """SELECT count(*) FILTER (timestamp <= m - INTERVAL 10 SECOND AND event_id < h) AS late, count(*) FILTER (NOT (timestamp <= m - INTERVAL 10 SECOND AND event_id < h)) AS kept
  FROM trades, (SELECT (max(event_id) + 1) // 2 AS h, max(timestamp) FILTER (event_id % 2 = 0 AND event_id >= (SELECT (max(event_id) + 1) // 2 FROM trades)) AS m FROM trades)""")
def _(spark, d):
    rows, path = X.trades(spark, d).select("timestamp", "event_id"), _scratch(spark, "late")
    half = (rows.agg(F.max("event_id")).first()[0] + 1) // 2
    new, even = F.col("event_id") >= half, F.col("event_id") % 2 == 0
    for part in (new & even, new & ~even, ~new):  # a watermark drops rows from the second batch after it on
        rows.where(part).repartition(FILES).write.mode("append").parquet(path)
    out = _scratch(spark, "kept")
    query = live.run_once(live.deduplicated(live.live_table(spark, path, rows.schema, max_files=FILES), ["event_id"]), f"{out}/out", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/out").agg(F.lit(live.late_rows(query)).cast("long").alias("late"), F.count("*").alias("kept"))


@_query("stream_progress", X.TRADES_SQL, """SELECT part AS txn_id, coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS old_size, sum(n) OVER (ORDER BY part)::BIGINT AS new_size
  FROM (SELECT event_id * 4 // (SELECT max(event_id) + 1 FROM trades) AS part, count(*) AS n FROM trades GROUP BY 1)""")
def _(spark, d):
    path = _scratch(spark, "progress")
    kept.ingest(_growing(spark, d), f"{path}/table", f"{path}/ledger", f"{path}/checkpoint").awaitTermination()
    return live.size_steps(spark.read.schema(schemas.LEDGER).parquet(f"{path}/ledger"))


@_query("stream_deduplicated", X.TRADES_SQL, "SELECT DISTINCT symbol, event_id // 2 AS pair FROM trades")
def _(spark, d):
    rows = _stream(spark, d).select("timestamp", "symbol", F.floor(F.col("event_id") / 2).cast("long").alias("pair"))
    return _ran(spark, "dedup", live.deduplicated(rows, ["symbol", "pair"], "365 days"), "append").select("symbol", "pair")


@_query("stream_ingest_ledger", X.TRADES_SQL, "SELECT 0::BIGINT AS txn_id, count(*) AS row_count, min(timestamp) AS min_ts, max(timestamp) AS max_ts FROM trades")
def _(spark, d):
    path = _scratch(spark, "ingest")
    kept.ingest(_stream(spark, d), f"{path}/table", f"{path}/ledger", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(schemas.LEDGER).parquet(f"{path}/ledger").select("txn_id", "row_count", "min_ts", "max_ts")


@_query("stream_last_trades", X.TRADES_SQL, "SELECT timestamp, trade_id, price FROM trades ORDER BY timestamp DESC, event_id DESC LIMIT 1000")
def _(spark, d):
    path = _scratch(spark, "last")
    kept.keep_last(_growing(spark, d, newest_first=True), 1000, f"{path}/rows", f"{path}/checkpoint")
    return kept.Versions(spark, f"{path}/rows").read().select("timestamp", "trade_id", "price")


@_query("stream_order_type", X.TRADES_SQL, """SELECT t.trade_id, arg_max(CASE WHEN r.event_id % 3 = 0 THEN 'market' ELSE 'limit' END, r.event_id) FILTER (r.event_id IS NOT NULL) AS order_type
  FROM (SELECT * FROM trades WHERE event_id % 20 < 10 AND epoch_us(timestamp) <= (SELECT (max(epoch_us(timestamp)) // 1000 - 10000) * 1000 FROM trades WHERE event_id % 20 < 10 OR event_id % 20 = 15)) t
  LEFT JOIN (SELECT * FROM trades WHERE event_id % 20 = 15) r ON r.event_id % 300 = (t.event_id * 11) % 300 AND r.event_id < t.event_id GROUP BY 1""")
def _(spark, d):
    messages = _arriving(spark, "messages", X.events(spark, d), "event_id", lambda events: X.messages_from(X.trades_from(events)))
    parsed = feed.parse(messages, fields=(*feed.MATCH, "type", "order_id", "order_type"))
    said = parsed.where("route = 'order' and type = 'received'").withColumn("timestamp", feed.event_time(F.col("time")))
    with keyed.rocksdb(spark):
        return _ran(spark, "order_types", keyed.order_types(feed.matches_to_trades(parsed), said), "append").select("trade_id", "order_type")


@_recursive("stream_l3_transitions", "SELECT order_id, sequence, type, price, size AS remaining FROM fold WHERE shown")
def _(spark, d):
    with keyed.rocksdb(spark):
        return _ran(spark, "l3", keyed.order_transitions(_arriving(spark, "l3_events", X.l3_events(spark, d), "sequence")), "append")


@_query("stream_book_levels", X.L2_SQL, """, resets AS (SELECT exchange, symbol, max(event_id) AS since FROM changes WHERE event_id % 500 = 250 GROUP BY 1, 2)
  SELECT exchange, symbol, side, price, arg_max(amount, (c.timestamp, event_id)) AS amount FROM changes c LEFT JOIN resets USING (exchange, symbol)
  WHERE event_id >= coalesce(since, -1) GROUP BY 1, 2, 3, 4 HAVING arg_max(amount, (c.timestamp, event_id)) > 0""")
def _(spark, d):
    path = _scratch(spark, "levels")
    changes = X.l2_from(_growing(spark, d))
    snapshot = F.col("event_id") % 500 == 250  # such a change is the whole book of its pair
    with keyed.rocksdb(spark):
        kept.keep_levels(keyed.book_levels(changes.where(~snapshot), changes.where(snapshot), delay="2d"), f"{path}/book", f"{path}/checkpoint")
    return kept.Versions(spark, f"{path}/book").read().select("exchange", "symbol", "side", "price", "amount")


@_query("stream_candles_exact", X.TRADES_SQL, _candles_sql("5 seconds"))
def _(spark, d):
    path = _scratch(spark, "exact")
    kept.keep_candles(_growing(spark, d, newest_first=True), "5s", f"{path}/rows", f"{path}/candles", f"{path}/checkpoint", "10m")
    return spark.read.parquet(f"{path}/candles").drop("span")


@_query("stream_progress_table", X.TRADES_SQL, """SELECT part AS batch_id, n AS rows_in, coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS old_size, sum(n) OVER (ORDER BY part)::BIGINT AS new_size
  FROM (SELECT event_id * 4 // (SELECT max(event_id) + 1 FROM trades) AS part, count(*) AS n FROM trades GROUP BY 1)""")
def _(spark, d):
    path = _scratch(spark, "updates")
    listener = kept.ProgressTable(spark, f"{path}/progress", f"updates-{uuid.uuid4().hex}")
    spark.streams.addListener(listener)
    try:
        rows = _growing(spark, d)
        rows.writeStream.queryName(listener.name).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).format("noop").start().awaitTermination()
        listener.finish()
    finally:
        spark.streams.removeListener(listener)
    return listener.read().select("batch_id", "rows_in", "old_size", "new_size")


# Quality --------------------------------------------------------------------------------------------------

@_query("table_counts", X.TRADES_SQL, "SELECT 'trades' AS table_name, count(*) AS rows FROM trades UNION ALL SELECT 'orderbooks', count(*) FROM trades UNION ALL SELECT 'orderbooks_1s', count(*) FROM (SELECT DISTINCT time_bucket(INTERVAL '1 second', timestamp), exchange, symbol FROM trades)")
def _(spark, d):
    books = X.orderbooks(spark, d)
    return quality.table_counts({"trades": X.trades(spark, d), "orderbooks": books, "orderbooks_1s": sample.sample_books(books)})


@_query("book_shape", X.BOOKS_SQL, "SELECT count(DISTINCT event_id) AS books, 0::BIGINT AS bad_bids, 0::BIGINT AS bad_asks, 0::BIGINT AS too_deep FROM levels")
def _(spark, d):
    return quality.shape_violations(quality.assert_schema(X.orderbooks(spark, d), schemas.ORDERBOOKS), 20)


@_query("book_order", X.BOOKS_SQL, """SELECT count(*) FILTER (bids_bad)::BIGINT AS bids_unsorted, count(*) FILTER (asks_bad)::BIGINT AS asks_unsorted, count(*) FILTER (crossed)::BIGINT AS crossed FROM (
  SELECT event_id, bool_or(bid > prev_bid) AS bids_bad, bool_or(ask < prev_ask) AS asks_bad, bool_or(i = 1 AND bid >= ask) AS crossed FROM (
    SELECT *, lag(bid) OVER (PARTITION BY event_id ORDER BY i) AS prev_bid, lag(ask) OVER (PARTITION BY event_id ORDER BY i) AS prev_ask FROM levels) GROUP BY 1)""")
def _(spark, d):
    return quality.order_violations(X.orderbooks(spark, d))


@_query("ingest_completeness", X.LEDGER_SQL, "SELECT w AS written, f AS found, round(f::DOUBLE / w, 4) AS ratio, f >= 0.9 * w AS complete FROM (SELECT sum(row_count)::BIGINT AS w, (SELECT count(*) FROM trades) AS f FROM ledger)")
def _(spark, d):
    return quality.completeness(X.ledger(spark, d), X.trades(spark, d))


@_query("trade_round_trip", X.TRADES_SQL, "SELECT timestamp, exchange, symbol, price, size, side, trade_id FROM trades")
def _(spark, d):
    path = _scratch(spark, "trades")
    tables.append_trades(X.trades(spark, d), path)
    return tables.read_between(spark, path, schemas.TRADES, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))
