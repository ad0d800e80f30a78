"""Raw exchange messages to clean rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators.running import running_max

DECIMAL = "decimal(28,12)"
SCHEMA = (
    "type string, sequence long, product_id string, price string, size string, side string, time string, trade_id long, maker_order_id string, "
    "taker_order_id string, order_id string, order_type string, best_bid string, best_ask string, bids array<array<string>>, asks array<array<string>>, changes array<array<string>>"
)
ROUTES = {"ticker": "ticker", "match": "trade", "last_match": "trade", "snapshot": "book", "l2update": "book", "open": "order", "done": "order", "change": "order", "received": "order"}
IGNORED = ("activate", "subscriptions")


#: The fields that ``matches_to_trades`` reads.
MATCH = ("sequence", "product_id", "price", "size", "side", "time", "trade_id", "maker_order_id", "taker_order_id")


def parse(messages: DataFrame, raw: str = "raw", fields: tuple[str, ...] | None = None) -> DataFrame:
    """One column for each known field (or each of ``fields``), and ``route``: trade, ticker, book, order, ignored or invalid.

    The route comes from the message's type alone, so a filter on it goes before the
    parsing of all fields.
    """
    schema = SCHEMA if fields is None else ", ".join(f for f in SCHEMA.split(", ") if f.split()[0] in fields)
    kind = F.get_json_object(raw, "$.type")
    routes = F.create_map(*[F.lit(x) for kv in (ROUTES | dict.fromkeys(IGNORED, "ignored")).items() for x in kv])
    route = F.coalesce(F.try_element_at(routes, kind), F.lit("invalid"))
    return messages.select("*", route.alias("route"), F.from_json(raw, schema).alias("m")).select(*messages.columns, "route", "m.*")


def rejects(messages: DataFrame, raw: str = "raw") -> DataFrame:
    return parse(messages, raw).where("route = 'invalid'").select(*messages.columns)


def event_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSX")).cast("timestamp_ntz")


def matches_to_trades(parsed: DataFrame, exchange: str = "COINBASE") -> DataFrame:
    """Trades from match messages; the side is the taker's, the opposite of the maker's in the message."""
    return parsed.where("route = 'trade'").select(
        event_time(F.col("time")).alias("timestamp"), F.lit(exchange).alias("exchange"), F.col("product_id").alias("symbol"),
        F.col("price").try_cast(DECIMAL).cast("double").alias("price"), F.col("size").try_cast(DECIMAL).cast("double").alias("size"),
        F.when(F.col("side") == "buy", "sell").otherwise("buy").alias("side"), F.col("trade_id").cast("string").alias("trade_id"), "sequence", "maker_order_id", "taker_order_id")


def with_event_time(df: DataFrame, seconds: str = "timestamp", receipt: str = "receipt_timestamp") -> DataFrame:
    """Event time from float seconds; a missing or zero time falls back to the receipt time."""
    return df.withColumn(seconds, S.from_seconds(F.coalesce(F.nullif(F.col(seconds), F.lit(0.0)), F.col(receipt))))


def store_fields(df: DataFrame) -> DataFrame:
    """Feed names to table names: amount is size, id is trade_id; numbers become doubles."""
    return df.select("timestamp", "exchange", "symbol", F.col("price").try_cast("double").alias("price"), F.col("amount").try_cast("double").alias("size"), "side", F.col("id").cast("string").alias("trade_id"))


def tickers(parsed: DataFrame) -> DataFrame:
    return parsed.where("route = 'ticker'").select(F.col("product_id").alias("symbol"), S.number(F.col("best_bid")).alias("best_bid"), S.number(F.col("best_ask")).alias("best_ask"), event_time(F.col("time")).alias("timestamp"), "sequence")


def products(rows: DataFrame) -> DataFrame:
    """id, base, quote, tick_size of reference rows (id, quote_increment)."""
    return rows.select("id", S.base_currency(F.col("id")).alias("base"), S.quote_currency(F.col("id")).alias("quote"), S.number(F.col("quote_increment")).alias("tick_size"))


def snapshot_levels(parsed: DataFrame) -> DataFrame:
    """symbol, snap_seq, side, price, amount: the levels that replace a pair's book."""
    side = lambda name, rows: F.transform(rows, lambda r: F.struct(F.lit(name).alias("side"), S.number(r[0]).alias("price"), S.number(r[1]).alias("amount")))
    both = F.concat(F.coalesce(side("bid", F.col("bids")), F.array()), F.coalesce(side("ask", F.col("asks")), F.array()))
    return parsed.where("type = 'snapshot'").select(F.col("product_id").alias("symbol"), F.col("sequence").alias("snap_seq"), F.explode(both).alias("l")).select("symbol", "snap_seq", "l.*")


def update_levels(parsed: DataFrame) -> DataFrame:
    """symbol, sequence, n (position in the message), side, price, amount of level changes."""
    rows = parsed.where("type = 'l2update'").select(F.col("product_id").alias("symbol"), "sequence", F.posexplode("changes").alias("n", "c"))
    return rows.select("symbol", "sequence", "n", F.when(F.col("c")[0] == "buy", "bid").otherwise("ask").alias("side"), S.number(F.col("c")[1]).alias("price"), S.number(F.col("c")[2]).alias("amount"))


def deltas(updates: DataFrame) -> DataFrame:
    """Changed (price, amount) pairs of each message by side, in message order."""
    pairs = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("n", "price", "amount")))), lambda x: F.struct(x["price"].alias("price"), x["amount"].alias("amount")))
    return updates.groupBy("symbol", "sequence").agg(pairs("bid").alias("bid"), pairs("ask").alias("ask"))


def enrich_order_type(trades: DataFrame, parsed: DataFrame) -> DataFrame:
    """order_type of the taker's latest earlier ``received`` message; null if there is none.

    One running value over trades and received messages together: no pair of them meets.
    """
    said, heard, last = S.free(trades, "said", "heard", "last")
    received = parsed.where("route = 'order' and type = 'received'").select(F.col("order_id").alias("taker_order_id"), "sequence", F.struct("sequence", "order_type").alias(said))
    both = trades.withColumn(said, F.lit(None).cast("struct<sequence:bigint,order_type:string>")).unionByName(received, allowMissingColumns=True).withColumn(heard, F.col(said).isNotNull())  # a trade comes first at equal sequence
    told = running_max(both, ("taker_order_id",), ("sequence", heard), {last: F.col(said)}, inclusive=True)
    known = F.when(F.col("taker_order_id").isNotNull(), F.col(last)["order_type"])
    return told.where(~F.col(heard)).select(*trades.columns, known.alias("order_type"))


def normalise_symbols(df: DataFrame, symbols: DataFrame, limit: int = 100_000) -> DataFrame:
    """Exchange ids replaced by standard symbols (id, standard); unknown ids are kept.

    The reference table is broadcast up to ``limit`` rows and joined by shuffle beyond.
    """
    small = symbols.limit(limit + 1).count() <= limit
    found = df.join(F.broadcast(symbols) if small else symbols, df["symbol"] == symbols["id"], "left")
    return found.withColumn("symbol", F.coalesce("standard", "symbol")).drop("id", "standard")


def merge(feeds: dict[str, DataFrame]) -> DataFrame:
    """All feeds in one table, with their exchange."""
    return reduce(DataFrame.unionByName, [df.withColumn("exchange", F.lit(name)) for name, df in feeds.items()])


def in_sequence(feed: DataFrame, pair: str = "symbol", arrival: str = "event_id", seq: str = "seq", start: DataFrame | None = None) -> DataFrame:
    """Rows whose sequence exceeds every earlier one of the pair; with ``start`` (pair, start_seq) only after the snapshot."""
    if start is not None:
        feed = feed.join(start, pair).where(F.col(seq) > F.col("start_seq")).drop("start_seq")
    top = S.free(feed, "top")[0]
    return running_max(feed, (pair,), (arrival,), {top: F.col(seq)}).where(F.col(top).isNull() | (F.col(seq) > F.col(top))).drop(top)


def gaps(clean: DataFrame, pair: str = "symbol", seq: str = "seq") -> DataFrame:
    """pair, seq, previous, missing: the first row after each hole; the pair is blank until a new snapshot."""
    before = running_max(clean.select(pair, seq), (pair,), (seq,), {"previous": F.col(seq)})
    return before.where(F.col(seq) - F.col("previous") > 1).select(pair, seq, "previous", (F.col(seq) - F.col("previous") - 1).alias("missing"))


def usable_rows(clean: DataFrame, gap_rows: DataFrame, snapshots: DataFrame, pair: str = "symbol", seq: str = "seq") -> DataFrame:
    """Rows not blanked by a gap: after each gap nothing counts until the pair's next snapshot (pair, snap_seq)."""
    of = lambda df, at, kind: df.select(pair, F.col(at).alias(seq), F.lit(kind).alias("kind"))
    rows = of(clean, seq, 2).unionByName(of(gap_rows, seq, 0)).unionByName(of(snapshots, "snap_seq", 1))
    at = lambda kind: F.when(F.col("kind") == kind, F.col(seq))
    told = running_max(rows, (pair,), (seq, "kind"), {"gap": at(0), "snapshot": at(1)}, inclusive=True)
    return told.where("kind = 2 and (gap is null or coalesce(snapshot >= gap, false))").select(pair, seq)
