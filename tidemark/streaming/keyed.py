"""Keyed state over micro-batches: order types, order lives and book levels.

Rows are dealt to ``buckets`` by a hash of their order or price, and each bucket keeps a
map in the state store, so a batch makes one call a bucket whatever the number of
keys, and a busy pair spreads. Entries leave the map when they end; see each function
for what bounds the rest. The state store must be RocksDB (``rocksdb`` sets it for a block).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import scalar as S

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 32


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The session's state store is RocksDB inside the block; queries must start there."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def _bucket(df: DataFrame, column, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(column), F.lit(buckets)))


def _rows(rows: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(list(order), kind="stable", ignore_index=True)


def _pack(frame: pd.DataFrame, schema: pa.Schema) -> bytes:
    """``frame`` as one Arrow stream: the state store moves it as one value, not row by row."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(pa.Table.from_pandas(frame, schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpack(packed: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(packed)).read_pandas()


# Order types --------------------------------------------------------------------------------

WAITING = pa.schema([("order_id", pa.string()), ("trade_id", pa.string()), ("sequence", pa.int64()), ("micros", pa.int64())])
PACKED = 50_000  # rows at most in one value of the state


class _OrderTypes(StatefulProcessor):
    """What ``received`` messages said of each order of a bucket, and trades that wait for the watermark."""

    def __init__(self, keep_micros: int) -> None:
        self.keep = keep_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.said = handle.getMapState("said", "order_id string", "sequences array<long>, types array<string>, micros array<long>")
        self.waiting = handle.getListState("waiting", "least long, most long, packed binary")  # rows of WAITING and the span of their micros
        self.swept = handle.getValueState("swept", "micros long")

    def _known(self, order: str) -> tuple[list, list, list]:
        return tuple(map(list, self.said.getValue((order,)))) if self.said.containsKey((order,)) else ([], [], [])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _rows(rows, "sequence")
        received = batch["received"].to_numpy(bool)
        for order, part in batch[received].groupby("order_id", sort=False):
            known = zip(*self._known(order))
            new = zip(part["sequence"].tolist(), part["order_type"].tolist(), part["micros"].tolist())
            told = sorted([*known, *new], key=lambda r: r[0])
            self.said.updateValue((order,), tuple(map(list, zip(*told))))
        trades = batch[~received]
        if len(trades):
            self.waiting.appendList(self._parts(trades))
            self.handle.registerTimer(-(-int(trades["micros"].min()) // 1000))
        return iter(())

    @staticmethod
    def _parts(trades: pd.DataFrame) -> list[tuple[int, int, bytes]]:
        by_time = trades.sort_values("micros", kind="stable")[WAITING.names]
        parts = [by_time.iloc[at:at + PACKED] for at in range(0, len(by_time), PACKED)]
        return [(int(p["micros"].iloc[0]), int(p["micros"].iloc[-1]), _pack(p, WAITING)) for p in parts]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Trades up to the watermark are answered: nothing that they could hear of is still to come."""
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [*self.waiting.get()] if self.waiting.exists() else []
        due, later = [w for w in waiting if w[0] <= now], [w for w in waiting if w[0] > now]
        if not due:
            return
        trades = pd.concat([_unpack(packed) for *_, packed in due], ignore_index=True)
        if max(w[1] for w in due) > now:
            later += self._parts(trades[trades["micros"] > now])
            trades = trades[trades["micros"] <= now]
        self.waiting.put(later) if later else self.waiting.clear()
        if later:
            self.handle.registerTimer(-(-min(w[0] for w in later) // 1000))
        of, told = {}, np.full(len(trades), None, object)
        numbers = trades["sequence"].to_numpy()
        for order, rows in trades.groupby("order_id", sort=False).indices.items():
            sequences, types, _ = of[order] = self._known(order)
            told[rows] = np.array([None, *types], object)[np.searchsorted(np.array(sequences, np.int64), numbers[rows], "left")]
        for order, (sequences, types, micros) in of.items():  # of what is past only the latest can be asked for again
            past = max((i for i, m in enumerate(micros) if m <= now), default=0)
            if past:
                self.said.updateValue((order,), (sequences[past:], types[past:], micros[past:]))
        self._sweep(now)
        yield trades[["trade_id", "sequence"]].assign(order_type=told)

    def _sweep(self, now: int) -> None:
        last = self.swept.get()
        if last and now - last[0] < self.keep // 4:
            return
        self.swept.update((now,))
        for (order,), (_, _, micros) in [*self.said.iterator()]:
            if max(micros) < now - self.keep:
                self.said.removeKey((order,))

    def close(self) -> None:
        pass


def order_types(trades: DataFrame, received: DataFrame, delay: str = "10s", keep: str = "1d", buckets: int = BUCKETS) -> DataFrame:
    """trade_id, sequence, order_type of each trade of a stream, from the taker's latest earlier ``received`` message.

    trades: timestamp, trade_id, taker_order_id, sequence; received: timestamp, order_id,
    sequence, order_type. A trade comes out once the watermark (``delay`` behind the newest
    row) has passed it, with null where nothing was said; later messages of its time are
    late; a trade without a time never does. What was said of an order is forgotten ``keep``
    of event time after, so state is bounded by the orders of that span. Waiting trades are
    packed: a batch moves a few values a bucket to and from the store, not one a trade.
    """
    asks = trades.where("timestamp is not null").select("timestamp", F.col("taker_order_id").alias("order_id"), "sequence", "trade_id", F.lit(None).cast("string").alias("order_type"), F.lit(False).alias("received"))
    says = received.where("order_id is not null").select("timestamp", "order_id", "sequence", F.lit(None).cast("string").alias("trade_id"), "order_type", F.lit(True).alias("received"))
    rows = asks.unionByName(says).withColumn("micros", S.epoch_micros(F.col("timestamp"))).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    timed = rows.withWatermark("timestamp", f"interval {S.duration(delay)}")
    return _bucket(timed, F.coalesce("order_id", "trade_id"), buckets).groupBy("bucket").transformWithStateInPandas(
        _OrderTypes(S.duration_micros(keep)), "trade_id string, sequence long, order_type string", "Append", "EventTime")


# Level-3 orders -----------------------------------------------------------------------------

class _OrderLives(StatefulProcessor):
    """Price and open size of each living order of a bucket."""

    def __init__(self, kinds: str, keep_micros: int | None) -> None:
        self.kinds, self.keep = kinds, keep_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        order, price = self.kinds.split(",")
        self.handle, self.number = handle, int if price in ("bigint", "int", "smallint", "tinyint") else float
        self.living = handle.getMapState("living", f"order_id {order}", f"price {price}, size long, sequence long, micros long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        told, batch = [], _rows(rows, "sequence")
        for order, part in batch.groupby("order_id", sort=False):
            order = order.item() if hasattr(order, "item") else order
            alive = before = self.living.getValue((order,)) if self.living.containsKey((order,)) else None
            for sequence, kind, price, size, micros in zip(*(part[c].tolist() for c in ("sequence", "type", "price", "size", "micros"))):
                price = None if pd.isna(price) else self.number(price)  # a null makes a column of doubles
                if kind == "open":
                    alive = (price, int(size), sequence, micros)
                elif alive is None or sequence <= alive[2]:
                    continue
                elif kind in ("change", "match"):
                    alive = (alive[0], int(size) if kind == "change" else alive[1] - int(size), sequence, micros)
                ends = kind == "done" or (kind == "match" and alive[1] <= 0)
                stays = kind == "done" and price is None  # a finished market order names no price: its level stays
                told.append((order, sequence, kind, alive[0], 0 if ends and not stays else alive[1]))
                alive = None if ends else (*alive[:2], sequence, micros)
            if alive is not None:
                self.living.updateValue((order,), alive)
            elif before is not None:
                self.living.removeKey((order,))
        if self.keep is not None:
            self.handle.registerTimer((int(batch["micros"].max()) + self.keep) // 1000 + 1)
        frame = pd.DataFrame(told, columns=["order_id", "sequence", "type", "price", "remaining"])
        yield frame.assign(price=pd.Series([t[3] for t in told], dtype=object))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Orders of which nothing was said for the span before the watermark are forgotten."""
        least = timerValues.getCurrentWatermarkInMs() * 1000 - self.keep
        for (order,), (*_, micros) in [*self.living.iterator()]:
            if micros < least:
                self.living.removeKey((order,))
        return iter(())

    def close(self) -> None:
        pass


def order_transitions(events: DataFrame, keep: str = "7d", delay: str = "10s", buckets: int = BUCKETS) -> DataFrame:
    """order_id, sequence, type, price, remaining: every step of a known order's life, from a stream of order events.

    As ``operators.book.order_transitions`` on a table. Rows of an order must come in
    sequence from batch to batch (inside a batch they are sorted); a row at or before the
    last one of its life is left out. An order leaves the state when it is done or filled.
    Where events have a ``timestamp``, orders of which nothing was said for ``keep`` of event
    time leave as well, and rows behind the watermark are late.
    """
    kinds = ",".join(events.schema[c].dataType.simpleString() for c in ("order_id", "price"))
    order, price = kinds.split(",")
    timed = "timestamp" in events.columns
    rows = events.withColumn("micros", S.epoch_micros(F.col("timestamp")) if timed else F.lit(0).cast("long"))
    if timed:
        rows = rows.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", f"interval {S.duration(delay)}")
    return _bucket(rows, F.col("order_id"), buckets).groupBy("bucket").transformWithStateInPandas(
        _OrderLives(kinds, S.duration_micros(keep) if timed else None), f"order_id {order}, sequence long, type string, price {price}, remaining long", "Append", "EventTime" if timed else "none")


# Book levels --------------------------------------------------------------------------------

CHANGES = pa.schema([("exchange", pa.string()), ("symbol", pa.string()), ("side", pa.string()), ("bucket", pa.int64()), ("price", pa.float64()), ("reset", pa.bool_()), ("ignored", pa.bool_()), ("micros", pa.int64()), ("event_id", pa.int64()), ("amount", pa.float64())])
LEVEL = CHANGES.names[:7]
CHUNK = 200_000  # rows of a task that are reduced at a time


def _newest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The newest row of each level of a task: no older one of the same micro-batch changes a book.

    Memory holds one chunk and the levels seen. Marks and ignored rows stay apart from changes.
    """
    def reduced(parts: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(parts).sort_by([("micros", "ascending"), ("event_id", "ascending")])
        last = [(c, "last", pc.ScalarAggregateOptions(skip_nulls=False)) for c in CHANGES.names[7:]]
        return table.group_by(LEVEL, use_threads=False).aggregate(last).rename_columns(CHANGES.names).cast(CHANGES)

    kept, held = CHANGES.empty_table(), []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]).select(CHANGES.names).cast(CHANGES))
        if sum(map(len, held)) >= max(CHUNK, len(kept)):
            kept, held = reduced([kept, *held]), []
    yield from (reduced([kept, *held]) if held else kept).to_batches()


class _Levels(StatefulProcessor):
    """The standing levels of one side and bucket of a pair, and deletions that the watermark has not passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.levels = handle.getMapState("levels", "price double", "amount double, micros long, event_id long")
        self.reset = handle.getValueState("reset", "micros long, event_id long")
        self.dead = handle.getListState("dead", "price double, micros long, event_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _rows(rows, "micros", "event_id")
        changed: dict[float, tuple[float, int, int]] = {}
        since = self.reset.get() or (-1, -1)
        resets = batch[batch["reset"].to_numpy(bool)]
        if len(resets):
            newest = (int(resets["micros"].iloc[-1]), int(resets["event_id"].iloc[-1]))
            if newest > since:
                since = newest
                self.reset.update(since)
                for (price,), (amount, *at) in [*self.levels.iterator()]:
                    if tuple(at) < since and amount > 0:
                        changed[price] = (0.0, *since)
        rest = batch[~batch["reset"].to_numpy(bool) & (batch["amount"].to_numpy() >= 0)].drop_duplicates("price", keep="last")
        for price, amount, *at in zip(*(rest[c].tolist() for c in ("price", "amount", "micros", "event_id"))):
            if tuple(at) < since:
                continue
            known = self.levels.getValue((price,)) if self.levels.containsKey((price,)) else None
            if known is None or tuple(known[1:]) <= tuple(at):
                changed[price] = (amount, *at)
        deleted = []
        for price, level in changed.items():
            self.levels.updateValue((price,), level)
            if not level[0]:
                deleted.append((price, *level[1:]))
        if deleted:
            self.dead.appendList(deleted)
            self.handle.registerTimer(-(-min(d[1] for d in deleted) // 1000))
        side = dict(zip(("exchange", "symbol", "side"), key))
        if changed:
            prices, levels = list(changed), np.array([*changed.values()], object)
            yield pd.DataFrame({**{c: [v] * len(prices) for c, v in side.items()}, "price": prices, "amount": levels[:, 0].astype(float), "micros": levels[:, 1].astype(np.int64), "event_id": levels[:, 2].astype(np.int64)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Deletions up to the watermark are forgotten: no older row of their levels can come."""
        now = timerValues.getCurrentWatermarkInMs() * 1000
        dead = [*self.dead.get()] if self.dead.exists() else []
        for price, *at in (d for d in dead if d[1] <= now):
            if self.levels.containsKey((price,)):
                amount, *last = self.levels.getValue((price,))
                if not amount and last == at:
                    self.levels.removeKey((price,))
        later = [d for d in dead if d[1] > now]
        self.dead.put(later) if later else self.dead.clear()
        if later:
            self.handle.registerTimer(-(-min(d[1] for d in later) // 1000))
        return iter(())

    def close(self) -> None:
        pass


def book_levels(changes: DataFrame, snapshots: DataFrame | None = None, delay: str = "10s", buckets: int = 4) -> DataFrame:
    """exchange, symbol, side, price, amount, micros, event_id: every change of a level of a live book, amount 0 where it goes.

    changes: timestamp, event_id, exchange, symbol, side, price, amount; an amount of 0
    deletes the level, below 0 is ignored; the newest (timestamp, event_id) wins inside
    ``delay``, older rows are late. snapshots has the same columns, one row a level: the
    levels of one (timestamp, event_id) replace all older ones of the pair. State holds
    the standing levels, and deleted ones until the watermark has passed them. A level is one
    of ``buckets`` keys of its pair and side. Tasks send on only the newest row of each level,
    so shuffle and state take levels, not rows.
    """
    columns = ("timestamp", "event_id", "exchange", "symbol", "side", "price", "amount")
    own = F.pmod(F.xxhash64("price"), F.lit(buckets))
    rows = changes.select(*columns, F.lit(False).alias("reset"), own.alias("bucket"))
    if snapshots is not None:
        levels = snapshots.select(*columns, F.lit(False).alias("reset"), own.alias("bucket"))
        places = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(b).cast("long").alias("bucket")) for s in ("bid", "ask") for b in range(buckets)]))
        marks = snapshots.select("timestamp", "event_id", "exchange", "symbol", places.alias("at")).select(
            "timestamp", "event_id", "exchange", "symbol", "at.side", F.lit(0.0).alias("price"), F.lit(0.0).alias("amount"), F.lit(True).alias("reset"), "at.bucket")
        rows = rows.unionByName(levels).unionByName(marks)
    rows = rows.withColumns({"micros": S.epoch_micros(F.col("timestamp")), "ignored": ~F.col("reset") & F.coalesce((F.col("amount") < 0) | F.isnan("amount"), F.lit(True))})
    newest = rows.select(*CHANGES.names).mapInArrow(_newest, "exchange string, symbol string, side string, bucket long, price double, reset boolean, ignored boolean, micros long, event_id long, amount double")
    timed = newest.drop("ignored").withColumn("timestamp", F.timestamp_micros("micros")).withWatermark("timestamp", f"interval {S.duration(delay)}")
    return timed.groupBy("exchange", "symbol", "side", "bucket").transformWithStateInPandas(
        _Levels(), "exchange string, symbol string, side string, price double, amount double, micros long, event_id long", "Append", "EventTime")


# Sequence checks ----------------------------------------------------------------------------

class _Sequence(StatefulProcessor):
    """Last sequence of one pair and whether it waits for a snapshot after a gap."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long, blank boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _rows(rows, "event_id")
        top, blank = self.last.get() or (None, False)
        seq, snapshot = batch["seq"].to_numpy(np.int64), batch["snapshot"].to_numpy(bool)
        first = np.iinfo(np.int64).min if top is None else top
        before = np.maximum.accumulate(np.concatenate([[first], seq]))[:-1]
        stale = seq <= before
        gap = ~stale & (before != np.iinfo(np.int64).min) & (seq > before + 1) & ~snapshot
        # the last gap or snapshot up to each row says whether the pair is blank
        mark = np.where(gap | (~stale & snapshot), np.arange(len(seq)), -1)
        at = np.maximum.accumulate(mark)
        blanked = np.where(at >= 0, gap[at], blank)
        told = np.select([stale, gap, blanked], ["stale", "gap", "blank"], "ok")
        self.last.update((int(max(before[-1], seq[-1])), bool(blanked[-1])))
        yield pd.DataFrame({"symbol": key[0], "event_id": batch["event_id"], "seq": batch["seq"], "status": told})

    def close(self) -> None:
        pass


def sequenced(feed: DataFrame) -> DataFrame:
    """symbol, event_id, seq, status of every row of a stream (symbol, event_id, seq, snapshot).

    status: ``stale`` (not beyond the last sequence), ``gap`` (first row after a hole
    without being a snapshot), ``blank`` (after a gap, before the next snapshot), ``ok``.
    A snapshot ends the gap. Rows of a pair in one micro-batch are taken in arrival
    order, by running maxima over the whole batch; bound a batch with ``max_files``.
    """
    return feed.groupBy("symbol").transformWithStateInPandas(_Sequence(), "symbol string, event_id long, seq long, status string", "Append", "none")
