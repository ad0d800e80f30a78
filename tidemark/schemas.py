"""Schemas of the stored tables."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_TIME, _TEXT, _LONG, _DOUBLE = T.TimestampNTZType(), T.StringType(), T.LongType(), T.DoubleType()
_MATRIX = T.ArrayType(T.ArrayType(_DOUBLE))

TRADES = _struct(timestamp=_TIME, exchange=_TEXT, symbol=_TEXT, price=_DOUBLE, size=_DOUBLE, side=_TEXT, trade_id=_TEXT)
ORDERBOOKS = _struct(timestamp=_TIME, exchange=_TEXT, symbol=_TEXT, bids=_MATRIX, asks=_MATRIX)
LEDGER = _struct(txn_id=_LONG, row_count=_LONG, min_ts=_TIME, max_ts=_TIME)
EVENTS = _struct(event_id=_LONG, ts=_TIME, user_id=_LONG, event_type=_TEXT, value=_DOUBLE, props=_TEXT)
EXCHANGES = ("COINBASE", "BITSTAMP", "KRAKEN")
SYMBOLS = ("BTC-USD", "ETH-USD", "AVAX-USD", "SOL-USD")
