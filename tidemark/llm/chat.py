"""Chat formatting by schema fingerprint. DataFrame and SQL functions only.

A record's layout is recognised by a hash of its nested field paths. Each known
hash selects a declarative mapping (SQL expressions) to canonical turns
``conv_id, turn, role, text``; canonical turns are then rendered with one
template whose control strings cannot occur inside a text.

Defined results
- null text or role: the empty string; null conv_id: one conversation of its own
- turns are ordered by (turn, role, text), so ties and repeated rows keep every
  row in a fixed order; null turn numbers come first
- an empty table gives an empty table
- extra columns in a layout change its fingerprint only if they are selected;
  ``rows_to_turns`` picks its four columns and ignores the rest
- records whose layout has no mapping come back from ``unmapped``, never lost
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "### ", "</turn>\n"
#: Escapes leave no "<", "#" in a text, so neither control string can occur there.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "\\n"))
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(dtype: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a type, e.g. ``messages[].role``."""
    if isinstance(dtype, T.StructType):
        return [p for f in dtype.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(dtype, T.ArrayType):
        return field_paths(dtype.elementType, f"{prefix}[]")
    return [prefix]


def fingerprint(paths: list[str]) -> str:
    """Hash of the sorted field paths; neither column order nor types matter."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """A layout: its field paths, a parse schema, and an SQL expression for its turns."""

    name: str
    paths: tuple[str, ...]
    schema: str
    turns: str  # {at}: prefix of the layout's fields

    @property
    def key(self) -> str:
        return fingerprint(list(self.paths))

    @property
    def shape(self) -> str:
        """What ``record_shape`` gives for a record in this layout."""
        return hashlib.sha256(_shape(T.StructType.fromDDL(self.schema)).encode()).hexdigest()[:16]


def _shape(dtype: T.DataType) -> str:
    """A variant's schema text without scalar types; variants list fields by name."""
    if isinstance(dtype, T.StructType):
        inner = ((f.name, f.dataType) for f in sorted(dtype.fields, key=lambda f: f.name))
        return "OBJECT<" + ", ".join(n + (f": {_shape(t)}" if isinstance(t, (T.StructType, T.ArrayType)) else "") for n, t in inner) + ">"
    return f"ARRAY<{_shape(dtype.elementType)}>"


def _turn(role: str, text: str) -> str:
    return f"named_struct('role', {role}, 'text', {text})"


def _ask_answer(ask: str, answer: str) -> str:
    return f"array({_turn("'user'", ask)}, {_turn("'assistant'", answer)})"


MAPPINGS = (
    Mapping("prompt", ("prompt", "response"), "prompt string, response string",
            _ask_answer("{at}prompt", "{at}response")),
    Mapping("completion", ("prompt", "completion"), "prompt string, completion string",
            _ask_answer("{at}prompt", "{at}completion")),
    Mapping("instruction", ("instruction", "output"), "instruction string, output string",
            _ask_answer("{at}instruction", "{at}output")),
    Mapping("instruction_input", ("instruction", "input", "output"), "instruction string, input string, output string",
            _ask_answer("concat_ws('\\n', {at}instruction, nullif({at}input, ''))", "{at}output")),
    Mapping("messages", ("messages[].role", "messages[].content"), "messages array<struct<role:string,content:string>>",
            f"transform({{at}}messages, m -> {_turn('m.role', 'm.content')})"),
    Mapping("shares", ("conversations[].from", "conversations[].value"), "conversations array<struct<from:string,value:string>>",
            f"transform({{at}}conversations, m -> {_turn('m.`from`', 'm.value')})"),
)
#: One row for each turn; it needs no nested mapping.
ROW_LAYOUT = fingerprint(["conv_id", "turn", "role", "text"])


def canonical_role(role: Column) -> Column:
    role = F.coalesce(role, F.lit(""))
    known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(role)), role)


def _explode(df: DataFrame, turns: Column) -> DataFrame:
    return df.select("conv_id", F.posexplode_outer(turns).alias("turn", "t")).where("turn is not null").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), canonical_role(F.col("t.role")).alias("role"), F.col("t.text").alias("text"))


def rows_to_turns(df: DataFrame) -> DataFrame:
    """Canonical turns from a table with one row for each turn, whose roles are kept as they are."""
    return df.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), "text")


def table_to_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Canonical turns from a typed table, whose schema's fingerprint selects the mapping."""
    body = [f for f in df.schema.fields if f.name != id_col]
    if fingerprint(["conv_id", *field_paths(T.StructType(body))]) == ROW_LAYOUT:
        return rows_to_turns(df.withColumnRenamed(id_col, "conv_id"))
    key = fingerprint(field_paths(T.StructType(body)))
    for m in MAPPINGS:
        if m.key == key:
            return _explode(df.withColumnRenamed(id_col, "conv_id"), F.expr(m.turns.replace("{at}", "")))
    raise ValueError(f"no mapping for the layout {key}: {sorted(field_paths(T.StructType(body)))}")


def record_shape(payload: Column) -> Column:
    """Each record's own layout: its schema with scalar types removed, hashed.

    Variant schemas list fields by name, so equal layouts have equal strings.
    """
    text = F.schema_of_variant(F.try_parse_json(payload))
    return F.substring(F.sha2(F.regexp_replace(text, r": (?!ARRAY|OBJECT)[A-Z]+(\([0-9,]+\))?", ""), 256), 1, 16)


def records_to_turns(df: DataFrame, id_col: str = "conv_id", payload: str = "payload") -> DataFrame:
    """Canonical turns from JSON records of mixed layouts, one record a row.

    Every row selects its mapping by its own fingerprint.
    """
    keyed = df.select(F.col(id_col).alias("conv_id"), F.col(payload).alias("payload"), record_shape(F.col(payload)).alias("shape"))
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for m in MAPPINGS:
        mine = F.col("shape") == m.shape
        keyed = keyed.withColumn(f"as_{m.name}", F.when(mine, F.from_json("payload", m.schema)))
        turns = F.when(mine, F.expr(m.turns.replace("{at}", f"as_{m.name}."))).otherwise(turns)
    return _explode(keyed.withColumn("turns", turns), F.col("turns"))


def unmapped(df: DataFrame, payload: str = "payload") -> DataFrame:
    """The records of no known layout, unparsable ones included."""
    known = [m.shape for m in MAPPINGS]
    return df.where(~F.coalesce(record_shape(F.col(payload)).isin(known), F.lit(False)))


def _replace(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column, pairs: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    return _replace(F.coalesce(text, F.lit("")), pairs)


def unescape(text: Column, pairs: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    """Exact inverse of ``escape``: a backslash is always followed by a code letter."""
    return _replace(text, tuple((new, old) for old, new in reversed(pairs)))


def format_turns(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss: one row for each conversation.

    ``loss`` has one (start, length) for each turn, in code points of ``formatted``;
    length 0 where the turn takes no part in the loss. Rendering and offsets are
    per turn; only the finished segments of a conversation meet.
    """
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    head = F.concat(F.lit(OPEN), escape(F.col("role"), ROLE_ESCAPES), F.lit("\n"))
    body = escape(F.col("text"))
    segments = (
        turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
        .withColumns({"head": head, "body": body})
        .select("conv_id", F.row_number().over(by).alias("n"), F.concat("head", "body", F.lit(CLOSE)).alias("segment"),
                F.char_length("head").cast("long").alias("head_chars"),
                F.when(F.col("role") == loss_role, F.char_length("body")).otherwise(0).cast("long").alias("loss_chars"),
                F.coalesce(F.sum(F.char_length(F.concat("head", "body", F.lit(CLOSE)))).over(before), F.lit(0)).cast("long").alias("at"))
    )
    whole = segments.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "segment", (F.col("at") + F.col("head_chars")).alias("start"), F.col("loss_chars").alias("length")))).alias("parts"))
    return whole.select("conv_id", F.array_join(F.col("parts.segment"), "").alias("formatted"),
                        F.transform("parts", lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"))).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted_chars, n, role, text, loss_text: turns parsed from formatted conversations."""
    pieces = F.slice(F.split("formatted", CLOSE), 1, F.size(F.split("formatted", CLOSE)) - 1)
    rows = formatted.select("conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"), F.posexplode(F.arrays_zip(pieces.alias("piece"), F.col("loss"))).alias("n", "z")).select(
        "conv_id", "formatted_chars", "n", F.col("z.piece").alias("piece"), F.col("z.loss.start").alias("start"), F.col("z.loss.length").alias("length"))
    before = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.char_length("piece") + len(CLOSE)).over(before), F.lit(0))
    cut = F.locate("\n", F.col("piece"))
    return rows.withColumns({"at": at, "cut": cut}).select(
        "conv_id", "formatted_chars", "n",
        unescape(F.expr(f"substring(piece, {len(OPEN) + 1}, cut - {len(OPEN) + 1})"), ROLE_ESCAPES).alias("role"),
        unescape(F.expr("substring(piece, cut + 1)")).alias("text"),
        unescape(F.expr("substring(piece, cast(start - at + 1 as int), cast(length as int))")).alias("loss_text"))


def digests(formatted: DataFrame) -> DataFrame:
    """Digest columns, all read back from the formatted text and its loss mask."""
    turns = read_back(formatted).groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("n", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("turn"), "loss_text"))).alias("p"),
        F.sum(F.char_length("loss_text")).cast("long").alias("loss_chars"),
        F.max("formatted_chars").alias("formatted_chars"))
    return turns.select("conv_id", "n_turns", F.sha2(F.array_join("p.turn", ""), 256).alias("turns_sha256"),
                        "loss_chars", F.sha2(F.array_join("p.loss_text", ""), 256).alias("loss_sha256"), "formatted_chars")
