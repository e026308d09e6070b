"""Chat formatting: layouts are told by a fingerprint of their nested field paths, turned into canonical turns, and written in a template.

Everything is DataFrame expressions. A layout's fingerprint is the hash of its sorted field paths; ``MAPPINGS`` says, per layout, how its
fields become turns. Tables of turns are told by their schema; JSON records, and tables whose rows fill different columns, by each row, so
that one column or table may mix layouts. A conversation is one row; its turns meet in one task.

Template of a turn: ``### role: text</turn>`` and a line break. Inside roles and texts a backslash becomes ``\\b``, ``</turn`` becomes
``\\l/turn`` and ``### `` becomes ``\\h## `` (and in roles a colon becomes ``\\c``), so control strings occur as controls only, every
backslash begins one of these pairs, and reading back is exact. The loss mask lists the stretches of assistant texts by turn.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN_END, TURN_START = "</turn>\n", "### "
TURNS = "array<struct<role: string, text: string>>"


class Fields(NamedTuple):
    """How a mapping reads a record: a field's text by name, and a list field as structs of the two named fields."""

    text: Callable[[str], Column]
    items: Callable[[str, str, str], Column]


def json_fields(record: Column) -> Fields:
    def items(name: str, role: str, text: str) -> Column:
        return F.from_json(F.get_json_object(record, f"$.{name}"), f"array<struct<`{role}`: string, `{text}`: string>>")

    return Fields(lambda name: F.get_json_object(record, f"$.{name}"), items)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _pair(first: str, second: str) -> Callable[[Fields], Column]:
    return lambda r: F.array(_turn(F.lit("user"), r.text(first)), _turn(F.lit("assistant"), r.text(second)))


def _instruction(r: Fields) -> Column:
    more = F.coalesce(r.text("input"), F.lit(""))
    asked = F.concat(F.coalesce(r.text("instruction"), F.lit("")), F.when(more != "", F.concat(F.lit("\n\n"), more)).otherwise(""))
    return F.array(_turn(F.lit("user"), asked), _turn(F.lit("assistant"), r.text("output")))


def _list(field: str, role: str, text: str, names: dict[str, str] | None = None) -> Callable[[Fields], Column]:
    def turns(r: Fields) -> Column:
        other = F.create_map(*(F.lit(x) for pair in (names or {}).items() for x in pair)) if names else None
        named = lambda x: x[role] if other is None else F.coalesce(F.try_element_at(other, x[role]), x[role])
        return F.transform(r.items(field, role, text), lambda x: _turn(named(x), x[text]))

    return turns


#: What the speakers of ``conversations`` records are called in turns.
SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Layout: its field paths and how a record of it becomes turns. Callers may pass their own.
MAPPINGS: dict[str, tuple[tuple[str, ...], Callable[[Fields], Column]]] = {
    "prompt": (("prompt", "response"), _pair("prompt", "response")),
    "completion": (("prompt", "completion"), _pair("prompt", "completion")),
    "question": (("question", "answer"), _pair("question", "answer")),
    "instruction": (("instruction", "input", "output"), _instruction),
    "bare instruction": (("instruction", "output"), _instruction),
    "messages": (("messages[].role", "messages[].content"), _list("messages", "role", "content")),
    "conversations": (("conversations[].from", "conversations[].value"), _list("conversations", "from", "value", SPEAKERS)),
}
#: Layouts of typed tables: the paths of their columns, and the names of id, order, role and text.
TABLES: dict[str, tuple[tuple[str, ...], tuple[str, str, str, str]]] = {
    "turn rows": (("conv_id", "turn", "role", "text"), ("conv_id", "turn", "role", "text")),
    "message rows": (("conversation_id", "position", "speaker", "content"), ("conversation_id", "position", "speaker", "content")),
}


def paths_of(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a type; arrays add ``[]``."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths_of(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths_of(kind.elementType, f"{prefix}[]")
    return [prefix]


def fingerprint(paths: tuple[str, ...] | list[str]) -> int:
    """As ``xxhash64`` of Spark gives for the sorted paths joined by ``|``."""
    h = xxhash.xxh64_intdigest("|".join(sorted(paths)).encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def record_paths(record: Column, known: list[str]) -> Column:
    """Sorted field paths of a JSON record, to two levels, of those that any mapping knows; further fields don't disturb."""

    def of_key(k: Column) -> Column:
        inside = lambda path, sign: F.transform(F.json_object_keys(F.call_function("get_json_object", record, path)), lambda s: F.concat(k, F.lit(sign), s))
        at = F.concat(F.lit("$['"), k, F.lit("']"))
        return F.coalesce(inside(F.concat(at, F.lit("[0]")), "[]."), inside(at, "."), F.array(k))

    found = F.flatten(F.transform(F.json_object_keys(record), of_key))
    return F.array_sort(F.array_distinct(F.filter(found, lambda p: p.isin(known))))


def column_paths(table: DataFrame, known: list[str]) -> Column:
    """Sorted field paths of those columns that aren't null in a row, of the paths that any mapping knows."""
    held = []
    for f in table.schema.fields:
        own = [p for p in paths_of(f.dataType, f.name) if p in known]
        if own:
            held.append(F.when(F.col(f"`{f.name}`").isNotNull(), F.array(*map(F.lit, own))))
    return F.array_sort(F.flatten(F.array_compact(F.array(*held)))) if held else F.array().cast("array<string>")


def _converted(records: DataFrame, mappings: dict, paths: Callable[[list[str]], Column], fields: Fields, readable: Callable[[tuple[str, ...]], bool]) -> DataFrame:
    known = sorted({p for own, _ in mappings.values() for p in own})
    out = records.withColumn("fingerprint", F.xxhash64(F.array_join(paths(known), "|")))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for name, (own, convert) in mappings.items():
        if readable(own):
            hit = F.col("fingerprint") == fingerprint(own)
            layout, turns = F.when(hit, F.lit(name)).otherwise(layout), F.when(hit, convert(fields)).otherwise(turns)
    return out.withColumns({"layout": layout, "turns": turns})


def turns_of_records(records: DataFrame, column: str = "record", mappings: dict | None = None) -> DataFrame:
    """Adds ``layout``, ``fingerprint`` and ``turns`` (array of role and text) for JSON records of mixed layouts.

    Null, broken and unknown records have a null layout and null turns.
    """
    mappings = MAPPINGS if mappings is None else mappings
    return _converted(records, mappings, lambda known: record_paths(F.col(column), known), json_fields(F.col(column)), lambda own: True)


def turns_of_columns(table: DataFrame, mappings: dict | None = None) -> DataFrame:
    """The same for a table whose rows fill different columns: a row's fingerprint is that of its columns which aren't null.

    Columns that no mapping knows are ignored; ``layout``, ``fingerprint`` and ``turns`` replace any columns of these names.
    """
    mappings = MAPPINGS if mappings is None else mappings
    table = table.drop("layout", "fingerprint", "turns")
    held = {p for f in table.schema.fields for p in paths_of(f.dataType, f.name)}
    return _converted(table, mappings, lambda known: column_paths(table, known), Fields(F.col, lambda name, role, text: F.col(name)), lambda own: held.issuperset(own))


def turn_rows(table: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of a typed table whose fingerprint is one of ``TABLES``; columns that no layout knows are ignored."""
    known = {p for paths, _ in TABLES.values() for p in paths}
    mine = fingerprint([p for p in paths_of(table.schema) if p in known])
    for paths, names in TABLES.values():
        if fingerprint(paths) == mine:
            return table.select(*(F.col(a).alias(b) for a, b in zip(names, ("conv_id", "turn", "role", "text"), strict=True)))
    raise ValueError(f"no mapping for fields {paths_of(table.schema)}")


def escaped(c: Column) -> Column:
    for a, b in (("\\", "\\b"), ("</turn", "\\l/turn"), ("### ", "\\h## ")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescaped(c: Column) -> Column:
    for a, b in (("\\l", "<"), ("\\h", "#"), ("\\c", ":"), ("\\b", "\\")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def gathered(rows: DataFrame) -> DataFrame:
    """``conv_id, turns`` of any table that :func:`turn_rows` reads, one row a conversation.

    Turns go by number, then role, then text; a null number comes first, repeated rows stay. A null text or role is empty. Rows without
    ``conv_id`` are left out.
    """
    rows = turn_rows(rows).where("conv_id is not null").withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return rows.groupBy("conv_id").agg(ordered.alias("turns")).select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def records_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns`` as records of mixed layouts: each fills the columns of one of ``MAPPINGS`` and leaves the others null.

    A question with its answer takes one of five layouts by a hash of its ``conv_id``, and any other conversation one of the two with
    lists. Roles that the list of ``conversations`` would rename are kept in ``messages``. Every record converts back to its turns.
    """
    roles, text = F.transform("turns", lambda t: t["role"]), lambda i: F.try_element_at("turns", F.lit(i))["text"]
    names = F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"))
    deal = F.pmod(F.xxhash64("conv_id"), F.lit(6))
    pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    kind = F.when(pair & (deal < 5), F.element_at(F.array(*map(F.lit, ("prompt", "completion", "question", "instruction", "bare"))), (deal + 1).cast("int")))
    kind = F.coalesce(kind, F.when(F.exists(roles, lambda r: r.isin(*SPEAKERS)) | (deal % 2 == 0), "messages").otherwise("conversations"))
    told = conversations.select("conv_id", "turns", kind.alias("kind"), text(1).alias("asked"), text(2).alias("said"))
    cut = F.instr("asked", "\n\n")  # what follows the first empty line is the input of an instruction
    split = (F.col("kind") == "instruction") & (cut > 0) & (F.length("asked") > cut + 1)
    only = lambda kinds, c: F.when(F.col("kind").isin(*kinds), c)
    listed = lambda role, words, renamed: F.transform("turns", lambda t: F.struct((F.coalesce(F.try_element_at(names, t["role"]), t["role"]) if renamed else t["role"]).alias(role), t["text"].alias(words)))
    return told.select(
        "conv_id",
        only(["prompt", "completion"], F.col("asked")).alias("prompt"),
        only(["prompt"], F.col("said")).alias("response"),
        only(["completion"], F.col("said")).alias("completion"),
        only(["question"], F.col("asked")).alias("question"),
        only(["question"], F.col("said")).alias("answer"),
        only(["instruction", "bare"], F.when(split, F.substring("asked", F.lit(1), cut - 1)).otherwise(F.col("asked"))).alias("instruction"),
        F.when(split, F.substring("asked", cut + 2, F.length("asked"))).alias("input"),
        only(["instruction", "bare"], F.col("said")).alias("output"),
        only(["messages"], listed("role", "content", False)).alias("messages"),
        only(["conversations"], listed("from", "value", True)).alias("conversations"),
    )


def format_turns(table: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_mask`` of ``table(conv_id, turns)``; null turns, as of records that no mapping knows, give null.

    ``loss_mask`` has ``turn, start, length`` in code points for each assistant text, counted from 0 within the turn's formatted stretch.
    """

    def written(t: Column, i: Column) -> Column:
        head = F.concat(F.lit(TURN_START), F.replace(escaped(t["role"]), F.lit(":"), F.lit("\\c")), F.lit(": "))
        return F.struct(i.alias("at"), t["role"].alias("role"), head.alias("head"), escaped(t["text"]).alias("body"))

    parts = table.select("conv_id", F.transform("turns", written).alias("parts"))
    formatted = F.array_join(F.transform("parts", lambda t: F.concat(t["head"], t["body"], F.lit(TURN_END))), "")
    mask = F.transform(F.filter("parts", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["at"].alias("turn"), F.length(t["head"]).alias("start"), F.length(t["body"]).alias("length")))
    return parts.select("conv_id", formatted.alias("formatted"), mask.alias("loss_mask"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """:func:`format_turns` for any table of turns that :func:`gathered` takes; an empty table gives an empty table."""
    return format_turns(gathered(rows))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds to formatted conversations ``turns`` (role, text) and ``loss_texts``, both read from ``formatted`` and ``loss_mask`` alone."""
    parts = F.split("formatted", TURN_END)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    out = formatted.withColumn("parts", parts)
    start = len(TURN_START)

    def turn(p: Column) -> Column:
        colon = F.instr(p, ": ")
        return F.struct(unescaped(F.substring(p, F.lit(start + 1), colon - (start + 1))).alias("role"), unescaped(F.substring(p, colon + 2, F.length(p))).alias("text"))

    out = out.withColumn("turns", F.transform("parts", turn))
    taken = F.transform("loss_mask", lambda m: unescaped(F.substring(F.element_at("parts", m["turn"] + 1), m["start"] + 1, m["length"])))
    return out.withColumn("loss_texts", taken).drop("parts")


def digests(rows: DataFrame) -> DataFrame:
    """Per conversation: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read back from the output.

    The conversations become records of mixed layouts first, so each is told by its own fingerprint and converted by its mapping.
    """
    read = read_back(format_turns(turns_of_columns(records_of(gathered(rows)))))
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
