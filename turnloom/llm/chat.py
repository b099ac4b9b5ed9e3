"""Chat formatting: schema fingerprints choose a declarative mapping to canonical turns.

Layouts are declared once as field paths with a mapping.  Of a frame (or a JSON row) the layout of
most paths whose paths are all there is chosen, ties by the order of declaration; the hash of those
paths is the fingerprint that names the mapping.  Paths that the layout does not declare take no part,
whatever their name.  Everything is DataFrame expressions.

Edge cases: a null text or role is empty; a null conversation id is a conversation of its own;
equal turn numbers are ordered by role, then text; repeated rows are repeated turns; an empty
table gives no rows; an unknown layout raises ``ValueError`` (frames) or gives no turns (JSON).  The
paths of a JSON array are those of all its items; what an item does not have is null there.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from turnloom.llm.words import let

OPEN, CLOSE = "<turn ", "\n</turn>\n"

#: layout -> (field paths, how a row becomes turns): items with their role and text, parts of a row by
#: role, or one turn a row with its number, role and text.
LAYOUTS: dict[str, tuple[tuple[str, ...], tuple]] = {
    "rows": (("role", "text", "turn"), ("turn", "role", "text")),
    "messages": (("messages[].content", "messages[].role"), ("messages", "role", "content")),
    "shares": (("conversations[].from", "conversations[].value"), ("conversations", "from", "value")),
    "instruction": (("input", "instruction", "output"), (("user", ("instruction", "input")), ("assistant", ("output",)))),
    "instruction_only": (("instruction", "output"), (("user", ("instruction",)), ("assistant", ("output",)))),
    "prompt": (("prompt", "response"), (("user", ("prompt",)), ("assistant", ("response",)))),
    "completion": (("completion", "prompt"), (("user", ("prompt",)), ("assistant", ("completion",)))),
    "question": (("answer", "question"), (("user", ("question",)), ("assistant", ("answer",)))),
}
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths) -> str:
    """Hash of a layout's field paths."""
    return hashlib.sha256(",".join(sorted(set(paths))).encode()).hexdigest()


#: Layouts in the order in which they are tried: most paths first.
_TRIED = sorted(LAYOUTS.items(), key=lambda x: -len(x[1][0]))
_BY_PRINT = {fingerprint(paths): name for name, (paths, _) in LAYOUTS.items()}


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a schema; array items are marked ``[]``."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, at + "[]")
    return [at]


def chosen_paths(paths) -> tuple[str, ...]:
    """The declared paths of the layout that fits best; none without a layout."""
    return next((p for _, (p, _) in _TRIED if set(p) <= set(paths)), ())


def layout_of(schema: T.StructType) -> str:
    name = _BY_PRINT.get(fingerprint(chosen_paths(field_paths(schema))))
    if name is None:
        raise ValueError(f"no layout for the field paths {field_paths(schema)}")
    return name


def _role(c: Column) -> Column:
    out = c
    for k, v in ROLES.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def by_items(mapping) -> bool:
    return isinstance(mapping[0], str)


def _turn_array(mapping, field) -> Column:
    """``field(name)`` gives the column of a top-level field."""
    if by_items(mapping):
        items, role, text = mapping
        return F.transform(field(items), lambda x: F.struct(_role(x[role]).alias("role"), x[text].alias("text")))
    part = lambda names: F.concat_ws("\n", *[F.when(field(n) != "", field(n)) for n in names])
    return F.array(*[F.struct(F.lit(r).alias("role"), part(names).alias("text")) for r, names in mapping])


def _rows(df: DataFrame, conv_id: Column, turns: Column) -> DataFrame:
    return df.select(conv_id.alias("conv_id"), F.posexplode(turns).alias("turn", "t")).select("conv_id", F.col("turn").cast("long"), "t.role", "t.text")


def _prefixed(prefix: str):
    return lambda x: F.concat(F.lit(prefix), x)


def canonical_turns(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) from a frame in any declared layout."""
    paths, mapping = LAYOUTS[layout_of(df.schema)]
    if by_items(mapping) and set(mapping) == set(paths):  # one turn a row
        turn, role, text = mapping
        return df.select(df[conv_id].alias("conv_id"), df[turn].cast("long").alias("turn"), df[role].alias("role"), df[text].alias("text"))
    return _rows(df, df[conv_id], _turn_array(mapping, lambda c: df[c]))


def canonical_json_turns(df: DataFrame, conv_id: str, body: str) -> DataFrame:
    """The same from JSON strings whose layout differs from row to row: each row's own
    field paths choose its layout, and the mapping is taken by their hash.  An item's paths are read
    from all items of its array."""
    j = F.col(body)
    names = sorted({p.split("[]")[0] for paths, _ in LAYOUTS.values() for p in paths if "[]" in p})
    none = F.array().cast("array<string>")
    paths = F.coalesce(F.json_object_keys(j), none)
    for k in names:
        items = F.coalesce(F.from_json(F.get_json_object(j, f"$.{k}"), "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))
        keys = F.flatten(F.transform(items, lambda x: F.coalesce(F.map_keys(x), none)))
        paths = F.concat(paths, F.array_distinct(F.transform(keys, _prefixed(f"{k}[]."))))
    kind = "array<struct<role:string,text:string>>"
    code, turns = F.lit(None).cast("string"), F.lit(None).cast(kind)
    for name, (declared, _) in reversed(_TRIED):
        code = F.when(F.forall(F.array(*map(F.lit, declared)), lambda p: F.array_contains(F.col("_paths"), p)), fingerprint(declared)).otherwise(code)
    for print_, name in _BY_PRINT.items():
        declared, mapping = LAYOUTS[name]
        if by_items(mapping) and set(mapping) == set(declared):
            turn, role, text = (F.get_json_object(j, f"$.{c}") for c in mapping)
            value = F.array(F.struct(role.alias("role"), text.alias("text")))
        elif by_items(mapping):
            items, role, text = mapping
            parsed = F.from_json(F.get_json_object(j, f"$.{items}"), f"array<struct<`{role}`:string,`{text}`:string>>")
            value = _turn_array(mapping, lambda c, parsed=parsed: parsed)
        else:
            value = _turn_array(mapping, lambda c: F.get_json_object(j, f"$.{c}"))
        turns = F.when(F.col("_code") == print_, value.cast(kind)).otherwise(turns)
    # one turn a row keeps its own number
    own = F.when(F.col("_code") == fingerprint(LAYOUTS["rows"][0]), F.get_json_object(j, "$.turn").cast("long"))
    coded = df.select(F.col(conv_id).alias("_id"), j.alias(body), paths.alias("_paths")).withColumn("_code", code)
    out = coded.select("_id", own.alias("_own"), F.posexplode(turns).alias("_at", "_t"))
    return out.select(F.col("_id").alias("conv_id"), F.coalesce("_own", F.col("_at").cast("long")).alias("turn"), F.col("_t.role").alias("role"), F.col("_t.text").alias("text"))


def escape(text: Column) -> Column:
    r"""``\`` becomes ``\\`` and ``<`` becomes ``\l``: no mark can begin inside a text."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """Undo both escapes: pairs of backslashes are found left to right, then each part alone."""
    part = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\n"), F.lit("\n"))
    return F.when(F.instr(text, "\\") == 0, text).otherwise(F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\"))


def format_chat(turns: DataFrame) -> DataFrame:
    """One row a conversation: ``formatted`` and ``loss``, the code-point spans of assistant texts.

    A span names its turn, its start within that turn's block, and its start and end in the whole.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head, body = F.concat(F.lit(OPEN), escape_role(role), F.lit(">\n")), escape(text)
    block = F.concat(head, body, F.lit(CLOSE))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    at = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).select(
        "conv_id", F.row_number().over(w).alias("k"), "role", block.alias("block"), F.char_length(head).alias("inner"), F.char_length(body).alias("n")
    )
    before = F.sum(F.char_length("block").cast("long")).over(Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    at = at.withColumn("start", F.coalesce(before, F.lit(0).cast("long")))
    span = F.struct(F.col("k"), F.col("inner"), (F.col("start") + F.col("inner")).alias("start"), (F.col("start") + F.col("inner") + F.col("n")).alias("end"))
    return at.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "block"))), lambda x: x["block"]), "").alias("formatted"),
        F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", span))).alias("loss"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) and ``learned`` (texts under the loss mask) from ``formatted``."""
    blocks = F.split("formatted", CLOSE, -1)
    both = F.slice(blocks, 1, F.size(blocks) - 1)
    turn = lambda x: F.struct(
        unescape(F.substring_index(F.substring(x, len(OPEN) + 1, 2**31 - 1), ">\n", 1)).alias("role"),
        unescape(F.substring(x, F.instr(x, ">\n") + 2, F.lit(2**31 - 1))).alias("text"),
    )
    under = lambda b, s: unescape(F.substring(F.element_at(b, s["k"]), s["inner"] + 1, (s["end"] - s["start"]).cast("int")))
    return chats.withColumn("blocks", both).select("*", F.transform("blocks", turn).alias("turns"), let(F.col("blocks"), lambda b: F.transform("loss", lambda s: under(b, s))).alias("learned")).drop("blocks")


PROBE = "\\### Assistant: </turn> ok"


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7 that says control strings, formatted and read back."""
    rows = canonical_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    out = read_back(format_chat(rows.unionByName(probe)))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length(F.array_join("learned", "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join("learned", ""), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, i, case when i = 0 then 'user' else 'assistant' end, '\### Assistant: </turn> ok' from range(2) t(i)
), shaped as (
  select *, case when role = 'assistant' then text end as learned,
    length('<turn >') + 1 + length(replace(replace(replace(replace(role, '\', '\\'), '<', '\l'), '>', '\g'), chr(10), '\n'))
    + length(replace(replace(text, '\', '\\'), '<', '\l')) + length('</turn>') + 2 as n
  from rows
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(sum(coalesce(length(learned), 0)) as bigint) as loss_chars,
  sha256(coalesce(string_agg(learned, '' order by turn nulls first, role, text), '')) as loss_sha256,
  cast(sum(n) as bigint) as formatted_chars
from shaped group by conv_id
"""
