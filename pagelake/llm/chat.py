"""Chat formatting with DataFrame functions only.

A record's layout is told by a fingerprint, the SHA-256 of its nested field paths. A registry maps fingerprints
to declarative mappings; each mapping says which paths make which turns. Paths that a mapping doesn't own (ids, dates,
other texts) don't count for it, so further fields never hide a layout; of several layouts that a record has, tables with
a row a turn come first, then lists of turns, then those of most fields. A list without elements has no layout.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"
#: Role names that other layouts use, and ours.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


def paths_of(schema: T.StructType, prefix: str = "") -> list[str]:
    """Nested field paths of a schema, in order of name; [] marks the elements of an array."""
    out = []
    for f in sorted(schema.fields, key=lambda f: f.name):
        kind, path = f.dataType, prefix + f.name
        while isinstance(kind, T.ArrayType):
            kind, path = kind.elementType, path + "[]"
        out += paths_of(kind, path + ".") if isinstance(kind, T.StructType) else [path]
    return out


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(paths).encode()).hexdigest()


@dataclass(frozen=True)
class Mapping:
    """paths: the record's fields. One of: fixed, (role, fields joined by a blank line) a turn; listed, (array, role,
    text); rows, (key, order, role, text) of a table that has a row a turn and keeps its role names."""

    paths: tuple[str, ...]
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    listed: tuple[str, str, str] | None = None
    rows: tuple[str, str, str, str] | None = None

    @property
    def key(self) -> str:
        return fingerprint(sorted(self.paths))


MAPPINGS = (
    Mapping(("prompt", "response"), (("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping(("prompt", "completion"), (("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping(("prompt", "response", "system"), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping(("answer", "question"), (("user", ("question",)), ("assistant", ("answer",)))),
    Mapping(("instruction", "output"), (("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping(("input", "instruction", "output"), (("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping(("messages[].content", "messages[].role"), listed=("messages", "role", "content")),
    Mapping(("messages[].role", "messages[].text"), listed=("messages", "role", "text")),
    Mapping(("conversations[].from", "conversations[].value"), listed=("conversations", "from", "value")),
    Mapping(("conv_id", "role", "text", "turn"), rows=("conv_id", "turn", "role", "text")),
    Mapping(("instruction", "output", "system"), (("system", ("system",)), ("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping(("input", "instruction", "output", "system"), (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping(("answer", "question", "system"), (("system", ("system",)), ("user", ("question",)), ("assistant", ("answer",)))),
)
#: In order of precedence.
RANKED = tuple(sorted(MAPPINGS, key=lambda m: (m.rows is None, m.listed is None, -len(m.paths))))
FIELDS = tuple(sorted({p for m in MAPPINGS for p in m.paths}))


def _role(role: Column) -> Column:
    out = role
    for theirs, ours in ROLES.items():
        out = F.when(role == theirs, ours).otherwise(out)
    return F.coalesce(out, F.lit(""))


def _fixed(mapping: Mapping, field) -> Column:
    turn = lambda role, names: F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*[F.coalesce(field(n), F.lit("")) for n in names]), lambda x: x != ""), "\n\n").alias("text"))
    return F.array(*[turn(role, names) for role, names in mapping.fixed]).cast(TURNS)


def _turn(role: str, text: str):
    return lambda x: F.struct(_role(x[role]).alias("role"), F.coalesce(x[text], F.lit("")).alias("text"))


def mapping_of(schema: T.StructType) -> Mapping:
    """The first mapping whose fingerprint the schema's paths give, as far as it owns them."""
    paths = paths_of(schema)
    for m in RANKED:
        if fingerprint([p for p in paths if p in m.paths]) == m.key:
            return m
    raise ValueError(f"no mapping for the fields {paths}")


def table_turns(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turn, role, text of a table in any mapped layout; its fingerprint comes from its schema, once.

    Null fields are empty texts, a null or empty list has no turns; rows are taken as they are, repeated ones and those
    without a key too. Further columns are ignored, whatever their names; an empty table gives no turns.
    """
    m = mapping_of(df.schema)
    if m.rows is not None:
        return df.select(*[F.col(c).alias(n) for c, n in zip(m.rows, (key, "turn", "role", "text"), strict=True)])
    if m.listed is None:
        turns = _fixed(m, lambda n: F.col(n).cast("string"))
    else:
        array, role, text = m.listed
        turns = F.transform(F.coalesce(F.col(array), F.array()), _turn(role, text)).cast(TURNS)
    return df.select(key, F.posexplode(turns).alias("turn", "said")).select(key, F.col("turn").cast("long").alias("turn"), "said.role", "said.text")


def json_paths(record: Column) -> Column:
    """Sorted field paths of one parsed record, down to fields of array elements: the input of its fingerprint."""
    keys = lambda v: F.coalesce(F.map_keys(v.try_cast("map<string,variant>")), F.array().cast("array<string>"))
    inner = lambda k: F.flatten(F.transform(F.coalesce(record.try_cast("map<string,variant>")[k].try_cast("array<variant>"), F.array().cast("array<variant>")), keys))
    paths = F.flatten(F.transform(keys(record), lambda k: F.when(F.size(inner(k)) > 0, F.transform(inner(k), lambda x: F.concat(k, F.lit("[]."), x))).otherwise(F.array(k))))
    return F.array_sort(F.array_intersect(paths, F.array(*[F.lit(f) for f in FIELDS])))


def json_unused(text: Column) -> Column:
    """Sorted paths of a record's texts that its mapping doesn't take: of the record, and one level inside its objects and lists.

    All of them where no mapping fits; null if the text is no JSON object. What is reported here isn't in the turns.
    """
    record = F.try_parse_json(text)
    fields = lambda v: v.try_cast("map<string,variant>")
    said = lambda v: (F.schema_of_variant(v) == "STRING") & (F.trim(F.coalesce(v.try_cast("string"), F.lit(""))) != "")
    none = F.array().cast("array<variant>")
    named = lambda m, k, sep: F.transform(F.filter(F.map_keys(m), lambda x: said(m[x])), lambda x: F.concat(k, F.lit(sep), x))
    listed = lambda v, k: F.flatten(F.transform(F.coalesce(v.try_cast("array<variant>"), none), lambda e: F.when(said(e), F.array(F.concat(k, F.lit("[]")))).otherwise(F.coalesce(named(fields(e), k, "[]."), F.array().cast("array<string>")))))
    every = lambda v, k: F.when(said(v), F.array(k)).otherwise(F.concat(F.coalesce(named(fields(v), k, "."), F.array().cast("array<string>")), listed(v, k)))
    top = fields(record)
    found = F.array_distinct(F.flatten(F.transform(F.map_keys(top), lambda k: every(top[k], k))))
    taken = F.array().cast("array<string>")
    for m in reversed([m for m in RANKED if m.rows is None]):
        taken = F.when(F.size(F.array_intersect(json_paths(record), F.array(*map(F.lit, m.paths)))) == len(m.paths), F.array(*map(F.lit, m.paths))).otherwise(taken)
    return F.array_sort(F.array_except(found, taken))


def json_turns(text: Column) -> tuple[Column, Column]:
    """(fingerprint, turns) of a JSON text, each row by its own layout; turns are null if none maps it or it is no JSON.

    Texts that the mapping doesn't own are left out; json_unused names them.
    The fingerprint is the chosen mapping's, else that of all known paths. Null fields are empty texts; a list without
    elements has no layout, so its turns are null too.
    """
    record = F.try_parse_json(text)
    paths = json_paths(record)
    key, turns = F.sha2(F.array_join(paths, "\n"), 256), F.lit(None).cast(TURNS)
    for m in reversed([m for m in RANKED if m.rows is None]):
        owned = F.sha2(F.array_join(F.array_sort(F.array_intersect(paths, F.array(*[F.lit(p) for p in m.paths]))), "\n"), 256)
        if m.listed is None:
            made = _fixed(m, lambda n: F.try_variant_get(record, f"$.{n}", "string"))
        else:
            array, role, said = m.listed
            made = F.transform(F.try_variant_get(record, f"$.{array}", "array<map<string,string>>"), _turn(role, said)).cast(TURNS)
        key, turns = F.when(owned == m.key, F.lit(m.key)).otherwise(key), F.when(owned == m.key, made).otherwise(turns)
    return key, turns


def escape(text: Column) -> Column:
    """No control string starts inside the result, and unescape() gives the text back."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    """Like escape(); a line break, which would end the role, becomes <\\-."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\-"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\-"), F.lit("\n")))


def format_turns(rows: DataFrame, key: str, order: list[str], trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: key, formatted (text), loss_spans (start from 1 and length of each trained text).

    rows: one turn a row, with role and text (null: empty) and the columns of `order`; ties in them go by role,
    then text. Rows with a null key form one conversation. Offsets are running sums over a conversation's rows,
    so the work is linear in its length. A formatted conversation is one value and has to fit in a task.
    """
    turn = Window.partitionBy(key).orderBy(*order, "role", "text")
    role, text = escape_role(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    r = rows.select(key, *order, F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    r = r.select(key, *order, "role", "text", F.concat(F.lit(START), role, F.lit("\n")).alias("head"), text.alias("body"))
    r = r.withColumn("seg", F.concat("head", "body", F.lit(END + "\n"))).withColumn("n", F.row_number().over(turn))
    end = F.sum(F.length("seg").cast("long")).over(turn.rowsBetween(Window.unboundedPreceding, 0))
    r = r.withColumn("at", end - F.length("seg") + F.length("head") + 1)
    span = F.when(F.col("role").isin(*trained), F.struct(F.col("at").alias("start"), F.length("body").cast("long").alias("length")))
    turns = F.array_sort(F.collect_list(F.struct("n", "seg", span.alias("span"))))
    g = r.groupBy(key).agg(turns.alias("t"))
    return g.select(key, F.array_join(F.col("t.seg"), "").alias("formatted"), F.filter(F.col("t.span"), lambda x: x.isNotNull()).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Turns read back from a formatted text."""
    parts = F.split(formatted, r"<\|im_start\|>")
    parts = F.slice(parts, F.lit(2), F.size(parts))
    role = lambda p: F.substring_index(p, "\n", 1)
    body = lambda p: p.substr(F.length(role(p)) + 2, F.length(p) - F.length(role(p)) - 1 - len(END) - 1)
    return F.transform(parts, lambda p: F.struct(unescape_role(role(p)).alias("role"), unescape(body(p)).alias("text")))


def digests(chats: DataFrame, key: str) -> DataFrame:
    """What can be read back from formatted chats: turns by the template, trained text by the loss spans.

    A row a chat, repeated ones and null keys too; none for an empty table.
    """
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.array_join(F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(s["start"].cast("int"), s["length"].cast("int")))), "")
    c = chats.withColumn("turns", read_turns(F.col("formatted"))).withColumn("under", under)
    return c.select(
        key, F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
