"""Chat formatting: schema fingerprints choose mappings to turns, one template prints them.

Everything here is DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.llm.common import free_name

# Control strings of common chat templates; ours are the first two.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<unk>", "<pad>", "<bos>", "<eos>", "<start_of_turn>", "<end_of_turn>")
# End of the fixed values.

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns: SQL over its columns, and the layout's field paths.

    If ``at`` is set, a record holds one turn, and those of an id are joined in its order.
    """

    name: str
    paths: tuple[str, ...]
    turns: str
    at: str = ""

    @property
    def fingerprint(self) -> str:
        return fingerprint_of(self.paths)


def fingerprint_of(paths: tuple[str, ...] | list[str]) -> str:
    """A hash of the nested field paths, whatever their order."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def _role(x: str) -> str:
    return f"case lower({x}) when 'human' then 'user' when 'gpt' then 'assistant' when 'bot' then 'assistant' when 'model' then 'assistant' else coalesce({x}, '') end"


def _pair(user: str, answer: str) -> str:
    return f"array(named_struct('role', 'user', 'text', {user}), named_struct('role', 'assistant', 'text', coalesce({answer}, '')))"


def _asked(instruction: str, more: str) -> str:
    return f"case when coalesce({more}, '') = '' then coalesce({instruction}, '') else concat(coalesce({instruction}, ''), '\\n', {more}) end"


#: Layouts that are known, by what their records hold.
MAPPINGS = (
    Mapping("messages", ("messages[].content", "messages[].role"), f"transform(messages, m -> named_struct('role', {_role('m.role')}, 'text', coalesce(m.content, '')))"),
    Mapping("shared", ("conversations[].from", "conversations[].value"), f"transform(conversations, m -> named_struct('role', {_role('m.from')}, 'text', coalesce(m.value, '')))"),
    Mapping("instruction with input", ("input", "instruction", "output"), _pair(_asked("instruction", "input"), "output")),
    Mapping("instruction", ("instruction", "output"), _pair("coalesce(instruction, '')", "output")),
    Mapping("completion", ("completion", "prompt"), _pair("coalesce(prompt, '')", "completion")),
    Mapping("prompt and response", ("prompt", "response"), _pair("coalesce(prompt, '')", "response")),
    Mapping("question", ("answer", "question"), _pair("coalesce(question, '')", "answer")),
    Mapping("rows by turn", ("role", "text", "turn"), "array(named_struct('role', coalesce(role, ''), 'text', coalesce(text, '')))", "turn"),
)


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The paths of all leaves: ``a.b`` for a field of a struct, ``a[]`` for what an array holds."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def chosen(paths: list[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping | None:
    """The mapping whose fingerprint is that of the paths, else the one with the most paths
    of those whose paths are all there (the first of equals), else None."""
    own = fingerprint_of(paths)
    return next((m for m in mappings if m.fingerprint == own), None) or next((m for m in _by_size(mappings) if set(m.paths) <= set(paths)), None)


def _by_size(mappings: tuple[Mapping, ...]) -> list[Mapping]:
    return sorted(mappings, key=lambda m: -len(set(m.paths)))


def canonical(records: DataFrame, id_col: str = "id", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``(id, layout, turns)`` of records in one typed layout, which its schema's
    fingerprint (without the id column) selects; more fields than a layout has do no harm.

    An unknown layout raises ValueError; a null array gives null turns, an empty one none.
    Records of a turn each become one row for each id, as ``turns_of_rows`` has it.
    """
    paths = [p for f in records.schema.fields if f.name != id_col for p in field_paths(f.dataType, f.name)]
    m = chosen(paths, mappings)
    if m is None:
        raise ValueError(f"no mapping for a layout with the fields {sorted(paths)}")
    turns = F.expr(m.turns).cast(TURNS)
    if m.at:
        rows = records.select(F.col(id_col).alias("id"), F.col(m.at).alias("at"), turns[0]["role"].alias("role"), turns[0]["text"].alias("text"))
        return _gathered(rows, ["id"]).select("id", F.lit(m.name).alias("layout"), "turns")
    return records.select(F.col(id_col).alias("id"), F.lit(m.name).alias("layout"), turns.alias("turns"))


def _fields(mappings: tuple[Mapping, ...]) -> dict[str, list[str]]:
    """The fields that the mappings read, with those of their objects if they are arrays."""
    out: dict[str, list[str]] = {}
    lists: dict[str, bool] = {}
    for m in mappings:
        for p in m.paths:
            name, _, leaf = p.partition("[].")
            if lists.setdefault(name, bool(leaf)) != bool(leaf):
                raise ValueError(f"mappings disagree on whether {name} is an array")
            out.setdefault(name, [])
            if leaf and leaf not in out[name]:
                out[name].append(leaf)
    return out


def _prefixed(names: Column, start: str) -> Column:
    return F.transform(names, lambda k: F.concat(F.lit(start), k))


def json_paths(raw: Column, lists: list[str]) -> Column:
    """The sorted field paths of a JSON record: its fields and, for those of ``lists`` that are
    arrays of objects, the objects' fields as ``name[].field`` (``name[0]`` if it is empty,
    ``name[]`` if it holds no fields). Null if it isn't an object."""
    top = F.json_object_keys(raw)
    inner = []
    for name in lists:
        items = F.from_json(raw, f"struct<`{name}`:array<string>>")[name]
        keys = F.flatten(F.transform(items, lambda x: F.coalesce(F.json_object_keys(x), F.array().cast("array<string>"))))
        named = F.when(F.size(keys) > 0, _prefixed(keys, f"{name}[].")).otherwise(F.array(F.when(F.size(items) == 0, f"{name}[0]").otherwise(f"{name}[]")))
        inner.append(F.when(items.isNotNull(), named).otherwise(F.array().cast("array<string>")))
    plain = F.filter(top, lambda k: ~k.isin(lists)) if lists else top
    return F.array_sort(F.array_distinct(F.concat(plain, *inner)))


def canonical_json(records: DataFrame, id_col: str = "id", json_col: str = "raw", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``(id, layout, fingerprint, turns)`` of JSON records whose layouts differ by row.

    Each row's own fingerprint, the hash of its field paths as ``canonical`` has it, selects
    its mapping, else its paths do, as in ``chosen``; a record whose arrays are empty
    belongs to a layout with them and has no turns. A row that no mapping knows, that is
    null or isn't JSON has null layout and turns; its fingerprint tells which layout it
    is. Rows of a turn each become one row for each id; places that aren't numbers come
    first. The mappings' SQL is that of typed records, and runs over the record's fields
    as columns, whatever the names of the other columns.
    """
    fields = _fields(mappings)
    lists = [k for k, v in fields.items() if v]
    i, j, p, fp, lay = (free_name(list(fields), x) for x in ("id", "raw", "paths", "fingerprint", "layout"))
    rows = records.select(F.col(id_col).alias(i), F.col(json_col).alias(j))
    rows = rows.withColumn(p, json_paths(F.col(j), lists)).withColumn(fp, F.substring(F.sha2(F.array_join(p, "\n").cast("binary"), 256), 1, 16))
    named = F.create_map(*[F.lit(x) for m in mappings for x in (m.fingerprint, m.name)])
    layout = F.lit(None).cast("string")
    for m in reversed(_by_size(mappings)):
        has = [F.array_contains(p, x) | (F.array_contains(p, x.partition("[].")[0] + "[0]") if "[]." in x else F.lit(False)) for x in m.paths]
        layout = F.when(reduce(Column.__and__, has), m.name).otherwise(layout)
    shape = ",".join(f"`{k}`:array<struct<{','.join(f'`{x}`:string' for x in v)}>>" if v else f"`{k}`:string" for k, v in fields.items())
    parsed = free_name([*fields, i, j, p, fp, lay], "parsed")
    rows = rows.withColumn(lay, F.coalesce(F.element_at(named, F.col(fp)), layout)).withColumn(parsed, F.from_json(j, f"struct<{shape}>"))
    rows = rows.select(i, lay, fp, f"{parsed}.*")
    turns, at = F.lit(None).cast(TURNS), F.lit(None).cast("decimal(38,9)")
    for m in mappings:
        turns = F.when(F.col(lay) == m.name, F.expr(m.turns).cast(TURNS)).otherwise(turns)
        if m.at:
            at = F.when(F.col(lay) == m.name, F.col(m.at).try_cast("decimal(38,9)")).otherwise(at)
    names = ["id", "layout", "fingerprint"]
    whole = rows.select(F.col(i).alias("id"), F.col(lay).alias("layout"), F.col(fp).alias("fingerprint"), turns.alias("turns"), at.alias("at"))
    apart = [m.name for m in mappings if m.at]
    single = F.coalesce(F.col("layout").isin(apart), F.lit(False)) if apart else F.lit(False)
    one = whole.where(single).select(*names, "at", F.col("turns")[0]["role"].alias("role"), F.col("turns")[0]["text"].alias("text"))
    return whole.where(~single).select(*names, "turns").unionByName(_gathered(one, names))


def turns_of_rows(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(id, turns)`` of rows that hold a turn each, in the order of ``turn_col`` (nulls
    first), ties by role and text; null texts and roles are empty. Rows with a null id
    form a conversation. A conversation is one row of the result, so it must fit one.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return _gathered(rows.select(F.col(id_col).alias("id"), F.col(turn_col).alias("at"), text(role_col).alias("role"), text(text_col).alias("text")), ["id"])


def _gathered(rows: DataFrame, names: list[str]) -> DataFrame:
    """``(*names, turns)`` of rows with ``at, role, text``."""
    grouped = rows.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("at", "role", "text"))).alias("t"))
    return grouped.select(*names, F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def _any(words: tuple[str, ...]) -> str:
    quote = lambda s: "".join("\\" + c if c in r"\.[]{}()<>*+-=!?^$|/" else c for c in s)
    return "|".join(quote(w) for w in sorted(words, key=len, reverse=True))


def escape(text: Column) -> Column:
    r"""``\`` becomes ``\b``, and ``\z`` goes after the first character of each control
    string, so that none is left; ``unescape`` undoes it exactly."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\b")), f"([<\\[])(?=({_any(tuple(c[1:] for c in CONTROLS))}))", r"$1\\z")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\z"), F.lit("")), F.lit("\\b"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\e"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\e"), F.lit("\n")))


def format_turns(conversations: DataFrame, turns_col: str = "turns", trained_role: str = "assistant") -> DataFrame:
    """Adds ``formatted`` and ``loss_spans`` (start from 0 and length in code points of each
    trained turn's escaped text). Null turns count as none and give an empty string."""
    names = [c for c in conversations.columns if c not in ("formatted", "loss_spans")]
    safe = F.transform(F.coalesce(F.col(turns_col), F.array().cast(TURNS)), lambda t: F.struct(_escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == trained_role).alias("own")))
    own = free_name([*names, "formatted", "loss_spans"], "safe")
    held = conversations.select(*names, safe.alias(own))
    # from the roles' and texts' lengths each text's place follows by a running sum
    head = lambda t: F.length(t["role"]) + len(OPEN) + 1
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    walked = F.aggregate(
        own, start,
        lambda s, t: F.struct((s["at"] + head(t) + F.length(t["text"]) + len(CLOSE) + 1).alias("at"), F.when(t["own"], F.array_append(s["spans"], F.struct((s["at"] + head(t)).alias("start"), F.length(t["text"]).alias("length")))).otherwise(s["spans"]).alias("spans")),
        lambda s: s["spans"],
    )
    text = F.array_join(F.transform(own, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE), F.lit("\n"))), "")
    return held.select(*names, text.alias("formatted"), walked.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, texts and roles as they were."""
    parts = F.filter(F.split(formatted, _any((OPEN,))), lambda p, i: i > 0)
    body = lambda p: F.substring_index(p, CLOSE, 1)
    role = lambda p: F.substring_index(body(p), "\n", 1)
    return F.transform(parts, lambda p: F.struct(_unescape_role(role(p)).alias("role"), unescape(body(p).substr(F.length(role(p)) + 2, F.length(p))).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, one after the other."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr(s["start"] + 1, s["length"]))), "")
