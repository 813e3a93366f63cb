"""Chat formatting: any known layout to canonical turns, turns to one string.

*Schema fingerprinting.*  Every record has the set of nested field paths that it
fills (``messages[].role``, ``prompt`` ...).  The sorted set is hashed; the hash
selects a declarative :class:`Mapping` that says which fields become which
turns.  A record may be a whole conversation (a list of messages, a prompt and its answer ...) or one
turn of it; :func:`gather_turns` puts the turns of one conversation together.  Records whose fingerprint
no mapping knows keep null turns and are reported, never guessed at.

*Template.*  ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.  Control strings
inside roles and texts are escaped reversibly (``&`` and ``<|``, and line ends in
roles), so that the formatted string can be read back exactly.

Everything is built from DataFrame functions; no Python runs on the executors.

Defined results: null text or role is empty; turns of a conversation are ordered
by turn, then place in their record, ties by role and then text, null turns first; repeated rows are
repeated turns; a conversation without rows does not exist; an empty table gives
no rows; :func:`canonicalise` keeps other columns and replaces those named ``layout`` and
``canonical_turns``.  One conversation is one output value and is gathered
whole, as its digests are of the whole string: a conversation must fit a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unused

START, END = "<|im_start|>", "<|im_end|>"
TURN = "array<struct<role:string,text:string>>"


# -- escaping ---------------------------------------------------------------
def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("&nl;"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("&nl;"), F.lit("\n")))


# -- layouts ----------------------------------------------------------------
@dataclass(frozen=True)
class Part:
    """A turn (or, for a list, one turn per element) of a mapping.

    ``text`` names a field.  ``each`` names an array of structs whose members
    ``role`` and ``text`` are named relative to it.  ``role`` is otherwise a
    constant, or in ``role_of`` a field.  ``join`` appends a second field to the text after a blank line
    (instruction + input).
    """

    text: str | None
    role: str = "user"
    each: str | None = None
    join: str | None = None
    role_of: str | None = None


@dataclass(frozen=True)
class Mapping:
    name: str
    paths: tuple[str, ...]
    parts: tuple[Part, ...]

    @property
    def key(self) -> str:
        return "\n".join(sorted(self.paths))


#: role names of other layouts and the canonical ones
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}

DEFAULT_MAPPINGS = (
    Mapping("turns", ("turns[].role", "turns[].text"), (Part("text", "role", each="turns"),)),
    Mapping("messages", ("messages[].content", "messages[].role"), (Part("content", "role", each="messages"),)),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), (Part("value", "from", each="conversations"),)),
    Mapping("prompt_completion", ("prompt", "completion"), (Part("prompt"), Part("completion", "assistant"))),
    Mapping("prompt_response", ("prompt", "response"), (Part("prompt"), Part("response", "assistant"))),
    Mapping("question_answer", ("question", "answer"), (Part("question"), Part("answer", "assistant"))),
    Mapping("instruction", ("instruction", "output"), (Part("instruction"), Part("output", "assistant"))),
    Mapping("instruction_input", ("instruction", "input", "output"), (Part("instruction", join="input"), Part("output", "assistant"))),
    Mapping("system_prompt_response", ("system", "prompt", "response"), (Part("system", "system"), Part("prompt"), Part("response", "assistant"))),
)


#: records that are one turn each; what a row leaves null it doesn't fill
TURN_MAPPINGS = (
    Mapping("turn", ("role", "text"), (Part("text", role_of="role"),)),
    Mapping("turn_without_text", ("role",), (Part(None, role_of="role"),)),
    Mapping("turn_without_role", ("text",), (Part("text", role=""),)),
    Mapping("empty_turn", (), (Part(None, role=""),)),
)


def _leaves(kind: T.DataType, path: str) -> list[tuple[str, Callable[[Column], Column]]]:
    """(path, whether a value fills it) for each nested leaf field, through structs and arrays of them."""
    def member(name: str, ok: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda v: ok(v.getField(name))

    def any_of(ok: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda v: F.coalesce(F.exists(v, ok), F.lit(False))

    if isinstance(kind, T.StructType):
        return [(p, member(f.name, ok)) for f in kind for p, ok in _leaves(f.dataType, f"{path}.{f.name}" if path else f.name)]
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType | T.ArrayType):
        return [(p, any_of(ok)) for p, ok in _leaves(kind.elementType, f"{path}[]")]
    return [(path, lambda v: v.isNotNull())]


def _filled(kind: T.DataType, value: Column, path: str) -> list[tuple[str, Column]]:
    """(path, is it filled in this row) for each nested leaf field."""
    return [(p, ok(value)) for p, ok in _leaves(kind, path)]


def field_paths(df: DataFrame, fields: list[str]) -> Column:
    """Sorted nested paths that a row fills, one a line."""
    found = [x for name in fields for x in _filled(df.schema[name].dataType, F.col(f"`{name}`"), name)]
    return F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(ok, F.lit(p)) for p, ok in found]))), "\n")


def fingerprint(paths: Column) -> Column:
    return F.sha2(paths, 256)


def _turn_of(part: Part, canonical: Column | None):
    def turn(x: Column) -> Column:
        role = x.getField(part.role)
        if canonical is not None:
            role = F.coalesce(F.element_at(canonical, F.lower(role)), role)
        return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(x.getField(part.text), F.lit("")).alias("text"))

    return turn


def _turns(parts: tuple[Part, ...], canonical: Column | None) -> Column:
    made = []
    for p in parts:
        if p.each:
            made.append(F.transform(F.coalesce(F.col(f"`{p.each}`"), F.array()), _turn_of(p, canonical)))
        else:
            text = F.coalesce(F.col(f"`{p.text}`").cast("string"), F.lit("")) if p.text else F.lit("")
            if p.join:
                more = F.coalesce(F.col(f"`{p.join}`").cast("string"), F.lit(""))
                text = F.when(more == "", text).otherwise(F.concat(text, F.lit("\n\n"), more))
            role = F.lit(p.role)
            if p.role_of:
                named = F.coalesce(F.col(f"`{p.role_of}`"), F.lit(""))
                role = named if canonical is None else F.coalesce(F.element_at(canonical, F.lower(named)), named)
            made.append(F.array(F.struct(role.alias("role"), text.alias("text"))))
    return F.concat(*made).cast(TURN)


def canonicalise(df: DataFrame, fields: list[str], mappings: tuple[Mapping, ...] = DEFAULT_MAPPINGS, roles: dict[str, str] = ROLES) -> DataFrame:
    """Add ``layout`` and ``canonical_turns``; both null where no mapping fits."""
    have = {p for name in fields for p, _ in _filled(df.schema[name].dataType, F.col(f"`{name}`"), name)}
    canonical = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv]) if roles else None
    held = unused(df, "fingerprint")
    print_ = fingerprint(field_paths(df, fields))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURN)
    for m in mappings:
        if not set(m.paths) <= have:
            continue
        hit = F.col(held) == hashlib.sha256(m.key.encode()).hexdigest()
        layout = F.when(hit, m.name).otherwise(layout)
        turns = F.when(hit, _turns(m.parts, canonical)).otherwise(turns)
    out = df.withColumn(held, print_)
    return out.withColumns({"layout": layout, "canonical_turns": turns}).drop(held)


# -- rows by turn -----------------------------------------------------------
def gather_turns(records: DataFrame, key: str = "conv_id", turn: str = "turn", turns: str = "canonical_turns") -> DataFrame:
    """One row a conversation: key and ``turns`` in order, from records with one or more turns."""
    one = records.select(F.col(f"`{key}`").alias("k"), F.col(f"`{turn}`").alias("n"), F.posexplode(f"`{turns}`").alias("at", "t"))
    gathered = one.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("n", "at", "t.role", "t.text"))).alias("rows"))
    return gathered.select(F.col("k").alias(key), F.transform("rows", lambda x: F.struct(x.role.alias("role"), x.text.alias("text"))).alias("turns"))


# -- template ---------------------------------------------------------------
def format_turns(turns: Column) -> Column:
    one = lambda x: F.concat(F.lit(START), escape_role(x.role), F.lit("\n"), escape(x.text), F.lit(END + "\n"))
    return F.array_join(F.transform(turns, one), "")


def loss_spans(turns: Column, roles: tuple[str, ...] = ("assistant",)) -> Column:
    """array<struct<start,length>>: code points of the formatted string that count for the loss."""
    fixed = len(START) + 1 + len(END) + 1
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        r, t = F.length(escape_role(x.role)), F.length(escape(x.text))
        span = F.struct((acc.at + len(START) + r + 1).alias("start"), t.alias("length"))
        spans = F.when(x.role.isin(*roles), F.concat(acc.spans, F.array(span))).otherwise(acc.spans)
        return F.struct((acc.at + r + t + fixed).cast("int").alias("at"), spans.cast("array<struct<start:int,length:int>>").alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc.spans)


def parse_formatted(formatted: Column) -> Column:
    """The turns that a formatted string holds."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        body = F.substring(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 2 - len(END))
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s.start + 1, s.length))), "")
