r"""Chat formatting with schema fingerprints; DataFrame functions only.

The known nested field paths of an input are hashed; the hash selects a declarative mapping that
turns the layout (turn rows, prompt/response, instruction, message lists, JSON of any of these)
into canonical turns. Where the paths hold several layouts, the one with most paths is taken, the
first of them in the order of LAYOUTS. The template marks turns with control strings. Inside roles and texts
every `<`, any number of `!`, `|` gets one more `!`, so no control string can occur in a text
and taking one `!` away restores it.

Defined cases: null text and null role are empty; a null conversation id is a conversation of
its own; turns sort by turn number (nulls first), then role, then text; repeated rows are
turns of their own; an empty table gives an empty result; further columns, those with names of
other layouts too, are ignored. A conversation is one row of the result, so its turns meet in one task.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from infocausal.llm.common import let

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
TRAINED_ROLES = ("assistant",)
TURNS = "array<struct<role:string,text:string>>"


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths with the kind of each leaf; lists show as []."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [f"{at}:{'text' if isinstance(kind, T.StringType) else 'other'}"]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _turn(role: Column | str, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(
        F.coalesce(role, F.lit("")).cast("string").alias("role"), F.coalesce(text, F.lit("")).cast("string").alias("text")
    )


def _list(items: str, role: str, text: str):
    return lambda: F.coalesce(F.transform(F.col(items), lambda x: _turn(x[role], x[text])), F.array().cast(TURNS))


@dataclass(frozen=True)
class Layout:
    """`paths`: what an input of this layout has besides its id. `turns`: the mapping; None for turn rows."""

    name: str
    paths: tuple[str, ...]
    turns: object = None


LAYOUTS = (
    Layout("turn_rows", ("role:text", "text:text", "turn:other")),
    Layout("messages", ("messages[].content:text", "messages[].role:text"), _list("messages", "role", "content")),
    Layout("from_value", ("conversations[].from:text", "conversations[].value:text"), _list("conversations", "from", "value")),
    Layout(
        "prompt_response",
        ("prompt:text", "response:text"),
        lambda: F.array(_turn("user", F.col("prompt")), _turn("assistant", F.col("response"))),
    ),
    Layout(
        "prompt_completion",
        ("completion:text", "prompt:text"),
        lambda: F.array(_turn("user", F.col("prompt")), _turn("assistant", F.col("completion"))),
    ),
    Layout(
        "instruction",
        ("input:text", "instruction:text", "output:text"),
        lambda: F.array(
            _turn("user", F.concat_ws("\n\n", F.col("instruction"), F.nullif(F.col("input"), F.lit("")))),
            _turn("assistant", F.col("output")),
        ),
    ),
    Layout(
        "instruction_only",
        ("instruction:text", "output:text"),
        lambda: F.array(_turn("user", F.col("instruction")), _turn("assistant", F.col("output"))),
    ),
)
BY_FINGERPRINT = {fingerprint(list(x.paths)): x for x in LAYOUTS}
#: Layouts with more paths first.
_LARGEST_FIRST = sorted(LAYOUTS, key=lambda x: -len(x.paths))


def layout_of(df: DataFrame, conv_id: str) -> Layout:
    """The largest mapping that a fingerprint of the frame's field paths selects."""
    paths = field_paths(T.StructType([f for f in df.schema.fields if f.name != conv_id]))
    for x in _LARGEST_FIRST:
        if found := BY_FINGERPRINT.get(fingerprint([p for p in x.paths if p in paths])):
            return found
    raise ValueError(f"no layout for the field paths {paths}")


def canonical(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """conv_id, turns (array of role, text) from any known layout."""
    layout = layout_of(df, conv_id)
    if layout.turns is not None:
        return df.select(F.col(conv_id).alias("conv_id"), layout.turns().alias("turns"))
    rows = F.struct(
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return (
        df.groupBy(F.col(conv_id).alias("conv_id"))
        .agg(F.sort_array(F.collect_list(rows)).alias("r"))
        .select("conv_id", F.transform("r", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    )


def _turns_of(items: Column, role: str, text: str) -> Column:
    return F.transform(items, lambda e: _turn(e[role], e[text]))


def _known_paths(body: Column) -> Column:
    """The field paths of a JSON object; those of a list of objects are the fields of any of them, all known ones where the list is empty."""
    top = F.coalesce(F.map_keys(F.from_json(body, "map<string,string>")), F.array().cast("array<string>"))
    out = F.transform(top, lambda k: F.concat(k, F.lit(":text")))
    for x in LAYOUTS:
        if "[]" not in x.paths[0]:
            continue
        name = x.paths[0].split("[")[0]
        items = F.from_json(body, f"struct<{name}:array<map<string,string>>>")[name]
        fields = F.array_distinct(F.flatten(F.transform(items, lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>")))))
        nested = F.transform(fields, lambda f: F.concat(F.lit(f"{name}[]."), f, F.lit(":text")))
        some = F.when(F.size(items) == 0, F.array(*map(F.lit, x.paths))).when(items.isNotNull(), nested)
        out = F.concat(out, F.coalesce(some, F.array().cast("array<string>")))
    return F.array_distinct(out)


def canonical_json(df: DataFrame, conv_id: str, body: str) -> DataFrame:
    """As canonical(), for JSON rows of mixed layouts: each row's own known field paths select its mapping.

    Further fields and fields that are null change nothing. Returns conv_id, layout, turns. A row of
    no known layout, broken JSON included, has the layout null and no turns; none is dropped.
    """

    def mapped(paths: Column) -> Column:
        name, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
        for x in reversed(_LARGEST_FIRST):
            if x.turns is None:
                continue
            own = F.filter(F.array(*map(F.lit, sorted(x.paths))), lambda p: F.array_contains(paths, p))
            hit = F.substring(F.sha2(F.array_join(own, "\n"), 256), 1, 16) == F.lit(fingerprint(list(x.paths)))
            fields = [p.split(":")[0] for p in x.paths]
            if "[]" in x.paths[0]:
                top = fields[0].split("[")[0]
                inner = [f.split("[].")[1] for f in fields]
                whole = F.from_json(F.col(body), f"struct<{top}:array<struct<{','.join(f'`{i}`:string' for i in inner)}>>>")
                role, text = ("role", "content") if "content" in inner else ("from", "value")
                made = _turns_of(whole[top], role, text)
            else:
                whole = F.from_json(F.col(body), f"struct<{','.join(f'`{i}`:string' for i in fields)}>")
                ask = "instruction" if "instruction" in fields else "prompt"
                reply = next(i for i in fields if i not in (ask, "input"))
                told = F.concat_ws("\n\n", whole[ask], F.nullif(whole["input"], F.lit(""))) if "input" in fields else whole[ask]
                made = F.array(_turn("user", told), _turn("assistant", whole[reply]))
            name, turns = F.when(hit, F.lit(x.name)).otherwise(name), F.when(hit, F.coalesce(made, F.array().cast(TURNS))).otherwise(turns)
        return F.struct(name.alias("layout"), turns.alias("turns"))

    return df.select(F.col(conv_id).alias("conv_id"), let(_known_paths(F.col(body)), mapped).alias("m")).select("conv_id", "m.*")


def escape(x: Column) -> Column:
    return F.regexp_replace(x, r"<(!*)\|", r"<!$1|")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"<!(!*)\|", r"<$1|")


def format_turns(turns: DataFrame, trained: tuple[str, ...] = TRAINED_ROLES) -> DataFrame:
    """conv_id, formatted, loss_mask: spans of what is trained on, each by its turn (from 0) and the start and length in code points inside the turn."""

    def pieces(t: Column) -> Column:
        return F.transform(
            t,
            lambda x, i: F.struct(
                F.concat(F.lit(START), F.replace(escape(x["role"]), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n")).alias("head"),
                escape(x["text"]).alias("body"),
                x["role"].isin(*trained).alias("loss"),
                i.alias("turn"),
            ),
        )

    def out(p: Column) -> Column:
        spans = F.transform(
            F.filter(p, lambda x: x["loss"]),
            lambda x: F.struct(x["turn"].alias("turn"), F.length(x["head"]).alias("start"), F.length(x["body"]).alias("length")),
        )
        whole = F.array_join(F.transform(p, lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))), "")
        return F.struct(whole.alias("formatted"), spans.alias("loss_mask"))

    return turns.select("conv_id", let(pieces(F.col("turns")), out).alias("o")).select("conv_id", "o.*")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns, loss_texts: from the formatted string and its mask alone, in one pass over the turns."""

    def turn(x: Column) -> Column:
        head = F.substring_index(x, "\n", 1)
        return F.struct(
            unescape(F.replace(F.substr(head, F.lit(len(START) + 1)), F.lit(NEWLINE), F.lit("\n"))).alias("role"),
            unescape(F.substr(x, F.length(head) + 2)).alias("text"),
        )

    def read(parts: Column) -> Column:
        texts = F.transform("loss_mask", lambda s: unescape(F.substr(F.get(parts, s["turn"]), s["start"] + 1, s["length"])))
        return F.struct(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn).alias("turns"), texts.alias("loss_texts"))

    return formatted.select(
        "conv_id", let(F.split("formatted", r"<\|im_end\|>\n"), read).alias("r"), F.length("formatted").cast("long").alias("formatted_chars")
    ).select("conv_id", "r.*", "formatted_chars")


def digests(back: DataFrame) -> DataFrame:
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
