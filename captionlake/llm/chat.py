"""Conversations as training text, by a grammar round trip, in DataFrame operations only.

A template says how a turn of each role is marked. Its control strings may not stand in a text. Every
turn is rendered as it is, reparsed by a deterministic parser and compared with its source; where they
differ its text is escaped, one control string after another, until they are identical. Then the turns
of a conversation are joined, and the whole text is reparsed and compared once more: a conversation
that doesn't give its own turns back is an error, never a result.

An escape puts one more backslash between the first character of a control string and the rest,
whether there are some already or none; the parser takes one away. So ``[INST]`` becomes ``[\\INST]``,
``[\\INST]`` becomes ``[\\\\INST]``, and other backslashes stay as they are. The parser takes a turn
from its opening mark to the next closing one and refuses a text that holds a control string.

The loss mask covers the texts of the trained role, in code points of the formatted text.

Null roles and texts are empty. Turns go by number (null first), then role, then text; rows that
repeat are turns each. Rows without a conversation's identifier are one conversation. A role that the
template doesn't know is marked by its escaped name. An empty table gives no rows. Other columns play
no part, whatever they are called.

Scale: turns are rendered, parsed and escaped where they are read, then shuffled once by conversation,
a source text beside its escaped one only where they differ. A conversation is one formatted string,
so its turns meet in one row, as the result asks; nothing else is brought together.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARK = "\\"


@dataclass(frozen=True)
class Template:
    """forms: role, what opens a turn and what closes it. other: what stands before and after the name of any other role, and what closes its turn."""

    # The marks of a public chat format.
    forms: tuple[tuple[str, str, str], ...] = (("system", "<<SYS>>\n", "\n<</SYS>>\n\n"), ("user", "<s>[INST] ", " [/INST]"), ("assistant", " ", " </s>"))
    other: tuple[str, str, str] = ("<<ROLE>>", "<</ROLE>>", " </s>")
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>")
    trained: str = "assistant"

    def __post_init__(self):
        for a in self.controls:
            if len(a) < 2 or MARK in a:
                raise ValueError(f"a control string has two characters at least and no backslash: {a!r}")
            for b in self.controls:
                if a != b and a in b or any(a.endswith(b[:n]) for n in range(1, len(b)) if (a, n) != (b, len(b))):
                    raise ValueError(f"control strings may not overlap: {a!r}, {b!r}")
        for close in (*(c for _, _, c in self.forms), self.other[2]):
            if not any(c in close for c in self.controls):
                raise ValueError(f"what closes a turn has to hold a control string: {close!r}")


def _after(template: Template) -> dict[str, str]:
    """For each first character of a control string, a pattern for what may follow it."""
    rest: dict[str, list[str]] = {}
    for control in template.controls:
        rest.setdefault(control[0], []).append(re.escape(control[1:]))
    return {re.escape(first): f"(?:{'|'.join(after)})" for first, after in rest.items()}


def escaped(text: Column, control: str) -> Column:
    """text with one more backslash in each control string, spelt with or without some."""
    return F.regexp_replace(text, F.lit(f"({re.escape(control[0])})(?=\\\\*{re.escape(control[1:])})"), F.lit("$1\\\\"))


def unescaped(text: Column, template: Template) -> Column:
    # The pattern begins with what is rare, and is not tried where there is none.
    behind = "|".join(f"(?<={first}\\\\)(?=\\\\*{after})" for first, after in _after(template).items())
    return F.when(text.contains(MARK), F.regexp_replace(text, F.lit(f"\\\\(?:{behind})"), F.lit(""))).otherwise(text)


def holds_control(text: Column, template: Template) -> Column:
    one = "|".join(f"{first}{after}" for first, after in _after(template).items())
    first = reduce(lambda a, b: a | b, (text.contains(c) for c in {c[0]: None for c in template.controls}))
    return first & text.rlike(one)


def _escaped_all(text: Column, template: Template) -> Column:
    for control in template.controls:
        text = escaped(text, control)
    return text


def rendered(role: Column, body: Column, template: Template) -> Column:
    """One turn, marked; body is the text, escaped as far as needed."""
    before, after, close = template.other
    turn = F.concat(F.lit(before), _escaped_all(role, template), F.lit(after), body, F.lit(close))
    for name, opens, closes in reversed(template.forms):
        turn = F.when(role == name, F.concat(F.lit(opens), body, F.lit(closes))).otherwise(turn)
    return turn


def pieces(formatted: Column, template: Template) -> Column:
    """The turns of a formatted text as they stand there, up to the first place where none begins."""
    forms = [*((o, c) for _, o, c in template.forms), (template.other[0], template.other[2])]
    forms.sort(key=lambda f: -len(f[0]))  # the longest opening first
    turn = "|".join(f"{re.escape(o)}.*?{re.escape(c)}" for o, c in forms)
    return F.regexp_extract_all(formatted, F.lit(f"(?s)\\G(?:{turn})"), F.lit(0))


def _read(found: Column, template: Template) -> Column:
    """role and text of each marked turn; the text is null where it holds a control string. Step by step, as what a lambda is given is worked out once."""
    before, after, close = template.other
    shape = lambda role, begin, shut: F.struct(role.alias("role"), begin.alias("begin"), shut.alias("shut"))

    def form(piece: Column) -> Column:
        named = F.locate(after, piece)
        own = shape(unescaped(piece.substr(F.lit(len(before) + 1), named - len(before) - 1), template), named + len(after), F.lit(len(close)))
        for name, opens, closes in sorted(template.forms, key=lambda f: len(f[1])):
            here = piece.startswith(opens)
            if len(opens) < len(before):
                here &= ~piece.startswith(before)
            own = F.when(here, shape(F.lit(name), F.lit(len(opens) + 1), F.lit(len(closes)))).otherwise(own)
        return F.struct(piece.alias("piece"), own.alias("f"))

    def body(x: Column) -> Column:
        return F.struct(x["f"]["role"].alias("role"), x["piece"].substr(x["f"]["begin"], F.char_length(x["piece"]) - x["f"]["begin"] + 1 - x["f"]["shut"]).alias("body"))

    def text(x: Column) -> Column:
        return F.struct(x["role"].alias("role"), F.when(~holds_control(x["body"], template), unescaped(x["body"], template)).alias("text"))

    return F.transform(F.transform(F.transform(found, form), body), text)


def parsed(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted text; null where it isn't one turn after another."""
    found = pieces(formatted, template)
    return F.when(F.array_join(found, "") == formatted, _read(found, template))


def format_conversations(turns: DataFrame, template: Template = Template(), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The id, formatted, loss: an array of turn (its index), turn_start, start, end (code points of formatted; end is excluded)."""
    empty = F.lit("")
    rows = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, empty).alias("role"), F.coalesce(text_col, empty).alias("text"))

    def comes_back(body: Column) -> Column:
        return parsed(rendered(F.col("role"), body, template), template).eqNullSafe(F.array(F.struct("role", "text")))

    rows = rows.withColumn("body", F.col("text")).withColumn("fine", comes_back(F.col("body")))
    for control in template.controls:
        rows = rows.withColumn("body", F.when(F.col("fine"), F.col("body")).otherwise(escaped(F.col("body"), control)))
        rows = rows.withColumn("fine", F.col("fine") | comes_back(F.col("body")))
    dealt = rows.select("id", "turn", "role", "body", F.when(F.col("body") != F.col("text"), F.col("text")).alias("source"))
    order = Window.partitionBy("id").orderBy("turn", "role", F.coalesce("source", "body"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = dealt.withColumn("piece", rendered(F.col("role"), F.col("body"), template))
    placed = marked.select("id", "role", F.coalesce("source", "body").alias("text"), "piece", (F.row_number().over(order) - 1).alias("n"), F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)).cast("long").alias("at"))
    whole = placed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "role", "text", "piece", "at"))).alias("t"))
    joined = whole.select("id", "t", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"))
    same = parsed(F.col("formatted"), template).eqNullSafe(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))))
    opens, closes = next((o, c) for r, o, c in template.forms if r == template.trained)
    loss = F.transform(
        F.filter("t", lambda x: x["role"] == template.trained),
        lambda x: F.struct(x["n"].alias("turn"), x["at"].alias("turn_start"), (x["at"] + len(opens)).alias("start"), (x["at"] + F.char_length(x["piece"]) - len(closes)).alias("end")),
    )
    checked = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation doesn't give its turns back under this template")))
    return joined.select(F.col("id").alias(id_col), checked.alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame, template: Template = Template(), id_col: str = "conv_id") -> DataFrame:
    """What format_conversations has written: the id, formatted, turns (role, text), loss_texts: the text under each span of the mask, unescaped."""
    split = formatted.select(id_col, "formatted", "loss", pieces(F.col("formatted"), template).alias("pieces"))
    # A span lies in one turn: it is cut from that piece, not from the whole text.
    cut = F.transform("loss", lambda s: F.get("pieces", s["turn"]).substr((s["start"] - s["turn_start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    under = F.transform(cut, lambda t: unescaped(t, template))
    return split.select(id_col, "formatted", _read(F.col("pieces"), template).alias("turns"), under.alias("loss_texts"))


def round_trip_digests(turns: DataFrame, template: Template = Template(), id_col: str = "conv_id") -> DataFrame:
    """For each conversation, read back from its formatted text: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    back = read_back(format_conversations(turns, template, id_col), template, id_col)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    told = back.select(id_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.array_join("loss_texts", "").alias("under"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return told.select(id_col, "n_turns", "turns_sha256", F.char_length("under").cast("long").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"), "formatted_chars")
