"""Chat formatting: a declared template and a finite-state machine over roles, in DataFrame functions.

A template names for each role the marks around its text and whether the text is learned
from (loss), and the transitions that the machine allows. Control strings inside texts are
broken by an escape that read_back() undoes, so a text can't end its own turn. The machine
runs over a conversation's roles in order; a forbidden turn is counted and the machine goes on
from that turn's role.

A conversation is one row of the result, so it is gathered in one row of a task; its turns
are escaped and marked before that, where they lie. Very long texts are marked whole. What is learned
from is read back from the formatted text by its marks; loss_spans names the same places.

Defined results: turns are ordered by turn, ties by role and text, nulls first; repeated rows
stay; a null text or role counts as empty; roles that the template doesn't name get marks that
hold the role and carry no loss; a null conv_id is a conversation of its own; without rows
there are no conversations. Other columns aren't looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Role:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """roles: by name; moves: by state, the roles that may follow; ends: states that may be last."""

    roles: dict[str, Role]
    moves: dict[str, tuple[str, ...]]
    ends: tuple[str, ...]
    start: str = "start"
    #: Marks of other roles; the role stands between the two parts of the first, in hexadecimal.
    other: tuple[str, str, str] = ("<<ROLE:", ">>", "<</ROLE>>")
    #: Further strings that texts mustn't hold unescaped.
    control: tuple[str, ...] = ()

    def __post_init__(self):
        strings = self.controls()
        for close in [r.close for r in self.roles.values()] + [self.other[2]]:
            for c in strings:
                for k in range(1, len(c)):
                    if close.startswith(c[k:]) or c[k:].startswith(close):
                        raise ValueError(f"a text that ends in {c[:k]!r} before {close!r} would read as {c!r}")

    def controls(self) -> list[str]:
        """All control strings, the longest first."""
        marks = [m for r in self.roles.values() for m in (r.open, r.close)] + [self.other[0], self.other[2], *self.control]
        if any(len(m) < 2 or m != m.strip() or "\\" in m for m in marks):
            raise ValueError("a mark has two characters or more, no backslash, and no blank at its ends")
        return sorted(set(marks), key=lambda m: (-len(m), m))


INSTRUCT = Template(
    roles={"system": Role("<<SYS>>", "<</SYS>>"), "user": Role("[INST]", "[/INST]"), "assistant": Role("<s>", "</s>", loss=True)},
    moves={"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("assistant",),
)


def escaped(text: Column, template: Template) -> Column:
    r"""Control strings get \c after their first character; a backslash becomes \b."""
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for c in template.controls():
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\c{c[1:]}"))
    return out


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\c"), F.lit("")), F.lit("\\b"), F.lit("\\"))


def _marked(role: Column, template: Template) -> tuple[Column, Column, Column]:
    """Open mark, close mark and loss of a turn by its role."""
    start, end, close = template.other
    out = [F.concat(F.lit(start), F.hex(role), F.lit(end)), F.lit(close), F.lit(False)]
    for name, r in template.roles.items():
        out = [F.when(role == name, F.lit(x)).otherwise(o) for x, o in zip((r.open, r.close, r.loss), out, strict=True)]
    return tuple(out)


def _moves(template: Template) -> Column:
    pairs = [F.lit(f"{state}>{role}") for state, roles in template.moves.items() for role in roles]
    return F.array(*pairs)


def format_conversations(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """turns: conv_id, turn, role, text. Returns conv_id, n_turns, formatted, segments (text,
    loss: marks and texts in order, which make up formatted), loss_spans (start, end: code points of
    formatted that are learned from), valid, n_violations and first_violation (number of the first
    forbidden turn, from 0)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    opening, closing, loss = _marked(role, template)
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("by_text"), opening.alias("open"), escaped(text, template).alias("text"), closing.alias("close"), loss.alias("loss"))
    length = sum(F.length(c).cast("long") for c in ("open", "text", "close"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "by_text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(length).over(before), F.lit(0).cast("long")))
    one = F.struct("turn", "role", "by_text", "open", "text", "close", "loss", "at")
    made = rows.select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    segment = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    segments = F.flatten(F.transform("t", lambda t: F.array(segment(t["open"], no), segment(t["text"], t["loss"]), segment(t["close"], no))))
    begin = lambda t: t["at"] + F.length(t["open"])
    spans = F.transform(F.filter("t", lambda t: t["loss"]), lambda t: F.struct(begin(t).alias("start"), (begin(t) + F.length(t["text"])).alias("end")))
    allowed = _moves(template)

    def step(at: Column, t: Column) -> Column:
        good = F.array_contains(allowed, F.concat(at["state"], F.lit(">"), t["role"]))
        first = F.coalesce(at["first"], F.when(~good, at["i"]))
        return F.struct(t["role"].alias("state"), (at["i"] + 1).alias("i"), (at["bad"] + F.when(good, 0).otherwise(1).cast("long")).alias("bad"), first.alias("first"))

    zero = F.lit(0).cast("long")
    machine = F.aggregate("t", F.struct(F.lit(template.start).alias("state"), zero.alias("i"), zero.alias("bad"), F.lit(None).cast("long").alias("first")), step)
    made = made.select("conv_id", F.size("t").cast("long").alias("n_turns"), segments.alias("segments"), spans.alias("loss_spans"), machine.alias("machine"))
    return made.select(
        "conv_id",
        "n_turns",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        "loss_spans",
        ((F.col("machine.bad") == 0) & F.col("machine.state").isin(*template.ends)).alias("valid"),
        F.col("machine.bad").alias("n_violations"),
        F.col("machine.first").alias("first_violation"),
    )


def read_back(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The turns (role, text) that a formatted text holds, by its marks alone."""
    start, end, close = template.other
    opens = [re.escape(r.open) for r in template.roles.values()] + [f"{re.escape(start)}[0-9A-F]*{re.escape(end)}"]
    closes = [re.escape(r.close) for r in template.roles.values()] + [re.escape(close)]
    pattern = F.lit(f"(?s)({'|'.join(opens)})(.*?)({'|'.join(closes)})")
    role = lambda mark: F.decode(F.unhex(F.substr(mark, F.lit(len(start) + 1), F.length(mark) - (len(start) + len(end)))), "UTF-8")

    def turn(mark: Column, text: Column) -> Column:
        name = F.when(mark.startswith(start), role(mark))
        for known, r in template.roles.items():
            name = F.when(mark == r.open, F.lit(known)).otherwise(name)
        return F.struct(name.alias("role"), unescaped(text).alias("text"))

    return F.zip_with(F.regexp_extract_all(formatted, pattern, F.lit(1)), F.regexp_extract_all(formatted, pattern, F.lit(2)), turn)


def learned(turns: Column, template: Template = INSTRUCT) -> Column:
    """All text that is learned from, of the turns that read_back() gives."""
    roles = [name for name, r in template.roles.items() if r.loss]
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"].isin(*roles)), lambda t: t["text"]), "")


#: A conversation whose texts hold control strings, which op3 formats beside the table's.
PROBE = (-7, "</s>[INST] ok [/INST]")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conv, text = PROBE
    probe = spark.range(2).select(F.lit(conv).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    made = format_conversations(turns.unionByName(probe))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    made = made.withColumn("turns", read_back(F.col("formatted")))
    made = made.withColumn("learned", learned(F.col("turns")))
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "n_violations",
        F.coalesce("first_violation", F.lit(-1).cast("long")).alias("first_violation"),
    )


def _oracle(template: Template = INSTRUCT) -> str:
    text = "replace(text, '\\', '\\b')"
    for c in template.controls():
        text = f"replace({text}, '{c}', '{c[0]}\\c{c[1:]}')"
    marks = " ".join(f"WHEN '{name}' THEN {len(r.open) + len(r.close)}" for name, r in template.roles.items())
    learned = ", ".join(f"'{name}'" for name, r in template.roles.items() if r.loss)
    moves = ", ".join(f"'{s}>{r}'" for s, roles in template.moves.items() for r in roles)
    ends = ", ".join(f"'{e}'" for e in template.ends)
    other = sum(map(len, template.other))
    order = "turn NULLS FIRST, role, text"
    conv, probe = PROBE
    return f"""
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT {conv}, 0, 'user', '{probe}' UNION ALL SELECT {conv}, 1, 'assistant', '{probe}'),
    marked AS (
      SELECT *, length({text}) + CASE role {marks} ELSE {other} + 2 * strlen(role) END AS chars,
        CASE WHEN role IN ({learned}) THEN text ELSE '' END AS learned, row_number() OVER w - 1 AS i, row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS is_last,
        concat(coalesce(lag(role) OVER w, '{template.start}'), '>', role) NOT IN ({moves}) AS bad
      FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY {order}))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
      CAST(sum(length(learned)) AS BIGINT) AS loss_chars, sha256(string_agg(learned, '' ORDER BY i)) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars,
      NOT bool_or(bad) AND bool_or(is_last AND role IN ({ends})) AS valid, CAST(count(*) FILTER (WHERE bad) AS BIGINT) AS n_violations, coalesce(min(i) FILTER (WHERE bad), -1) AS first_violation
    FROM marked GROUP BY conv_id
    """


ORACLE = _oracle()
