"""Chat formatting: a finite-state machine over roles, and a declarative template with loss flags.

A template names, for each role, the marks around its text and whether the text counts for the loss. Every control string
of the template that occurs inside a text gets one backslash after its first character (and one more if it has some already),
so no text can close its own turn, and taking one backslash away gives the text back.

A conversation is one value, so its turns are gathered in one row; conversations themselves are dealt out by conv_id.

Defined results: turns are ordered by turn (null first), role and text, and equal rows count as turns of their own; a null
text is empty; a null role is the empty role; roles that the template does not name use its ``other`` marks with the role's
name inside; rows with a null conv_id form one conversation; an empty table gives an empty result; further columns are not read.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    marks: dict = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple = ("[ROLE]", "[TEXT]", "[/ROLE]")
    loss: tuple = ("assistant",)
    # the machine: (state, role) -> state; what is missing leads to "bad", which no role leaves
    moves: dict = field(default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
                                                 ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    final: tuple = ("assistant",)

    @property
    def controls(self) -> list[str]:
        return sorted({m for pair in self.marks.values() for m in pair} | set(self.other))


CHAT = Template()


def _java(text: str) -> str:
    return re.sub(r"([\\\[\]{}()^$.|?*+<>/-])", r"\\\1", text)


def escape(text: Column, t: Template = CHAT) -> Column:
    pattern = "|".join(f"(?<={_java(c[0])})(\\\\*)(?={_java(c[1:])})" for c in t.controls)
    return F.regexp_replace(text, pattern, "$0\\\\")


def unescape(text: Column, t: Template = CHAT) -> Column:
    pattern = "|".join(f"(?<={_java(c[0])})\\\\(?=\\\\*{_java(c[1:])})" for c in t.controls)
    return F.regexp_replace(text, pattern, "")


def _segments(role: Column, text: Column, t: Template) -> Column:
    seg = lambda s, loss=False: F.struct(s.alias("text"), F.lit(loss).alias("loss"))
    begin, middle, end = (F.lit(x) for x in t.other)
    out = F.array(seg(F.concat(begin, escape(role, t), middle)), seg(escape(text, t)), seg(end))
    for name, (a, b) in t.marks.items():
        out = F.when(role == name, F.array(seg(F.lit(a)), seg(escape(text, t), name in t.loss), seg(F.lit(b)))).otherwise(out)
    return out


def format_chats(rows: DataFrame, t: Template = CHAT) -> DataFrame:
    """Per conversation: conv_id, n_turns, segments (array of text and loss), formatted, valid, first_bad_turn.

    ``first_bad_turn`` is the position (from 0) of the first turn that the machine refuses; a conversation is valid if
    there is none and the machine ends in a final state.
    """
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    moves = F.create_map(*[F.lit(x) for (state, role), to in t.moves.items() for x in (f"{state}\n{role}", to)])
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("seen"), F.lit(None).cast("int").alias("bad"))

    def step(at, turn):
        to = F.when(at["state"] == "bad", F.lit("bad")).otherwise(F.coalesce(moves[F.concat(at["state"], F.lit("\n"), turn["role"])], F.lit("bad")))
        return F.struct(to.alias("state"), (at["seen"] + 1).alias("seen"), F.coalesce(at["bad"], F.when(to == "bad", at["seen"])).alias("bad"))

    end = F.aggregate("turns", start, step)
    out = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), end.alias("end"), F.flatten(F.transform("turns", lambda x: _segments(x["role"], x["text"], t))).alias("segments"))
    return out.select("conv_id", "n_turns", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                      F.col("end.state").isin(list(t.final)).alias("valid"), F.col("end.bad").alias("first_bad_turn"))


def read_turns(formatted: Column, t: Template = CHAT) -> Column:
    """The (role, text) turns of a formatted conversation, read from its marks alone."""
    pairs = [*t.marks.values(), (t.other[0], t.other[2])]
    whole = "|".join(f"{_java(a)}.*?{_java(b)}" for a, b in pairs)
    inner = lambda s, a, b: F.substring(s, F.lit(len(a) + 1), F.length(s) - len(a) - len(b))

    def turn(s):
        body = inner(s, t.other[0], t.other[2])
        role = F.substring_index(body, t.other[1], 1)
        out = F.struct(unescape(role, t).alias("role"), unescape(F.substring(body, F.length(role) + len(t.other[1]) + 1, F.length(body)), t).alias("text"))
        for name, (a, b) in t.marks.items():
            out = F.when(F.startswith(s, F.lit(a)), F.struct(F.lit(name).alias("role"), unescape(inner(s, a, b), t).alias("text"))).otherwise(out)
        return out

    return F.transform(F.regexp_extract_all(formatted, F.lit(f"(?s){whole}"), 0), turn)


def chat_digests(rows: DataFrame, t: Template = CHAT) -> DataFrame:
    """What op3 returns: digests of the turns and of the text under the loss mask, both read back from the output."""
    out = format_chats(rows, t)
    turns = F.array_join(F.transform(F.col("turns"), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], t)), "")
    out = out.withColumn("turns", read_turns(F.col("formatted"), t)).withColumn("loss_text", loss)
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
                      F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")


CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
    SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (SELECT *, length(regexp_replace(text, '(<\\*<SYS>>|<\\*</SYS>>|\[\\*INST\]|\[\\*/INST\]|<\\*s>|<\\*/s>|\[\\*ROLE\]|\[\\*TEXT\]|\[\\*/ROLE\])', '\1~', 'g')) AS n,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM t),
s AS (SELECT *, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY pos) AS prev FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '')) AS loss_sha256,
    sum(n + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + length(role) END)::BIGINT AS formatted_chars,
    bool_and((prev = 'start' AND role IN ('system', 'user')) OR (prev IN ('system', 'assistant') AND role = 'user') OR (prev = 'user' AND role = 'assistant'))
        AND arg_max(role, pos) = 'assistant' AS valid
FROM s GROUP BY conv_id
"""
