"""Chat formatting with DataFrame functions only.

A declarative template gives each role its marker, the turn's end, the roles under the loss, and the
allowed steps between roles. ``format_chats`` walks that finite-state machine over a conversation's
turns and emits the formatted text and its segments with a loss flag each; ``read_back`` parses
the formatted text again.

Control strings inside texts are escaped reversibly: a backslash becomes ``\\0`` and the first
character of a control string becomes a backslash and that character's number.

Defined results: null text, role or conversation id is the empty text, role or the null conversation;
turns are ordered by turn, role, text (null turns first); repeated rows stay; a turn that the machine
does not allow is formatted all the same, ``valid`` is false and ``bad_turn`` is the first such
place (counted from 0; the number of turns if the conversation only ends too early). Other columns are ignored.
A conversation is one row, as its formatted text is; one of very many turns is one task's.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, table


@dataclass(frozen=True)
class Template:
    markers: dict = field(default_factory=lambda: {"system": "<<SYS>>", "user": "[INST]", "assistant": "[/INST]"})
    other: tuple = ("[ROLE]", "[/ROLE]")
    end: str = "</s>"
    loss: tuple = ("assistant",)
    steps: dict = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    last: tuple = ("assistant",)

    def __post_init__(self) -> None:
        controls = self.controls
        if len(set(controls)) < len(controls) or any("\\" in c or not c for c in controls):
            raise ValueError("control strings must differ, be non-empty and hold no backslash")
        if len(self.heads) > 9:
            raise ValueError("control strings may begin with nine different characters at most: an escape has one digit")
        for a in controls:
            for b in controls:
                if a != b and a in b:
                    raise ValueError(f"{a!r} lies inside {b!r}")
                if any(b.startswith(a[i:]) or a[i:].startswith(b) for i in range(1, len(a))):
                    raise ValueError(f"the end of {a!r} begins {b!r}: a text before a marker could read as a control string")

    @property
    def controls(self) -> list[str]:
        return [*self.markers.values(), *self.other, self.end]

    @property
    def heads(self) -> list[str]:
        return sorted({c[0] for c in self.controls})


def escape(text: Column, template: Template) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\0"))
    for c in template.controls:
        text = F.replace(text, F.lit(c), F.lit(f"\\{template.heads.index(c[0]) + 1}{c[1:]}"))
    return text


def unescape(text: Column, template: Template) -> Column:
    for i, head in enumerate(template.heads, 1):
        text = F.replace(text, F.lit(f"\\{i}"), F.lit(head))
    return F.replace(text, F.lit("\\0"), F.lit("\\"))


def marker(role: Column, template: Template) -> Column:
    out = F.concat(F.lit(template.other[0]), escape(role, template), F.lit(template.other[1]))
    for name, mark in template.markers.items():
        out = F.when(role == name, mark).otherwise(out)
    return out


def walk(turns: Column, template: Template) -> Column:
    """The first place that the machine does not allow, or -1."""
    allowed = [F.lit(f"{a}>{b}") for a, many in template.steps.items() for b in many]

    def step(state, turn):
        known = turn["role"].isin(*template.markers)
        go = F.array_contains(F.array(*allowed), F.concat(state["role"], F.lit(">"), turn["role"])) & known
        return F.struct(turn["role"].alias("role"), (state["n"] + 1).alias("n"), F.when((state["bad"] < 0) & ~go, state["n"]).otherwise(state["bad"]).alias("bad"))

    start = F.struct(F.lit("start").alias("role"), F.lit(0).alias("n"), F.lit(-1).alias("bad"))
    return F.aggregate(turns, start, step, lambda s: F.when((s["bad"] < 0) & ~s["role"].isin(*template.last), s["n"]).otherwise(s["bad"]))


def format_chats(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, formatted, segments (text, loss), valid, bad_turn: one row a conversation."""
    text, role = F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role")
    rows = chats.select("conv_id", F.struct("turn", role, text).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def parts(t):
        part = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
        no = F.lit(False)
        return F.array(part(marker(t["role"], template), no), part(escape(t["text"], template), t["role"].isin(*template.loss)), part(F.lit(template.end), no))

    out = grouped.select("conv_id", F.flatten(F.transform("turns", parts)).alias("segments"), walk(F.col("turns"), template).alias("bad_turn"))
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return out.select("conv_id", formatted.alias("formatted"), "segments", (F.col("bad_turn") < 0).alias("valid"), "bad_turn")


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) that a formatted text holds."""
    quote = lambda s: "".join(f"\\x{ord(c):02x}" if ord(c) < 256 and not c.isalnum() else c for c in s)
    marks = "|".join([*map(quote, template.markers.values()), f"{quote(template.other[0])}.*?{quote(template.other[1])}"])
    pattern = F.lit(f"(?s)({marks})(.*?){quote(template.end)}")

    def role(mark):
        a, b = template.other
        out = unescape(F.substr(mark, F.lit(len(a) + 1), F.length(mark) - len(a) - len(b)), template)
        for name, m in template.markers.items():
            out = F.when(mark == m, name).otherwise(out)
        return out

    return F.zip_with(
        F.regexp_extract_all(formatted, pattern, F.lit(1)),
        F.regexp_extract_all(formatted, pattern, F.lit(2)),
        lambda mark, text: F.struct(role(mark).alias("role"), unescape(text, template).alias("text")),
    )


def op6_chat(spark, sf_dir: str) -> DataFrame:
    template = Template()
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    chats = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    out = format_chats(chats, template)
    turns = bind(read_back(F.col("formatted"), template), lambda ts: F.struct(
        F.size(ts).cast("long").alias("n"),
        F.sha2(F.array_join(F.transform(ts, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("sha"),
    ))
    under = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
    loss = bind(under, lambda x: F.struct(F.length(x).cast("long").alias("n"), F.sha2(x.cast("binary"), 256).alias("sha")))
    out = out.select("conv_id", turns.alias("t"), loss.alias("l"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", F.col("bad_turn").cast("long").alias("bad_turn"))
    return out.select("conv_id", F.col("t.n").alias("n_turns"), F.col("t.sha").alias("turns_sha256"), F.col("l.n").alias("loss_chars"), F.col("l.sha").alias("loss_sha256"), "formatted_chars", "valid", "bad_turn")


#: The same digests from the table itself; the machine as a comparison of each role with the one before.
OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS n,
         coalesce(lag(role) OVER w, 'start') || '>' || role AS step,
         length(text) + (length(text) - length(replace(text, '\', '')))
         + (length(text) - length(replace(text, '<<SYS>>', ''))) // 7 + (length(text) - length(replace(text, '[INST]', ''))) // 6
         + (length(text) - length(replace(text, '[/INST]', ''))) // 7 + (length(text) - length(replace(text, '[ROLE]', ''))) // 6
         + (length(text) - length(replace(text, '[/ROLE]', ''))) // 7 + (length(text) - length(replace(text, '</s>', ''))) // 4
         + CASE role WHEN 'system' THEN 7 WHEN 'user' THEN 6 WHEN 'assistant' THEN 7 ELSE 13 + length(role) END + 4 AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), v AS (
  SELECT conv_id, coalesce(min(place) FILTER (step NOT IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')),
         CASE WHEN bool_or(place = n - 1 AND role = 'assistant') THEN -1 ELSE max(n) END)::BIGINT AS bad_turn
  FROM e GROUP BY conv_id
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars, any_value(bad_turn) < 0 AS valid, any_value(bad_turn) AS bad_turn
FROM e JOIN v USING (conv_id) GROUP BY conv_id
"""
