"""Chat formatting: a template, a state machine over roles, and segments with loss flags.

Everything is DataFrame expressions.  A conversation's rows, by turn, become segments
``(text, loss)``: a header with the role, the text, a footer.  Control strings in texts and
roles are escaped reversibly, so a marker in the output always comes from the template, and ``parse`` gives
the turns back from the formatted string alone.

The state machine's state is the role of the turn before (or the start); a turn is legal
if the template allows its role there, and the conversation is ``valid`` if all turns are and it
ends in an accepting role.  Invalid conversations are formatted too and flagged, with the first
offending position in ``bad_turn`` (-1: none, n_turns: the end).

Defined results: null text is empty, null role is the empty role (never legal); equal turns
are ordered by role, then text; repeated rows are turns of their own; null conv_id is a
conversation; an empty table gives no rows.  A conversation's output is one string, so it is bounded by what a
string may hold (2 GB); its rows meet in one task because its output does.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    stop: str = "<|im_end|>\n"
    control: str = "<|"
    loss_roles: tuple[str, ...] = ("assistant",)
    accepting: tuple[str, ...] = ("assistant",)
    #: state -> roles that may follow; "" is the start
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})

    def __post_init__(self):
        if not (self.start.startswith(self.control) and self.stop.startswith(self.control)) or "\\" in self.start + self.stop or len(self.control) < 2:
            raise ValueError("markers must begin with the control string and hold no backslash")


def escape(text: Column, template: Template) -> Column:
    """Double backslashes, then break up the control string by one: its own can't occur any more."""
    c = template.control
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(c), F.lit(c[0] + "\\" + c[1:]))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def format_conversations(rows: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, segments array<struct<text, loss>>, formatted, n_turns, valid, bad_turn)``."""
    t = template
    who = F.coalesce(rows[role].cast("string"), F.lit(""))
    turns = (
        rows.select(rows[conv].alias("conv_id"), F.struct(rows[turn].alias("turn"), who.alias("role"), F.coalesce(rows[text].cast("string"), F.lit("")).alias("text")).alias("one"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("one")).alias("turns"))
    )
    loss = lambda r: r.isin(*t.loss_roles)
    head = lambda r: F.concat(F.lit(t.start), F.replace(escape(r, t), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                F.struct(head(x["role"]).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(x["text"], t).alias("text"), loss(x["role"]).alias("loss")),
                F.struct(F.lit(t.stop).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    allowed = F.create_map(*[F.lit(v) for state, roles in t.moves.items() for v in (state, "\n".join(("", *roles, "")))])
    # the machine: the state and the first position where it had no move
    begin = F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("bad"))

    def step(s: Column, x: Column) -> Column:
        legal = F.coalesce(F.contains(allowed[s["state"]], F.concat(F.lit("\n"), x["role"], F.lit("\n"))), F.lit(False)) & (x["role"] != "")
        return F.struct(x["role"].alias("state"), (s["at"] + 1).alias("at"), F.when((s["bad"] < 0) & ~legal, s["at"]).otherwise(s["bad"]).alias("bad"))

    run = turns.select("conv_id", segments.alias("segments"), F.size("turns").cast("long").alias("n_turns"), F.aggregate("turns", begin, step).alias("machine"))
    bad = F.when(F.col("machine.bad") >= 0, F.col("machine.bad")).when(~F.col("machine.state").isin(*t.accepting), F.col("machine.at")).otherwise(F.lit(-1))
    return run.select("conv_id", "segments", F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"), "n_turns", (bad < 0).alias("valid"), bad.alias("bad_turn"))


def parse(formatted: Column, template: Template = Template()) -> Column:
    """``array<struct<role, text>>`` of a formatted string."""
    blocks = F.split(formatted, _quoted(template.stop))
    whole = F.filter(blocks, lambda b: F.startswith(b, F.lit(template.start)))
    body = lambda b: F.substring(b, F.lit(len(template.start) + 1), F.length(b))
    header = r"(?s)^((?:[^\\\n]|\\.)*+)\n(.*)$"
    return F.transform(whole, lambda b: F.struct(unescape(F.regexp_extract(body(b), header, 1)).alias("role"), unescape(F.regexp_extract(body(b), header, 2)).alias("text")))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.concat_ws("", F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])))


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """What a reader gets back from ``format_conversations``."""
    read = formatted.select("conv_id", parse(F.col("formatted"), template).alias("turns"), loss_text(F.col("segments")).alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "bad_turn")
    joined = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars", "valid", "bad_turn",
    )
