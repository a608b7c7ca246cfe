"""Chat formatting: roles checked by a state machine, texts laid out by a template with a loss mask.

Column expressions only; nothing here runs Python on executors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, ERROR = "start", "error"
# state > role: allowed turns
TURNS = {
    (START, "system"): "system", (START, "user"): "user", ("system", "user"): "user",
    ("user", "assistant"): "assistant", ("assistant", "user"): "user",
}
FINAL = ("user", "assistant")


@dataclass(frozen=True)
class Template:
    """How a turn is written. Marks start with ``control``, which escaped texts never contain."""

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    control: str = "<|"
    loss_roles: tuple[str, ...] = ("assistant",)
    turns: dict = field(default_factory=lambda: dict(TURNS))
    final: tuple[str, ...] = FINAL


CHATML = Template()


def escape(text: Column, template: Template = CHATML) -> Column:
    r"""``\`` becomes ``\\`` and ``<|`` becomes ``<\|``, so no control string is left."""
    first, rest = template.control[0], template.control[1:]
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(template.control), F.lit(f"{first}\\{rest}"))


def unescape(text: Column) -> Column:
    """The text before ``escape``."""
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def role_state(roles: Column, template: Template = CHATML) -> Column:
    """State after all roles; ``error`` from the first role that may not follow."""
    steps = F.create_map(*[F.lit(x) for (state, role), to in template.turns.items() for x in (f"{state}>{role}", to)])
    step = lambda state, role: F.coalesce(F.try_element_at(steps, F.concat(state, F.lit(">"), role)), F.lit(ERROR))
    return F.aggregate(roles, F.lit(START), step)


def format_chats(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per conversation: ``formatted`` text, ``spans`` of it with loss flags, ``valid``.

    Turns are ordered by ``turn``, then role and text, so ties and repeated rows have a
    fixed place; a null turn number comes first. A null text or role is empty; a line
    end in a role becomes a blank. Conversations that break the turn order are
    formatted too, with ``valid`` false. Rows with a null ``conv_id`` are one conversation.
    Other columns are dropped; no rows give no rows.
    """
    rows = turns.select(
        F.col("conv_id"), F.struct(
            F.col("turn"), F.translate(F.coalesce("role", F.lit("")), "\n", " ").alias("role"),
            F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # one head, one text and one tail per turn, as declared
    parts = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(F.concat(F.lit(template.open), escape(t["role"], template), F.lit(template.after_role)).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(t["text"], template).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
        F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
    )))
    state = role_state(F.col("turns.role"), template)
    out = chats.select("conv_id", parts.alias("segments"), state.alias("state"))
    # running starts: sizes of the segments before
    sized = F.aggregate(
        "segments",
        F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int,loss:boolean>>").alias("spans")),
        lambda acc, s: F.struct(
            (acc["at"] + F.char_length(s["text"])).alias("at"),
            F.concat(acc["spans"], F.array(F.struct(
                acc["at"].alias("start"), F.char_length(s["text"]).alias("length"), s["loss"].alias("loss")))).alias("spans")),
    )
    return out.select(
        "conv_id", F.array_join("segments.text", "").alias("formatted"), sized["spans"].alias("spans"), "state",
        F.col("state").isin(*template.final).alias("valid"))


def turns_of(formatted: Column, template: Template = CHATML) -> Column:
    """Turns (``role``, ``text``) read back from formatted text."""
    split = F.split(formatted, "\\Q" + template.open + "\\E")
    pieces = F.slice(split, F.lit(2), F.size(split))

    def turn(p: Column) -> Column:
        cut = F.instr(p, template.after_role)
        body = F.substr(p, cut + F.lit(len(template.after_role)))
        return F.struct(
            unescape(F.substr(p, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substr(body, F.lit(1), F.char_length(body) - F.lit(len(template.close)))).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: unescape(F.substr(formatted, s["start"], s["length"]))), "")
