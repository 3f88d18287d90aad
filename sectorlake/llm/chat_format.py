"""Chat formatting: a declared template and a finite-state machine over roles, all in DataFrame functions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn, roles whose text carries loss, and the allowed steps between roles.

    A turn is written ``open role middle text close``.  Every mark must begin with a character of
    ``escaped`` followed by one that isn't ``escape``: inside roles and texts such characters get
    ``escape`` behind them, so that no mark can occur there and the way back is unique.
    """

    open: str = "<|"
    middle: str = "|>\n"
    close: str = "<|end|>\n"
    escape: str = "\\"
    escaped: str = "<|\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    steps: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )

    def escape_column(self, text: Column) -> Column:
        return F.regexp_replace(text, f"([{self._class()}])", "$1" + self._quoted())

    def unescape_column(self, text: Column) -> Column:
        return F.regexp_replace(text, f"([{self._class()}])" + self._quoted(), "$1")

    def _class(self) -> str:
        return "".join("\\" + c for c in self.escaped)

    def _quoted(self) -> str:
        return "\\" + self.escape


DEFAULT = Template()


def format_conversations(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row per conv_id: (conv_id, n_turns, segments, formatted, valid, first_bad_turn).

    ``segments`` is an array of (text, loss) in order and ``formatted`` its concatenation; loss
    covers exactly the texts of the template's loss roles.  Rows are ordered by turn (nulls first),
    then role, then text, so that repeated turns have one order.  A null text or role is empty.
    The state machine only judges (``valid``; ``first_bad_turn`` is the position of the first turn
    that it refuses): each conversation is formatted whole.  Rows of a null conv_id form one
    conversation.  An empty table gives no rows; columns beyond the four are ignored.

    A conversation is one training example and thus one row; it is the only thing that is gathered.
    """
    clean = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    grouped = clean.groupBy("conv_id").agg(turns.alias("turns"))

    allowed = F.create_map(*[F.lit(x) for s, nexts in template.steps.items() for r in nexts for x in (f"{s}>{r}", r)])
    step = lambda state, turn: F.coalesce(
        F.try_element_at(allowed, F.concat(state["state"], F.lit(">"), turn["role"])), F.lit("")
    )
    start = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("bad"))
    fold = F.aggregate(
        "turns", start,
        lambda s, t: F.struct(
            step(s, t).alias("state"),
            (s["at"] + 1).alias("at"),
            F.when((s["bad"] < 0) & (step(s, t) == ""), s["at"]).otherwise(s["bad"]).alias("bad"),
        ),
    )
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                segment(F.concat(F.lit(template.open), template.escape_column(t["role"]), F.lit(template.middle)), F.lit(False)),
                segment(template.escape_column(t["text"]), t["role"].isin(*template.loss_roles)),
                segment(F.lit(template.close), F.lit(False)),
            ),
        )
    )
    return grouped.select("conv_id", F.size("turns").cast("long").alias("n_turns"), segments.alias("segments"), fold["bad"].alias("bad")).select(
        "conv_id", "n_turns", "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("bad") < 0).alias("valid"),
        F.when(F.col("bad") >= 0, F.col("bad")).cast("int").alias("first_bad_turn"),
    )


def read_turns(formatted: Column, template: Template = DEFAULT) -> Column:
    """Array of (role, text) read back from a formatted string alone."""
    quote = lambda mark: "\\Q" + mark + "\\E"
    parts = F.split(formatted, quote(template.close))
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(part: Column) -> Column:
        pair = F.split(part, quote(template.middle), 2)
        role = F.substr(pair[0], F.lit(len(template.open) + 1))
        return F.struct(template.unescape_column(role).alias("role"), template.unescape_column(pair[1]).alias("text"))

    return F.transform(parts, turn)


def loss_text(segments: Column, template: Template = DEFAULT) -> Column:
    """All text under the loss mask, unescaped, in order."""
    masked = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(masked, lambda s: template.unescape_column(s["text"])), "")
