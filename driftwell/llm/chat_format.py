"""Conversations as training text: a finite-state machine over roles, and segments with loss flags.

A :class:`Template` declares all: how each role opens a turn, what ends one, which roles' texts
are learned, and the machine (which role may follow in which state, where a conversation may
end). Everything is a column expression; there is one shuffle, by conversation.

Control strings inside texts are replaced by codes that begin with a backslash, and backslashes by a
code too, so no text holds a control string once it is escaped, and every backslash begins a code. Codes
are replaced one kind after the other and undone in the opposite order, which is exact.

A conversation is one row of the result, as one training sequence is; so it must fit in a row (2 GB).

Defined cases: turns are ordered by turn, role and text, nulls first, so ties and repeated rows
stay and have one order; a null text is empty; a null role reads as an empty one; roles that the
template doesn't name keep their name in the opening, break the order and are not learned. Rows
with a null id are one conversation. A conversation out of order is formatted all the same:
``valid`` is false and ``bad_turn`` says where (one past the end where it may not stop there). An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, NOWHERE = "start", "nowhere"
ESCAPE = "\\"
SEGMENTS = "array<struct<text string, loss boolean>>"


@dataclass(frozen=True)
class Template:
    """``mark``: begins each opening; ``names``: what stands for each role there; ``colon``: ends the
    opening; ``end``: ends a turn. ``moves``: for each state the roles that may come next and the
    state each leads to; ``final``: states where a conversation may end. ``learned``: roles whose
    texts carry the loss; ``learn_end``: and the ends of their turns too."""

    mark: str = "### "
    colon: str = ": "
    end: str = "</turn>"
    names: Mapping[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    moves: Mapping[str, Mapping[str, str]] = field(
        default_factory=lambda: {
            START: {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"},
        }
    )
    final: tuple[str, ...] = ("assistant",)
    learned: tuple[str, ...] = ("assistant",)
    learn_end: bool = False

    def __post_init__(self):
        control, names = (self.mark.strip(), self.colon, self.end), [*self.names.values()]
        if not all(control) or any(c == ESCAPE or c.isdigit() for text in control for c in text):
            raise ValueError("marks can't be empty or hold backslashes or digits, as codes do")
        if self.mark.strip() in self.end or self.end in self.mark or any(self.end[:n] == self.end[-n:] for n in range(1, len(self.end))):
            raise ValueError("one mark holds the other, or the end of a turn could begin inside itself")
        if len(set(names)) < len(names) or any(not n or n[0] == "?" or any(c in n for c in (*control, ESCAPE)) for n in names):
            raise ValueError("names of roles must differ, hold no mark or backslash and not begin with a question mark")

    # Codes in the order in which they are put in; the backslash comes first.
    def codes(self) -> list[tuple[str, str]]:
        return [(ESCAPE, ESCAPE + "0"), (self.end, ESCAPE + "1"), (self.mark.strip(), ESCAPE + "2")]

    def escape(self, text: Column) -> Column:
        for plain, code in self.codes():
            text = F.replace(text, F.lit(plain), F.lit(code))
        return text

    def unescape(self, text: Column) -> Column:
        for plain, code in reversed(self.codes()):
            text = F.replace(text, F.lit(code), F.lit(plain))
        return text

    def opening(self, role: Column) -> Column:
        """Other roles keep their name, behind a question mark; a colon in it gets a code as well."""
        named = F.replace(F.concat(F.lit("?"), self.escape(role)), F.lit(self.colon), F.lit(ESCAPE + "3"))
        for given, name in self.names.items():
            named = F.when(role == given, F.lit(name)).otherwise(named)
        return F.concat(F.lit(self.mark), named, F.lit(self.colon))

    def role_of(self, named: Column) -> Column:
        """The role that :meth:`opening` named."""
        role = self.unescape(F.replace(F.substring(named, 2, 2**31 - 1), F.lit(ESCAPE + "3"), F.lit(self.colon)))
        for given, name in self.names.items():
            role = F.when(named == name, F.lit(given)).otherwise(role)
        return role


def walk(template: Template, roles: Column) -> Column:
    """``state, place, bad`` after the roles of a conversation: the machine's last state, the number
    of turns, and the first turn that no move allows (null if there is none)."""

    def step(at: Column, role: Column) -> Column:
        after = F.lit(NOWHERE)
        for state, moves in template.moves.items():
            for given, then in moves.items():
                after = F.when((at["state"] == state) & (role == given), F.lit(then)).otherwise(after)
        place = at["place"] + 1
        return F.struct(after.alias("state"), place.alias("place"), F.coalesce(at["bad"], F.when(after == NOWHERE, place)).alias("bad"))

    begin = F.struct(F.lit(START).alias("state"), F.lit(0).alias("place"), F.lit(None).cast("int").alias("bad"))
    return F.aggregate(roles, begin, step)


def format_conversations(turns: DataFrame, template: Template, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``id, segments, valid, bad_turn``: for each turn an opening, the escaped text and the end, each
    with its loss flag. All texts of the segments in a row are the formatted conversation."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turn = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    whole = turns.groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def segments(t: Column) -> Column:
        learned = t["role"].isin(*template.learned)
        parts = (template.opening(t["role"]), F.lit(False)), (template.escape(t["text"]), learned), (F.lit(template.end + "\n"), learned & F.lit(template.learn_end))
        return F.array(*[F.struct(s.alias("text"), loss.alias("loss")) for s, loss in parts])

    walked = whole.select("id", "turns", walk(template, F.transform("turns", lambda t: t["role"])).alias("end"))
    bad = F.coalesce("end.bad", F.when(~F.col("end.state").isin(*template.final), F.col("end.place") + 1))
    formed = walked.select("id", F.flatten(F.transform("turns", segments)).alias("segments"), bad.alias("bad_turn"))
    return formed.select(F.col("id").alias(id_col), F.col("segments").cast(SEGMENTS).alias("segments"), F.col("bad_turn").isNull().alias("valid"), "bad_turn")


def formatted(segments: Column) -> Column:
    """The whole text."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def learned_text(template: Template, segments: Column) -> Column:
    """The text under the loss mask, as it was before escaping."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")


def read_turns(template: Template, whole: Column) -> Column:
    """``array<struct<role, text>>`` of a formatted text: it is cut at the ends of turns, which no
    escaped text holds."""
    pieces = F.split(whole, "\\Q" + template.end + "\n\\E")

    def one(piece: Column) -> Column:
        body = F.substring(piece, len(template.mark) + 1, 2**31 - 1)
        named = F.substring_index(body, template.colon, 1)
        text = body.substr(F.length(named) + len(template.colon) + 1, F.lit(2**31 - 1))
        return F.struct(template.role_of(named).alias("role"), template.unescape(text).alias("text"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), one)
