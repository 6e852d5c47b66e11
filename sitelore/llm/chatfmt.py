"""Chat formatting by a finite-state machine over roles, in DataFrame functions only.

A declarative template names the control strings, the roles that carry loss and
the moves of the machine.  Texts and roles are escaped so that no control string
can arise inside them; ``unescape`` gives them back exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``moves``: state and role to the next state; a state is named for the role last seen.

    A turn carries loss if the machine is in one of ``loss_states`` after it.  A
    role that has no move from a state is out of order: the machine counts it and
    goes on from the role's own state, ``unknown`` if the template has none such.
    Control strings must begin with ``<|``.
    """

    open: str = "<|im_start|>"
    close: str = "<|im_end|>"
    gap: str = "\n"
    loss_states: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accept: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant",
            ("assistant", "user"): "user", ("assistant", "tool"): "tool", ("tool", "tool"): "tool", ("tool", "assistant"): "assistant",
        }
    )

    @property
    def letters(self) -> dict[str, str]:
        """A letter for each state, the start and ``unknown``."""
        named = sorted(set(self.moves.values()) | set(self.accept) | set(self.loss_states))
        return {name: chr(97 + i) for i, name in enumerate([self.start, *named, "unknown"])}

    @property
    def table(self) -> dict[str, str]:
        """The machine: letter and role to the letter that is put out, a capital one where the role is out of order."""
        letters, roles = self.letters, {role for _, role in self.moves}
        after = {(state, role): letters[self.moves[state, role]] if (state, role) in self.moves else letters.get(role, letters["unknown"]).upper() for state in letters for role in roles}
        return {mark + role: to for (state, role), to in after.items() for mark in (letters[state], letters[state].upper())}


#: Turns that an inner fold goes through: what a fold has put out is copied at each of its steps, so it is kept short.
CHUNK = 256

CHAT = Template()


def escape(text: Column, *, one_line: bool = False) -> Column:
    """Backslashes are doubled and ``<|`` is parted by one; a line feed becomes backslash, n if asked for."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if one_line else out


def unescape(text: Column, *, one_line: bool = False) -> Column:
    """The inverse: between doubled backslashes, found from the left, each other backslash is an escape."""

    def part(x: Column) -> Column:
        x = F.replace(x, F.lit("<\\|"), F.lit("<|"))
        return F.replace(x, F.lit("\\n"), F.lit("\n")) if one_line else x

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def _machine(rows: Column, template: Template) -> Column:
    """The machine's run over a conversation's rows: the start's letter, then one for each turn.

    A fold copies its accumulator at each step, so texts stay out of it, and it is
    one of chunks over one of turns: linear in effect for any number of turns.
    """
    table = F.create_map(*[F.lit(x) for pair in sorted(template.table.items()) for x in pair])
    last = lambda run: F.substring(run, -1, 1)

    def turn(run: Column, place: Column) -> Column:
        return F.concat(run, F.coalesce(F.try_element_at(table, F.concat(last(run), F.get(rows, place)["role"])), F.lit(template.letters["unknown"].upper())))

    def chunk(run: Column, part: Column) -> Column:
        places = F.sequence(part * CHUNK, F.least(part * CHUNK + (CHUNK - 1), F.size(rows) - 1))
        return F.aggregate(places, last(run), turn, lambda own: F.concat(run, F.substr(own, F.lit(2))))

    return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / CHUNK).cast("int")), F.lit(template.letters[template.start]), chunk)


def format_chats(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per conversation: conv_id, n_turns, state, valid, misplaced, formatted, segments.

    ``turns(conv_id, turn, role, text)``: rows in order of turn, then role and
    text where turns tie, null turns first; null roles and texts are empty.  The
    machine goes through them once and puts out a letter for each: the state that
    it is in then, which gives the text its loss flag, and whether the turn is in order.  ``state`` is
    the last one, ``misplaced`` how many turns were out of order, ``valid`` tells
    that none was and that the state accepts; conversations that aren't are
    formatted all the same.  ``segments`` are the pieces of ``formatted`` in order,
    each with its loss flag.  Repeated rows are turns of their own; rows of a null
    id make one conversation; other columns are ignored; an empty table gives no
    rows.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.select("conv_id", row.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    out = chats.select("conv_id", "rows", _machine(F.col("rows"), template).alias("run"))
    loss = [template.letters[s] for s in template.loss_states]

    def pieces(row: Column, mark: Column) -> Column:
        segment = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
        lead = F.concat(F.lit(template.open), escape(row["role"], one_line=True), F.lit("\n"))
        flag = F.coalesce(F.lower(mark).isin(*loss), F.lit(False))
        return F.array(segment(lead, F.lit(False)), segment(escape(row["text"]), flag), segment(F.lit(template.close + template.gap), F.lit(False)))

    names = F.create_map(*[F.lit(x) for name, letter in template.letters.items() for x in (letter, name)])
    order = F.col("misplaced") == 0
    out = out.select(
        "conv_id", F.size("rows").cast("long").alias("n_turns"), F.try_element_at(names, F.lower(F.substring("run", -1, 1))).alias("state"),
        F.length(F.regexp_replace("run", "[^A-Z]", "")).cast("long").alias("misplaced"), F.flatten(F.zip_with("rows", F.split(F.substr("run", F.lit(2)), ""), pieces)).alias("segments"),
    )
    return out.select("conv_id", "n_turns", "state", (order & F.col("state").isin(*template.accept)).alias("valid"), "misplaced", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def parse(formatted: Column, template: Template = CHAT) -> Column:
    """The (role, text) turns of a formatted conversation."""
    parts = F.filter(F.split(formatted, F.lit("\\Q" + template.open + "\\E"), -1), lambda _, i: i > 0)

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substr(part, F.length(role) + 2)
        return F.struct(unescape(role, one_line=True).alias("role"), unescape(F.substring_index(body, template.close, 1)).alias("text"))

    return F.transform(parts, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
