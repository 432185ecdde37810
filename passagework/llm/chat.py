"""Chat formatting: a finite-state machine over roles and a declarative template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.arrow import map_rows

SEGMENTS = "conv_id long, segment long, role string, kind string, text string, loss boolean, in_order boolean, complete boolean"


@dataclass(frozen=True)
class Template:
    """How a turn is written, which turns are learned, and which role may follow which.

    ``lead`` begins every mark; ``escape`` is put into texts so that no mark can begin there.
    """

    turn_open: str = "<|im_start|>"
    role_end: str = "\n"
    turn_close: str = "<|im_end|>\n"
    lead: str = "<|"
    escape: str = "\\"
    learned: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    follows: dict[str, frozenset[str]] = field(default_factory=lambda: {
        "start": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}),
        "assistant": frozenset({"user"})})
    final: frozenset[str] = frozenset({"assistant"})

    def guard(self, text: str) -> str:
        """``text`` with every escape doubled and every lead broken by one."""
        return text.replace(self.escape, self.escape * 2).replace(self.lead, self.lead[0] + self.escape + self.lead[1:])

    def unguard(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.S) if self.escape in text else text

    def guard_role(self, role: str) -> str:
        """A role stands on one line: its line feeds become escape and ``n``, which texts never need."""
        return self.guard(role).replace("\n", self.escape + "n")

    def unguard_role(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments of every conversation in order: mark, text, mark for each turn, with a loss flag for each segment.

    ``turns`` has ``conv_id``, ``turn``, ``role`` and ``text``; other columns are not read.  Null role and text count as
    empty, a null ``conv_id`` is a conversation of its own.  Rows are taken by turn (null first), rows of the same turn
    by role and text.  ``in_order`` says whether the turns so far obey the role machine, ``complete`` whether a
    conversation ending with this segment would.  A conversation in a wrong order is formatted all the same: callers
    filter by the flags.  The joined ``text`` of a conversation's segments is the training string.

    One shuffle by conversation; rows are streamed in order, so a conversation of any length needs the memory of a batch.
    """
    ready = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = ready.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def segments(rows: Iterator[dict]) -> Iterator[tuple]:
        conv, state, ok, n = object(), template.start, True, 0
        for r in rows:
            if r["conv_id"] != conv:
                conv, state, ok, n = r["conv_id"], template.start, True, 0
            role = r["role"]
            ok = ok and role in template.follows.get(state, ())
            state = role
            done = ok and state in template.final
            for kind, text, loss in (
                    ("open", template.turn_open + template.guard_role(role) + template.role_end, False),
                    ("text", template.guard(r["text"]), role in template.learned), ("close", template.turn_close, False)):
                yield conv, n, role, kind, text, loss, ok, done
                n += 1

    return map_rows(dealt, segments, SEGMENTS)


def read_back(segments: DataFrame, template: Template = Template(), dealt: bool = False) -> DataFrame:
    """Parse the formatted text again: per conversation its turns, the text under the loss flags and the length.

    Only ``text`` and ``loss`` of the segments are used for the digests, the roles are read from the marks.  ``dealt``:
    the segments come straight from :func:`format_conversations`, so a conversation's rows stand together in order.
    """
    cols = segments.select("conv_id", "segment", "text", "loss", "in_order", "complete")
    rows = cols if dealt else cols.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    whole = template.turn_open, template.role_end, template.turn_close

    def parse(parts: Iterator[dict]) -> Iterator[tuple]:
        conv, now = object(), None

        def closed() -> tuple:
            if now["rest"]:
                raise ValueError(f"conversation {conv}: the formatted text ends inside a turn")
            return (conv, now["turns"], now["digest"].hexdigest(), now["loss_chars"], now["loss"].hexdigest(), now["chars"],
                    now["valid"])

        for p in parts:
            if p["conv_id"] != conv or now is None:
                if now is not None:
                    yield closed()
                conv = p["conv_id"]
                now = {"rest": "", "turns": 0, "digest": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0,
                       "valid": False}
            now["chars"] += len(p["text"])
            now["valid"] = p["complete"]
            if p["loss"]:
                learned = template.unguard(p["text"])
                now["loss_chars"] += len(learned)
                now["loss"].update(learned.encode("utf-8", "surrogatepass"))
            now["rest"] += p["text"]
            while now["rest"].startswith(whole[0]) and (end := now["rest"].find(whole[2])) >= 0:
                head, body = now["rest"][len(whole[0]):end].split(whole[1], 1)
                now["rest"] = now["rest"][end + len(whole[2]):]
                turn = f"{template.unguard_role(head)}\n{template.unguard(body)}\n"
                now["digest"].update(turn.encode("utf-8", "surrogatepass"))
                now["turns"] += 1
        if now is not None:
            yield closed()

    return map_rows(
        rows, parse, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
        "valid boolean")
