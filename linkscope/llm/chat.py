"""Operator 2, chat formatting by a finite-state machine over roles.

A template declares, for each role, the marks before and after its text, whether the text is learnt, and which roles may follow. The machine
walks through the turns in order and emits segments of text with a loss flag; control strings inside texts are escaped, and the reader,
a second machine, takes the segments apart again.

Turns are sorted in their partition and flow through both machines one by one; a conversation of any length takes the memory of one turn.
A digest over a whole conversation is sequential by nature, so one conversation is one task's work, but never held as a whole.

Defined results: a null role is '' and a null text is empty; roles that the template does not know get the general marks; turns that break
the order are still formatted, and the conversation is marked as not valid; turns with the same number go by role and text; rows without
a conversation id form one conversation; repeated rows are repeated turns; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkscope.llm.common import quoted

ESCAPE = "\\"


@dataclass(frozen=True)
class Role:
    before: str
    after: str
    learnt: bool = False
    follows: tuple[str, ...] = ()


@dataclass(frozen=True)
class ChatTemplate:
    """follows: the roles after which a role may come, START for the beginning; an end is valid after a role in ends."""

    roles: dict[str, Role] = field(
        default_factory=lambda: {
            "system": Role("[SYS]", "[/SYS]", follows=("START",)),
            "user": Role("[INST]", "[/INST]", follows=("START", "system", "assistant")),
            "assistant": Role("[ANS]", "</s>", learnt=True, follows=("user",)),
        }
    )
    other: Role = field(default_factory=lambda: Role("[ROLE]", "[/ROLE]"))
    named: str = "[IS]"
    ends: tuple[str, ...] = ("assistant",)
    extra_controls: tuple[str, ...] = ("<s>",)

    @cached_property
    def controls(self) -> re.Pattern:
        own = {x for r in (*self.roles.values(), self.other) for x in (r.before, r.after)} | {self.named, *self.extra_controls}
        if any(len(x) < 2 or ESCAPE in x for x in own):
            raise ValueError("control strings take two characters, none of them the escape")
        return re.compile("|".join(map(re.escape, sorted(own, key=lambda x: (-len(x), x)))))

    def escape(self, text: str) -> str:
        """Doubles the escape character, and puts one inside each control string."""
        return self.controls.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text.replace(ESCAPE, ESCAPE * 2))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        mark = self.roles.get(role)
        if mark:
            return [(mark.before, False), (self.escape(text), mark.learnt), (mark.after, False)]
        return [(self.other.before + self.escape(role) + self.named, False), (self.escape(text), self.other.learnt), (self.other.after, False)]

    def allows(self, before: str, role: str) -> bool:
        return role in self.roles and before in self.roles[role].follows


@dataclass
class TurnMachine:
    """State of one conversation while it is written: the last role and whether all went by the rules."""

    template: ChatTemplate
    state: str = "START"
    valid: bool = True

    def turn(self, role: str, text: str) -> list[tuple[str, bool]]:
        self.valid = self.valid and self.template.allows(self.state, role)
        self.state = role
        return self.template.segments(role, text)

    def end(self) -> bool:
        return self.valid and self.state in self.template.ends


class ReadMachine:
    """Takes the formatted text in any pieces and gives the turns; waits for the end of a turn, and holds no more than one."""

    def __init__(self, template: ChatTemplate) -> None:
        self.template, self.held = template, ""
        self.by_mark = {r.before: (name, r) for name, r in template.roles.items()}

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        self.held += text
        while self.held:
            start = self.template.controls.match(self.held)
            if not start:
                if len(self.held) < 64:
                    return
                raise ValueError(f"no turn begins at {self.held[:40]!r}")
            name, role = self.by_mark.get(start[0], (None, self.template.other))
            body = start.end()
            stop = self.template.controls.search(self.held, body)
            if stop and name is None:
                name, body = self.template.unescape(self.held[body : stop.start()]), stop.end()
                stop = self.template.controls.search(self.held, body)
            if not stop:
                return
            if stop[0] != role.after:
                raise ValueError(f"{stop[0]!r} inside a turn that ends with {role.after!r}")
            yield name, self.template.unescape(self.held[body : stop.start()])
            self.held = self.held[stop.end() :]


SEGMENTS = "conv_id {id}, turn long, segment int, text string, loss boolean, ends boolean, valid boolean"


def _rows(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            some = batch.slice(at, 1024)
            yield from zip(*(some.column(c).to_pylist() for c in columns), strict=True)


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: ChatTemplate | None = None) -> DataFrame:
    """Segments in order: conv_id, turn, segment, text, loss; the last row of a conversation has ends set, and says whether it is valid."""
    template = template or ChatTemplate()
    slim = turns.select(quoted(conv_col).alias("conv_id"), quoted(turn_col).cast("long").alias("turn"), F.coalesce(quoted(role_col), F.lit("")).alias("role"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    kind = slim.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        machine, now = None, None
        id_type: list[pa.DataType] = []

        def typed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                id_type[:] = [batch.schema.field("conv_id").type]
                yield batch

        def sent() -> pa.RecordBatch:
            kinds = (id_type[0], pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["conv_id", "turn", "segment", "text", "loss", "ends", "valid"])

        for conv_id, turn, role, text in _rows(typed(batches), ("conv_id", "turn", "role", "text")):
            if machine is None or conv_id != now:
                if machine is not None:
                    held.append((now, None, None, "", False, True, machine.end()))
                machine, now = TurnMachine(template), conv_id
            held += [(conv_id, turn, i, piece, loss, False, None) for i, (piece, loss) in enumerate(machine.turn(role, text))]
            if len(held) >= 4096:
                yield sent()
                held = []
        if machine is not None:
            held.append((now, None, None, "", False, True, machine.end()))
            yield sent()

    ordered = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, SEGMENTS.format(id=kind.simpleString()))


def read_back(segments: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Per conversation, from its segments in the order in which ``formatted`` gives them: counts and digests of turns and of learnt text."""
    template = template or ChatTemplate()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh() -> dict:
            return {"reader": ReadMachine(template), "turns": hashlib.sha256(), "loss": hashlib.sha256(), "n_turns": 0, "loss_chars": 0, "chars": 0}

        one, out = fresh(), []
        for conv_id, text, loss, ends, valid in _rows(batches, ("conv_id", "text", "loss", "ends", "valid")):
            one["chars"] += len(text)
            if loss:
                learnt = template.unescape(text)
                one["loss"].update(learnt.encode("utf-8", "surrogatepass"))
                one["loss_chars"] += len(learnt)
            for role, said in one["reader"].feed(text):
                one["turns"].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                one["n_turns"] += 1
            if ends:
                if one["reader"].held:
                    raise ValueError("a conversation ends inside a turn")
                out.append({"conv_id": conv_id, "n_turns": one["n_turns"], "turns_sha256": one["turns"].hexdigest(), "loss_chars": one["loss_chars"], "loss_sha256": one["loss"].hexdigest(), "formatted_chars": one["chars"], "valid": valid})
                one = fresh()
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    kind = segments.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])
    return segments.mapInArrow(run, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every conversation of the table, and conversation -1."""
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(formatted(turns.unionByName(more)))
