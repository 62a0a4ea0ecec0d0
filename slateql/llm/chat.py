"""Chat formatting: a finite-state machine over roles and a declarative template.

Turns are ordered by (turn, role, text), nulls first. Each turn takes the machine from its state to the
one that its role enters, and becomes a list of segments (text, loss): an opening mark, the
escaped text, a closing mark. The state entered carries the loss flag of the turn's text, and the
table of transitions says whether the turn was in order. Control strings inside texts are broken up
by an escape character, reversibly, so a formatted text contains a control
string only where the template put it.

Rows are dealt by conversation, sorted, and streamed: the machine keeps one
state and one counter a conversation, so a conversation with any number of
turns needs no more memory than one batch. A conversation is read by one task, as its turns have one order.

Defined cases: null text and null role are empty strings; a null turn sorts
first; rows with a null conversation id form one conversation. A turn out of order, or of an empty or
unknown role, has ``valid`` false and a ``reason``, but is formatted all the same, and the machine goes on
from the state it entered: that of its role, or ``UNKNOWN``, from which no turn is in
order. Repeated rows are turns of their own. Very long texts are formatted whole. An empty table gives no rows. Conversation
ids are integers (or cast to them). Only the four columns named are read, so others may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Marks, the strings that must not occur in texts, and the machine's table."""

    open_mark: str = "<|turn|>{role}<|text|>"
    close_mark: str = "<|end|>"
    control: tuple[str, ...] = ("<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    escape: str = "\\"
    start: str = "start"
    #: role -> state that its turns enter
    enters: dict[str, str] = field(default_factory=lambda: {r: r for r in ("system", "user", "assistant")})
    #: states whose texts are trained on
    loss: tuple[str, ...] = ("assistant",)
    #: state -> states that may follow
    order: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    #: states in which a conversation may end
    final: tuple[str, ...] = ("user", "assistant")

    def __post_init__(self):
        if any(self.escape in c or len(c) < 2 for c in self.control):
            raise ValueError("control strings need two characters or more, none of them the escape character")

    @property
    def _escapable(self) -> re.Pattern:
        starts = [f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.control]
        return re.compile("|".join([re.escape(self.escape), *starts]))

    def escaped(self, text: str) -> str:
        """Doubles escape characters and puts one inside every control string."""
        return self._escapable.sub(lambda m: m[0] + self.escape, text)

    def unescaped(self, text: str) -> str:
        e = re.escape(self.escape)
        return re.sub(f"{e}({e})?", lambda m: m[1] or "", text)

    def parse_open(self, mark: str) -> str:
        """The role in an opening mark."""
        before, after = self.open_mark.split("{role}")
        return self.unescaped(mark[len(before) : len(mark) - len(after)])


SEGMENTS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("turn_no", pa.int64()),
        ("segments", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))),
        ("state", pa.string()),
        ("valid", pa.bool_()),
        ("reason", pa.string()),
    ]
)
SEGMENTS_DDL = "conv_id bigint, turn_no bigint, segments array<struct<text:string,loss:boolean>>, state string, valid boolean, reason string"


UNKNOWN = "unknown"


def step(template: ChatTemplate, state: str, role: str) -> tuple[str, str | None]:
    """The state entered, and why the turn is out of order, if it is."""
    to = template.enters.get(role, UNKNOWN)
    return to, None if to in template.order.get(state, ()) else f"{role or 'no role'} after {state}"


def format_conversations(df: DataFrame, template: ChatTemplate | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn, in order within a partition: conv_id, turn_no (from 0), segments, the state entered, valid, reason."""
    template = template or ChatTemplate()
    rows = df.select(F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began, conv, no, state = False, None, 0, template.start
        for batch in batches:
            out = {name: [] for name in SEGMENTS.names}
            for c, r, t in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if not began or c != conv:
                    began, conv, no, state = True, c, 0, template.start
                state, reason = step(template, state, r)
                segments = [(template.open_mark.format(role=template.escaped(r)), False), (template.escaped(t), state in template.loss), (template.close_mark, False)]
                for name, value in zip(SEGMENTS.names, (c, no, [{"text": s, "loss": x} for s, x in segments], state, reason is None, reason)):
                    out[name].append(value)
                no += 1
            yield pa.RecordBatch.from_pydict(out, schema=SEGMENTS)

    return dealt.mapInArrow(emit, SEGMENTS_DDL)
