r"""Chat formatting by a finite-state machine over roles and a declarative template.

Conversations stream through sorted partitions one row at a time, so a conversation of any length
needs the memory of one turn. The output is a table of text segments with a loss flag each; joined
in order they are the formatted text. ``read_back`` parses the segments again.

Escapes: in a text, ``\`` becomes ``\\`` and a control string gets ``\.`` after its first character,
so that no control string of the template stays in it. Both are undone by reading ``\\`` as ``\`` and
``\.`` as nothing, from left to right.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What opens and closes a turn, per role, and whether its text is learned.

    A role that is not listed takes ``other``; its name stands between ``name_end`` and the
    opening string. ``turns`` is the state machine: the roles that may follow a state, where the
    state is the role before and ``start`` or ``end``.
    """

    begin: str = "<s>"
    turns_of: dict = field(
        default_factory=lambda: {
            "system": ("<<SYS>>", "<</SYS>>", False),
            "user": ("[INST]", "[/INST]", False),
            "assistant": ("<|assistant|>", "</s>", True),
        }
    )
    other: tuple = ("<|role|>", "<|end|>", False)
    name_end: str = "<|text|>"
    follows: dict = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "end"),
        }
    )


    def control(self) -> list[str]:
        """Every string that marks something, longest first."""
        marks = {self.begin, self.name_end, *self.other[:2]}
        marks.update(m for opening, closing, _ in self.turns_of.values() for m in (opening, closing))
        return sorted(marks, key=lambda m: (-len(m), m))


INST_STYLE = Template()
SEGMENTS = "conv_id long, turn_no long, segment_no long, role string, kind string, text string, loss boolean, valid boolean"
_SEGMENTS = pa.schema(
    [("conv_id", pa.int64()), ("turn_no", pa.int64()), ("segment_no", pa.int64()), ("role", pa.string()),
     ("kind", pa.string()), ("text", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())]
)
_UNESCAPE = re.compile(r"\\(\\|\.)")


def _controls(template: Template) -> re.Pattern:
    return re.compile("|".join(map(re.escape, template.control())))


def escape(text: str, template: Template = INST_STYLE) -> str:
    text = text.replace("\\", "\\\\")
    return _controls(template).sub(lambda m: m[0][0] + "\\." + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "\\" if m[1] == "\\" else "", text)


def _segments(rows: Iterator[tuple], template: Template) -> Iterator[tuple]:
    """Segments of sorted (conv_id, role, text) rows. ``valid`` is false from the first turn on
    that the state machine does not allow; a turn that is not allowed is formatted all the same.
    The last segment of a conversation is an empty one of kind ``end``; it is valid if the state
    machine may end there as well."""
    nothing = object()
    last, role, state, valid, turn, number = nothing, "", "start", True, 0, 0

    def end():
        return last, turn - 1, number, role, "end", "", False, valid and "end" in template.follows.get(state, ())

    for conv, role_here, text in rows:
        first = conv != last
        if first:
            if last is not nothing:
                yield end()
            last, state, valid, turn, number = conv, "start", True, 0, 0
        role = role_here
        role, text = role or "", text or ""
        valid = valid and role in template.follows.get(state, ())
        known = template.turns_of.get(role)
        opening, closing, loss = known or template.other
        parts = [("control", template.begin, False)] if first else []
        parts.append(("control", opening, False))
        if not known:
            parts += [("role", escape(role, template), False), ("control", template.name_end, False)]
        parts += [("text", escape(text, template), loss), ("control", closing, False)]
        for kind, part, learned in parts:
            yield conv, turn, number, role, kind, part, learned, valid
            number += 1
        state, turn = role, turn + 1
    if last is not nothing:
        yield end()


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about so many characters, so that long texts do not add up."""
    held, used = [], 0
    for row in rows:
        held.append(row)
        used += 64 + sum(len(v) for v in row if isinstance(v, str))
        if used >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held, used = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


def _tuples(batches, *names: str) -> Iterator[tuple]:
    for batch in batches:
        columns = [batch.column(n) for n in names]
        for start in range(0, batch.num_rows, 256):
            yield from zip(*[c.slice(start, 256).to_pylist() for c in columns])


def format_conversations(turns: DataFrame, template: Template = INST_STYLE) -> DataFrame:
    """The segments of every conversation, in order within each partition.

    ``turns`` has ``conv_id``, ``turn``, ``role``, ``text``; other columns are not read. Rows go by
    turn, null first; ties by role and text, and a repeated row is a repeated turn. A null role or
    text is empty. Rows with a null conversation are one conversation. A conversation is whole in
    one partition, as a digest over its turns needs; a partition is read row by row.
    """

    def run(batches):
        yield from _batches(_segments(_tuples(batches, "conv_id", "role", "text"), template), _SEGMENTS)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SEGMENTS)


def parse(formatted: str, template: Template = INST_STYLE) -> Iterator[tuple[str, str, bool]]:
    """(role, text, learned) per turn of a formatted text of whole turns."""
    openings = {o: (role, c, loss) for role, (o, c, loss) in template.turns_of.items()}
    openings[template.other[0]] = (None, *template.other[1:])
    turn, name, body = None, "", []
    for token in re.split(f"({_controls(template).pattern})", formatted):
        if turn is None:
            if token in openings:
                turn, name, body = openings[token], "", []
        elif token == turn[1]:
            yield name if turn[0] is None else turn[0], unescape("".join(body)), turn[2]
            turn = None
        elif token == template.name_end:
            name, body = unescape("".join(body)), []
        else:
            body.append(token)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
_DIGEST = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())]
)


def read_back(segments: DataFrame, template: Template = INST_STYLE) -> DataFrame:
    """Digests per conversation, parsed from the formatted text. ``segments`` comes in the order
    that ``format_conversations`` gives. What is learned is what the segments' loss flags say."""

    def digests(rows):
        last, state = object(), None
        turn, pieces = None, []

        def close_turn():
            for role, text, _ in parse("".join(pieces), template):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            pieces.clear()

        def result():
            close_turn()
            n, turns, chars, learned, formatted, valid = state
            return last, n, turns.hexdigest(), chars, learned.hexdigest(), formatted, valid

        for conv, number, text, loss, valid in rows:
            if conv != last:
                if state:
                    yield result()
                last, turn, state = conv, number, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
            if number != turn:
                close_turn()
                turn = number
            pieces.append(text)
            state[4] += len(text)
            state[5] = valid
            if loss:
                plain = unescape(text)
                state[2] += len(plain)
                state[3].update(plain.encode())
        if state:
            yield result()

    def run(batches):
        yield from _batches(digests(_tuples(batches, "conv_id", "turn_no", "text", "loss", "valid")), _DIGEST)

    return segments.mapInArrow(run, DIGEST)
