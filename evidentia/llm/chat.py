"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a text. The operator renders successive prefixes of a
conversation and compares each output with the one before: what the longer output adds is the new turn's span, and
an output that does not begin with the one before shows a template that rewrites its history. A turn's loss mask
covers the text of an assistant turn within its span. The template knows nothing of this, and the operator nothing of it.

Conversations are dealt by id and read in the order of turns, one Arrow batch at a time. A template sees all turns before a turn,
however many: a conversation is held whole and its rendering grows with the square of its turns. For a template that
is declared local to a turn (local_to_a_turn) a caller may bound both by `history`; whether the turns let go render apart from
those kept is checked each time.

The template here writes <s>[role]text</s> marks. Control strings inside texts and roles are escaped reversibly: an escape sign, and a
letter for each control string or for the sign itself.

Defined results: null texts and roles are empty; null conversation ids are one conversation; turns with equal
numbers (nulls first) are ordered by role and text; repeated rows are turns of their own; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]

ESCAPE = "␛"
#: Strings that steer a chat model in common templates, the marks of the template here among them.
CONTROLS = (
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>",
    "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>",
)
_TO_ESCAPE = re.compile("|".join(map(re.escape, (ESCAPE, *sorted(CONTROLS, key=len, reverse=True)))))
_LETTER = {c: ESCAPE + chr(ord("A") + k) for k, c in enumerate(CONTROLS)} | {ESCAPE: ESCAPE + "0"}
_PLAIN = {v: k for k, v in _LETTER.items()}
_ESCAPED = re.compile(ESCAPE + "(.)")


def escaped(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: _LETTER[m[0]], text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[0]], text)


def local_to_a_turn(template: Callable[[list[Turn]], str]) -> Callable[[list[Turn]], str]:
    """Declares that a template renders each turn by itself: its output is that of each turn alone, in a row."""
    template.local_to_a_turn = True
    return template


@local_to_a_turn
def inst_template(turns: list[Turn]) -> str:
    """Each turn as <s>, its role, [INST], its text, [/INST] and </s>; what they hold is escaped."""
    return "".join(f"<s>{escaped(role)}[INST]{escaped(text)}[/INST]</s>" for role, text in turns)


_TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>", re.DOTALL)


def read_turns(formatted: str) -> list[Turn]:
    """The turns of a text that inst_template made."""
    return [(unescaped(m[1]), unescaped(m[2])) for m in _TURN.finditer(formatted)]


def parting(a: str, b: str) -> int:
    """Where two texts part."""
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


#: Texts that share neither their first nor their last character, also where a template strips, escapes or changes case.
PLACEHOLDERS = ("a", "b")


def text_place(now: str, start: int, one: str, other: str) -> tuple[int, int]:
    """Where the last turn's text begins and ends in now[start:]; one and other are the outputs with the PLACEHOLDERS for it.
    What precedes and follows the text is common to all three outputs, and the placeholders end it at the text's own edges."""
    base = start if one.startswith(now[:start]) and other.startswith(now[:start]) else 0
    now, one, other = now[base:], one[base:], other[base:]
    left = min(parting(one, other), parting(now, one))
    right = min(parting(one[::-1], other[::-1]), parting(now[::-1], one[::-1]), len(now) - left)
    return max(0, base + left - start), max(0, base + len(now) - right - start)


def formatted_turns(conversations: DataFrame, template: Callable[[list[Turn]], str] = inst_template, history: int | None = None) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> one row per turn, in order within each partition: conv_id, turn_no (from 0),
    span (what the turn adds to the output), loss_start and loss_end (the masked part of the span, null if none) and
    rewrites (whether the output with this turn changes earlier output). With history, a template that is local to a turn sees
    so many turns before a turn at least, and twice as many at most."""
    if history is not None and not (history > 0 and getattr(template, "local_to_a_turn", False)):
        raise ValueError("a bounded history is for templates declared local to a turn")
    id_type = conversations.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "turn_no", "span", "loss_start", "loss_end", "rewrites"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, number, turns, last, none = object(), 0, [], "", template([])
        for batch in batches:
            rows = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv != current or number == 0:
                    current, number, turns, last = conv, 0, [], none
                if history is not None and len(turns) == 2 * history:
                    gone, turns, whole = template(turns[:history]), turns[history:], last
                    last = template(turns)
                    if gone + last != whole:
                        raise ValueError("the template is declared local to a turn and is not")
                turns.append((role, text))
                now = template(turns)
                rewrites = not now.startswith(last)
                start = parting(last, now) if rewrites else len(last)
                span = now[start:]
                loss = (None, None)
                if role == "assistant":
                    loss = text_place(now, start, *(template([*turns[:-1], (role, x)]) for x in PLACEHOLDERS))
                rows.append((conv, number, span, *loss, rewrites))
                number, last = number + 1, now
            if rows:
                kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)

    slim = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = slim.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.mapInArrow(run, f"conv_id {id_type}, turn_no long, span string, loss_start long, loss_end long, rewrites boolean")


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted_turns' rows, as dealt and ordered there -> one row per conversation: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, rewrites; all read from the spans."""
    id_type = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def closed():
            conv, n, turns, chars, loss, total, rewrites = state
            return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), total, rewrites)

        id_type = None
        for batch in batches:
            id_type, done = batch.schema.field("conv_id").type, []
            for conv, number, span, start, end, rewrites in zip(*(c.to_pylist() for c in batch.columns)):
                if number == 0:
                    if state is not None:
                        done.append(closed())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                for role, text in read_turns(span):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    text = unescaped(span[start:end])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(span)
                state[6] |= rewrites
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*done), [id_type, *kinds])], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(closed(), [id_type, *kinds])], names)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    return formatted.mapInArrow(run, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean")
