"""Chat formatting in budgeted windows.

A turn is written ``<|role|>\\ntext<|end|>\\n``.  In roles and texts the characters
``<``, ``[``, ``|``, ``#`` and the backslash are written as a backslash and a letter, so none
of the first four stands in a formatted role or text, and no control string that has one
of them: this template's, ``</s>``, ``[INST]``, ``<|im_start|>``, ``### Instruction:``.
Reading back is exact.

Conversations are streamed: rows arrive sorted by conversation and turn, and a task
holds one window and the history it may repeat, so a conversation of any length needs
bounded memory (its turns must still pass through one task, as they have one order).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _tokens
from ._spark import bounded_batches

#: Tokens of a window, and of the earlier turns that the next window repeats.
BUDGET = 512
HISTORY = 128
TARGET = "assistant"
_LETTERS = {"\\": "b", "<": "l", "[": "s", "|": "p", "#": "h"}
_ESCAPED = {letter: char for char, letter in _LETTERS.items()}
_SPECIAL = re.compile(r"[\\<\[|#]")
_QUOTED = re.compile(r"\\([blsph])")
_TURN = re.compile(r"<\|([^<|]*)\|>\n([^<]*)<\|end\|>\n")
WINDOWS = "conv_id {}, window int, repeated int, text string, loss array<struct<start:int,end:int>>, tokens long"


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\" + _LETTERS[m[0]], text)


def unescape(text: str) -> str:
    return _QUOTED.sub(lambda m: _ESCAPED[m[1]], text)


def format_turn(role: str, text: str) -> str:
    return f"<|{escape(role)}|>\n{escape(text)}<|end|>\n"


def read_turns(window: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted window; raises if it isn't one."""
    turns, at = [], 0
    for m in _TURN.finditer(window):
        if m.start() != at:
            raise ValueError(f"not a formatted window at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(window):
        raise ValueError(f"not a formatted window at {at}")
    return turns


class Windows:
    """Cuts one conversation's turns, given in order, into windows.

    Spans are chosen on the prefix sums of the turns' tokens: a window takes turns up to
    the budget that the repeated ones leave.  It repeats the system turn (the first turn,
    if its role is system) and then the longest run of the latest turns whose tokens are
    at most ``history``.  A turn is never cut: one that exceeds the budget is alone in its
    window, behind the system turn and without history.

    Held are the turns that the next window may repeat and those of the open one, which
    begins with turn ``start``; ``sums[i]`` are the conversation's tokens before turn i.
    """

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: tuple | None = None
        self.turns: list[tuple] = []
        self.sums = [0]
        self.start = 0
        self.head: list[tuple] = []
        self.head_tokens = 0
        self.n_turns = self.n_windows = 0

    @property
    def open(self) -> bool:
        return len(self.turns) > self.start

    def add(self, role: str, text: str, tokens: int) -> tuple | None:
        """Takes a turn; gives the window that it closes, if any."""
        turn = (role, format_turn(role, text), tokens)
        done = None
        if self.open and self.head_tokens + self.sums[-1] + tokens - self.sums[self.start] > self.budget:
            done = self.close()
            self._repeat(tokens)
        if not self.n_turns and role == "system":
            self.system = turn
        self.turns.append(turn)
        self.sums.append(self.sums[-1] + tokens)
        self.n_turns += 1
        return done

    def _repeat(self, tokens: int) -> None:
        """Chooses what the window that begins with a turn of ``tokens`` repeats."""
        fixed = self.system[2] if self.system else 0
        room = max(0, min(self.history, self.budget - tokens - fixed))
        first = bisect_left(self.sums, self.sums[self.start] - room)
        if first < self.start and self.turns[first] is self.system:
            first += 1
        self.head = ([self.system] if self.system else []) + self.turns[first : self.start]
        self.head_tokens = fixed + self.sums[self.start] - self.sums[first]

    def close(self) -> tuple:
        turns = self.head + self.turns[self.start :]
        loss, at = [], 0
        for i, (role, text, _) in enumerate(turns):
            if i >= len(self.head) and role == TARGET:
                start = at + len(f"<|{escape(role)}|>\n")
                loss.append((start, at + len(text) - len("<|end|>\n")))
            at += len(text)
        out = (self.n_windows, len(self.head), "".join(t[1] for t in turns), loss, self.head_tokens + self.sums[-1] - self.sums[self.start])
        self.n_windows += 1
        first = bisect_left(self.sums, self.sums[-1] - self.history)  # what comes before is never repeated
        del self.turns[:first], self.sums[:first]
        self.start, self.head, self.head_tokens = len(self.turns), [], 0
        return out


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, path: str | None = None) -> DataFrame:
    """(conv_id, window, repeated, text, loss, tokens): ``repeated`` leading turns are
    repeats, ``loss`` are the character spans of the assistant texts to learn, which
    never lie in a repeat.  A conversation's windows follow each other in one partition.

    ``turns`` has conv_id, turn, role and text; null roles and texts count as empty, null
    conversations as one conversation, null turns come first, and equal turns are sorted
    by role and text.  Repeated rows are turns of their own.  An empty table gives no
    window; further columns are not read.
    """
    path = path or _tokens.default_path()
    kind = dict(turns.dtypes)["conv_id"]
    rows = bounded_batches(turns).select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = WINDOWS.format(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _tokens.word_ids(path)
        state, conv, began = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, roles, texts = (batch.column(i).to_pylist() for i in (0, 2, 3))
            formatted = pa.array([format_turn(r, t) for r, t in zip(roles, texts, strict=True)], pa.large_string())
            counts, _, at = enc.spans(formatted, want_ids=False)
            sums = np.concatenate([[0], np.cumsum(counts)])
            tokens = (sums[at[1:]] - sums[at[:-1]]).tolist()
            out: list[tuple] = []
            for c, role, text, n in zip(ids, roles, texts, tokens, strict=True):
                if not began or c != conv:
                    if began and state.open:
                        out.append((conv, *state.close()))
                    state, conv, began = Windows(budget, history), c, True
                done = state.add(role, text, n)
                if done:
                    out.append((conv, *done))
            yield _batch(out, batch.column(0).type)
            kind_ = batch.column(0).type
        if began and state.open:
            yield _batch([(conv, *state.close())], kind_)

    return rows.mapInArrow(run, schema)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    col = lambda i, t: pa.array([r[i] for r in rows], t)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    loss = pa.array([[{"start": a, "end": b} for a, b in r[4]] for r in rows], spans)
    return pa.RecordBatch.from_arrays([col(0, kind), col(1, pa.int32()), col(2, pa.int32()), col(3, pa.string()), loss, col(5, pa.int64())], ["conv_id", "window", "repeated", "text", "loss", "tokens"])


DIGEST = "conv_id {}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows int"


def digest(formatted: DataFrame) -> DataFrame:
    """What the windows of each conversation say, read back from their text: the turns
    once each, and the text under the loss mask.  ``formatted`` must be what ``windows``
    returned, not shuffled since."""
    kind = dict(formatted.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        types = None

        def finish() -> tuple:
            conv, n, all_, chars, loss, size, n_win = state
            return conv, n, all_.hexdigest(), chars, loss.hexdigest(), size, n_win

        for batch in batches:
            out = []
            types = batch.column(0).type
            for row in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                conv, repeated, text, loss = row
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(finish())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said in read_turns(text)[repeated:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    state[3] += len(said)
                    state[4].update(said.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
                state[6] += 1
            yield _digest_batch(out, types)
        if state is not None:
            yield _digest_batch([finish()], types)

    return formatted.mapInArrow(run, DIGEST.format(kind))


def _digest_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
