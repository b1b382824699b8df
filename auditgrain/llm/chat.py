"""Chat formatting in budgeted windows that end between turns.

A conversation whose turns take more tokens than the budget is cut into windows: running sums of turn
tokens choose how many whole turns fit. Every window keeps the system turn and repeats the last turns
before it as far as the history budget goes; what is repeated is outside the loss mask, so that each
assistant text is a target exactly once. The template writes a turn as

    <s>[ROLE]role[/ROLE][INST]text[/INST]</s>

and keeps control strings inside roles and texts apart by a backslash behind their first character,
one more than is there already, which is undone exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditgrain.llm.common import column, pieces, texts_of

BUDGET = 2048
HISTORY = 256
#: Tokens that the marks of a turn count for.
OVERHEAD = 8

_CONTROL = re.compile(r"([<\[])(\\*)(/?(?:s>|ROLE\]|INST\]))")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:s>|ROLE\]|INST\]))")
_TURN = re.compile(r"<s>\[ROLE\](.*?)\[/ROLE\]\[INST\](.*?)\[/INST\]</s>", re.S)
OPEN, MIDDLE, CLOSE = "<s>[ROLE]", "[/ROLE][INST]", "[/INST]</s>"

WINDOW = "window int, first_turn int, n_turns int, n_repeated int, n_tokens long, text string, loss array<struct<start: int, end: int>>"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def count_tokens(text: str) -> int:
    """Tokens of a turn: words between blanks, and the marks around it."""
    return len(text.split()) + OVERHEAD


class _Conversation:
    """One conversation, turn by turn; holds the open window and as many turns as history may repeat."""

    def __init__(self, key: object, budget: int, history: int):
        self.key, self.budget, self.history = key, budget, history
        self.system: tuple[str, str, int] | None = None
        self.tail: list[tuple[str, str, int]] = []
        self.open: list[tuple[str, str, int]] = []
        self.window = self.turn = 0
        self.first = 0
        self.total = 0  # prefix sum over the window

    def add(self, role: str, text: str) -> Iterator[tuple]:
        turn = (role, text, count_tokens(text))
        if self.open and self.total + turn[2] > self.budget:
            yield self.close()
        if not self.open:
            self.first = self.turn
            self.repeated = self._repeated(turn[2])
            self.total = sum(t[2] for t in self.repeated)
        if self.turn == 0 and role == "system" and 2 * turn[2] <= self.budget:
            self.system = turn
        self.open.append(turn)
        self.total += turn[2]
        self.turn += 1

    def _repeated(self, need: int) -> list[tuple[str, str, int]]:
        """The system turn and the last turns before this window, within the budgets."""
        if self.turn == 0:
            return []
        system = [self.system] if self.system else []
        room = min(self.history, self.budget - need - sum(t[2] for t in system))
        # running sums from the last turn back
        sums = np.cumsum([t[2] for t in reversed(self.tail)]) if self.tail else np.empty(0)
        fit = int(np.searchsorted(sums, room, side="right")) if room > 0 else 0
        return [*system, *(self.tail[len(self.tail) - fit :] if fit else [])]

    def close(self) -> tuple:
        parts, spans, at = [], [], 0
        turns = [*self.repeated, *self.open]
        for k, (role, text, _) in enumerate(turns):
            head, body = f"{OPEN}{escape(role)}{MIDDLE}", escape(text)
            start = at + len(head)
            if k >= len(self.repeated) and role == "assistant":
                spans.append({"start": start, "end": start + len(body)})
            parts += [head, body, CLOSE]
            at = start + len(body) + len(CLOSE)
        row = (self.key, self.window, self.first, len(turns), len(self.repeated), self.total, "".join(parts), spans)
        # the system turn is repeated by itself
        self.tail = self._tail()
        self.open, self.window, self.total = [], self.window + 1, 0
        return row

    def _tail(self) -> list[tuple[str, str, int]]:
        known = [*self.tail, *(self.open[1:] if self.system and self.window == 0 else self.open)]
        total, k = 0, len(known)
        while k and total + known[k - 1][2] <= self.history:
            k -= 1
            total += known[k][2]
        return known[k:]


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of every conversation: `conv_id`, `window`, `first_turn` (of the new ones), `n_turns`,
    `n_repeated` (leading turns that repeat earlier ones), `n_tokens`, `text`, `loss` (code point spans).

    Turns are ordered by turn, then role, then text, nulls first. A null text or role is empty; a null
    conv_id is a conversation of its own; a turn that alone exceeds the budget has a window of its own
    and stays whole; a system turn that takes over half of the budget is not repeated. Repeated rows
    are turns like others. Conversations are streamed turn by turn over sorted partitions, so that a
    conversation of any length takes the memory of one window. Windows of a conversation follow each
    other inside one partition of the result. An empty table gives an empty result. Only conv_id,
    turn, role and text are read.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = ["conv_id", *[x.split(" ")[0] for x in "window,first_turn,n_turns,n_repeated,n_tokens,text,loss".split(",")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_type, now, out, size = None, None, [], 0

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            types = [key_type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

        for batch in pieces(batches):
            key_type = batch.schema.field("conv_id").type
            for key, role, text in zip(column(batch, "conv_id").to_pylist(), column(batch, "role").to_pylist(), texts_of(batch)):
                if now is None or now.key != key:
                    if now is not None:
                        out.append(now.close())
                    now = _Conversation(key, budget, history)
                out += now.add(role, text)
                size += len(text)
            if out and size > 4_000_000:
                yield batch_of(out)
                out, size = [], 0
        if now is not None:
            out.append(now.close())
        if out:
            yield batch_of(out)

    return dealt.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, {WINDOW}")


def parse_window(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a window, unescaped."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation from its windows alone: `conv_id`, `n_turns`, `turns_sha256`,
    `loss_chars`, `loss_sha256`, `formatted_chars`, `n_windows`.

    Takes the result of `format_windows` as it comes, windows of a conversation next to each other.
    """
    import hashlib

    kind = windows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, key, state = False, None, None
        for batch in pieces(batches):
            out = []
            for row in batch.to_pylist():
                if not started or row["conv_id"] != key:
                    if started:
                        out.append(finish(key, state))
                    started, key, state = True, row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text in parse_window(row["text"])[row["n_repeated"] :]:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in row["loss"]:
                    text = unescape(row["text"][span["start"] : span["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] += len(row["text"])
                state[5] += 1
            if out:
                yield as_batch(out, batch.schema.field("conv_id").type)
            key_type = batch.schema.field("conv_id").type
        if started:
            yield as_batch([finish(key, state)], key_type)

    def finish(key: object, s: list) -> tuple:
        return (key, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4], s[5])

    def as_batch(found: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        types = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

    return windows.select("conv_id", "n_repeated", "text", "loss").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long",
    )
