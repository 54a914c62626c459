"""Chat formatting: turn-aligned windows under a token budget, with a loss mask.

A turn is written as ``<|:role|>``, a line feed, the text and ``</s>`` with a line feed.  Inside roles and
texts a backslash is doubled and the second character of every control string gets a backslash before
it, so that no control string is left and removing single backslashes gives the text back.

Turns enter windows in order.  Prefix sums of turn tokens (those of the given vocabulary for the text, and
``TURN_TOKENS`` for what stands around it) say how far a window reaches: a window holds
the system turn (the conversation's first turn, where its role is system), as many of the turns before
its own as the history budget and the rest of the budget allow, and then its own turns.  A turn that
exceeds the budget alone is not cut; it stands in a window without history.  Only the texts of a window's
own assistant turns are under the loss mask, so each is a target once; the system turn and the history
are repeated without loss.

Conversations are dealt by id and sorted by turn; a task streams through its turns and holds no more than
a window and its history, so a conversation of any length passes through one task without being gathered.

Defined cases: null texts and roles count as empty; rows of the same turn are ordered by role, then text,
and repeated rows are turns each; a null turn number comes first; a row with a null id is a conversation
of its own; further columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crivo.llm.token_counts import PieceCounter

BUDGET = 1024
HISTORY = 256
#: Tokens of a turn beside those of its text.
TURN_TOKENS = 6
#: Control strings of the template and of templates that readers may mistake it for (fixed values).
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: The colon keeps a role that starts with > from forming a control string with the opening.
OPEN, HEAD, CLOSE = "<|:", "|>\n", "</s>\n"
TARGET_ROLE, SYSTEM_ROLE = "assistant", "system"


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for control in CONTROL:
        text = text.replace(control, f"{control[0]}\\{control[1:]}")
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def turn_counter(model_file: str | None):
    """Tokens of texts: the vocabulary's, or a quarter of the bytes, rounded up, where none is given."""
    if model_file is None:
        return lambda texts: [-(-len(t.encode()) // 4) for t in texts]
    return PieceCounter(model_file).counts


def by_id(rows: DataFrame, *order: str) -> DataFrame:
    """Rows dealt by conversation and sorted; those without an id are dealt by their content."""
    loose = F.when(F.col("conv").isNull(), F.xxhash64(*order))
    return rows.repartition("conv", loose).sortWithinPartitions("conv", *order)


def parse(window: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of the turns of a window; the bounds are those of the escaped text."""
    turns, at = [], 0
    while at < len(window):
        if not window.startswith(OPEN, at):
            raise ValueError("not a window of this template")
        head = window.index(HEAD, at + len(OPEN))
        start = head + len(HEAD)
        end = window.index(CLOSE, start)
        turns.append((unescape(window[at + len(OPEN) : head]), unescape(window[start:end]), start, end))
        at = end + len(CLOSE)
    return turns


class Windows:
    """Windows of one conversation, made while its turns stream by."""

    def __init__(self, budget: int, history: int) -> None:
        self.budget, self.history = budget, history
        self.system: tuple[str, int] | None = None
        self.turns: list[tuple[str, str, bool]] = []  # head, body, whether it is a target
        self.sums = [0]  # prefix sums of the tokens of ``turns``
        self.own = 0  # first of the window's own turns
        self.first = 0  # first of the repeated ones
        self.number = 0
        self.begun = False

    def add(self, role: str, text: str, tokens: int) -> Iterator[tuple[int, str, int, list[int], list[int]]]:
        turn = (OPEN + escape(role) + HEAD, escape(text), role == TARGET_ROLE)
        fixed = self.system[1] if self.system else 0
        if self.own < len(self.turns) and fixed + self.sums[-1] - self.sums[self.first] + tokens > self.budget:
            yield self.close()
            # The furthest start whose turns fit the history budget and leave room for this turn.
            room = min(self.history, self.budget - fixed - tokens)
            gone = bisect_left(self.sums, self.sums[-1] - max(room, 0))
            self.turns, self.sums = self.turns[gone:], self.sums[gone:]
            self.first, self.own = 0, len(self.turns)
        if not self.begun and role == SYSTEM_ROLE:
            self.system = ("".join((*turn[:2], CLOSE)), tokens)
        else:
            self.turns.append(turn)
            self.sums.append(self.sums[-1] + tokens)
        self.begun = True

    def close(self) -> tuple[int, str, int, list[int], list[int]]:
        """(number, text, repeated turns, starts and ends of the targets)."""
        parts, starts, ends, at = [], [], [], 0
        repeated = self.own - self.first
        if self.system:
            # In the first window it is a turn of its own, later a repeated one.
            repeated += self.number > 0
            parts.append(self.system[0])
            at = len(self.system[0])
        for k, (head, body, target) in enumerate(self.turns[self.first :], self.first):
            parts += [head, body, CLOSE]
            if target and k >= self.own:
                starts.append(at + len(head))
                ends.append(at + len(head) + len(body))
            at += len(head) + len(body) + len(CLOSE)
        self.number += 1
        return self.number - 1, "".join(parts), repeated, starts, ends


def by_conversation(batches: Iterator) -> Iterator:
    """(whether it is the first row of its conversation, row) for rows that are sorted by it."""
    last = None
    for batch in batches:
        for at in range(0, len(batch), 1024):
            rows = batch.slice(at, 1024).to_pylist()
            for row in rows:
                new = row["conv"] is None or row["conv"] != last
                last = row["conv"]
                yield new, row


def format_chats(turns: DataFrame, model_file: str | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row a window: id, window, formatted, n_repeated (turns repeated from earlier windows),
    loss_starts and loss_ends (character bounds of the targets in formatted)."""
    rows = turns.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dealt = by_id(rows, "turn", "role", "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out: list[tuple] = []

        def flush():
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv", "window", "formatted", "n_repeated", "loss_starts", "loss_ends"])

        windows, conv, count = None, None, turn_counter(model_file)

        def with_tokens():
            for batch in batches:
                for at in range(0, len(batch), 256):
                    part = batch.slice(at, 256)
                    yield part.append_column("tokens", pa.array([n + TURN_TOKENS for n in count(part.column("text").to_pylist())], pa.int64()))

        for new, row in by_conversation(with_tokens()):
            if new:
                if windows:
                    out.append((conv, *windows.close()))
                windows, conv = Windows(budget, history), row["conv"]
            out += [(conv, *w) for w in windows.add(row["role"], row["text"], row["tokens"])]
            if len(out) >= 512:
                yield flush()
        if windows:
            out.append((conv, *windows.close()))
        yield flush()

    schema = "conv long, window long, formatted string, n_repeated long, loss_starts array<long>, loss_ends array<long>"
    return dealt.mapInArrow(run, schema).withColumnRenamed("conv", id_col)


def read_back(windows: DataFrame, id_col: str = "conv_id", dealt: bool = False) -> DataFrame:
    """Digests of the conversations, read from their formatted windows alone.

    ``dealt`` says that the windows come straight from ``format_chats``, each conversation whole and in order.
    """
    windows = windows.withColumnRenamed(id_col, "conv")
    windows = windows if dealt else by_id(windows, "window", "formatted")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        done: list[tuple] = []
        state: list = []

        def finish():
            if state:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        for new, row in by_conversation(batches):
            if new:
                finish()
                state[:] = [row["conv"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, _, _ in parse(row["formatted"])[row["n_repeated"] :]:
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            for a, b in zip(row["loss_starts"], row["loss_ends"], strict=True):
                target = unescape(row["formatted"][a:b])
                state[3] += len(target)
                state[4].update(target.encode())
            state[5] += len(row["formatted"])
        finish()
        columns = list(zip(*done, strict=True)) if done else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    found = windows.mapInArrow(run, "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return found.withColumnRenamed("conv", id_col)
