"""Chat formatting by assembling tokens.

Header, content and end of a turn are encoded separately and spliced with
reserved ids, so no text can spell a control token.  In the rendered text a
control string that a content contains is escaped: a ``<``, any backslashes and
a ``|`` get one backslash more, and reading back takes one away.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import map_batches

#: The template's control strings; their ids follow the vocabulary and its special tokens.
START, END = "<|im_start|>", "<|im_end|>"

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
_coders: dict = {}


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


class Template:
    """Encodes and decodes turns; ids below ``start`` are ordinary tokens."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        from tracewell.llm.tokens import read_ranks

        ranks = read_ranks(path)
        self.coder = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.start, self.end = len(ranks) + 1, len(ranks) + 2  # len(ranks) is the vocabulary's own special token
        self.newline = self.coder.encode_ordinary("\n")

    def turn(self, role: str, text: str, trained: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of one turn and its loss mask, from segment lengths by prefix sums."""
        segments = [
            ([self.start], 0),
            (self.coder.encode_ordinary(escape(role)), 0),
            (self.newline, 0),
            (self.coder.encode_ordinary(escape(text)), 1 if trained else 0),
            ([self.end], 0),
            (self.newline, 0),
        ]
        steps = np.zeros(sum(len(ids) for ids, _ in segments) + 1, np.int8)
        at = 0
        for ids, flag in segments:
            steps[at] += flag
            at += len(ids)
            steps[at] -= flag
        return np.concatenate([np.asarray(ids, "<u4") for ids, _ in segments]), np.cumsum(steps[:-1], dtype=np.int8)

    def text(self, ids: np.ndarray) -> str:
        return self.coder.decode_bytes(ids.tolist()).decode("utf-8", "replace")

    def rendered(self, ids: np.ndarray) -> str:
        """The formatted text: control ids as their strings."""
        out = []
        marks = np.flatnonzero(ids >= self.start)
        for a, b in zip([-1, *marks], [*marks, len(ids)]):
            out.append(self.text(ids[a + 1 : b]))
            if b < len(ids):
                out.append(START if ids[b] == self.start else END)
        return "".join(out)


def template(path: str, pattern: str) -> Template:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Template(path, pattern)
    return _coders[path, pattern]


def format_turns(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """``conv_id, turn, ids binary, mask binary`` for each row of ``turns``.

    ``ids`` are little-endian unsigned 32-bit; ``mask`` has a byte an id, 1
    under the loss (assistant content).  A null role or text is empty; other
    columns are ignored; no shuffle.  A role ends at its first line feed: what
    follows one is read back as the text's beginning.  Concatenated by turn,
    the rows of a conversation are its token sequence and its mask.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = template(path, pattern)
        for b in batches:
            made = [t.turn(r or "", x or "", r == "assistant") for r, x in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            ids = pa.array([i.tobytes() for i, _ in made], pa.binary())
            mask = pa.array([m.tobytes() for _, m in made], pa.binary())
            yield pa.record_batch([b.column(0), b.column(1), ids, mask], ["conv_id", "turn", "ids", "mask"])

    picked = turns.select(*(F.col(n).cast(k).alias(n) for n, k in (x.split() for x in SCHEMA.split(", "))))
    return map_batches(picked, run, "conv_id bigint, turn bigint, ids binary, mask binary")


def read_back(formatted: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of whole conversations, parsed from the ids and masks alone.

    Rows are dealt by conversation and sorted by turn (ties: by the ids); a
    task streams through its rows and keeps only running digests, so a
    conversation may be of any length.  A null ``conv_id`` is a conversation
    of its own; a null turn comes first.
    """
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = template(path, pattern)
        key, state, began = None, None, False
        done: list[tuple] = []

        def close():
            n, turns, chars, loss, formatted = state
            done.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), formatted))

        def frame():
            nonlocal done
            columns = list(zip(*done)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            done = []
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in schema.split(", ")])

        for b in batches:
            for conv, ids, mask in zip(*(b.column(n).to_pylist() for n in ("conv_id", "ids", "mask"))):
                if not began or conv != key:
                    if began:
                        close()
                    key, state, began = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
                ids, mask = np.frombuffer(ids, "<u4"), np.frombuffer(mask, np.int8)
                text = t.rendered(ids)
                state[4] += len(text)
                body = t.text(ids[1 : np.flatnonzero(ids == t.end)[-1]])
                role, _, content = body.partition("\n")  # roles hold no line feed
                state[0] += 1
                state[1].update(f"{unescape(role)}\n{unescape(content)}\n".encode())
                trained = unescape(t.text(ids[mask == 1]))
                state[2] += len(trained)
                state[3].update(trained.encode())
            yield frame()
        if began:
            close()
            yield frame()

    dealt = formatted.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "ids")
    return map_batches(dealt, run, schema)
