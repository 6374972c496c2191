"""Order-preserving packing of tokenised documents into fixed windows.

Each input partition is one stream of tokens, its documents in the order read.
Dynamic programming over the places where a window may end (a document's end,
a sentence's end, or, where sentences are long, every ``STRIDE`` tokens) picks
the cuts with the least padding plus truncation penalty:

    cost(j) = min over i, len = c[j] - c[i] <= window, of cost(i) + pad(len) + penalty(j) + each

``pad(len) = window - len``, so ``cost(i) + c[i]`` is all that depends on i and
a monotone queue holds the running minimum; lengths that are powers of two need
no padding and are tried besides.  Every window costs ``each``, so that a text
is not shredded into small windows for the sake of a little padding.  The last, unfinished window of an Arrow
batch is carried to the next, so only the end of a partition is padded short.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import map_batches

#: Tokens of padding that a cut inside a document is worth: at a sentence's end, and elsewhere.
SENTENCE_PENALTY, FORCED_PENALTY = 4, 24
#: Cuts are possible at least this often (four times a window, if that is less), however long a sentence is.
STRIDE = 128
#: Tokens after which a stream is planned; bounds the memory of a task with very long documents.
BLOCK = 500_000
#: Tokens that a window costs besides its padding, as a part of the window.
WINDOW_SHARE = 8

_state: dict = {}

SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def plan(places: np.ndarray, penalties: np.ndarray, window: int, each: int = 0) -> list[int]:
    """Ends of the windows that cover (0, places[-1]] at least cost.

    ``places`` ascend, gaps are at most ``window``; every window costs ``each``
    besides; ties go to the longer window.
    """
    c = [0, *places.tolist()]
    pen = [0, *penalties.tolist()]
    at = {x: i for i, x in enumerate(c)}
    powers = [1 << k for k in range(window.bit_length()) if 1 << k < window]
    cost, back = [0] * len(c), [0] * len(c)
    queue: deque[int] = deque([0])
    for j in range(1, len(c)):
        x = c[j]
        while c[queue[0]] < x - window:
            queue.popleft()
        i = queue[0]
        best = cost[i] + c[i] + window - x
        if best > 0:
            for p in powers:
                k = at.get(x - p)
                if k is not None and cost[k] < best:
                    best, i = cost[k], k
        cost[j], back[j] = best + pen[j] + each, i
        key = cost[j] + x
        while queue and cost[queue[-1]] + c[queue[-1]] > key:
            queue.pop()
        queue.append(j)
    out, j = [], len(c) - 1
    while j:
        out.append(c[j])
        j = back[j]
    return out[::-1]


def encoder(path: str):
    """Function from texts to lists of ids of a byte-level ``tokenizers`` file, and which ids end a sentence.

    The merge loop is tiktoken's, over the same vocabulary: its ids are equal
    and it is several times faster.  Strings of special tokens in a text become
    their ids, as ``tokenizers`` has it unless told otherwise.
    """
    if path not in _state:
        import json

        import tiktoken

        from tracewell.llm.tokens import byte_alphabet

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_alphabet().items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        import public_tokenizers

        coder = tiktoken.Encoding("pack", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        ends = np.zeros(max([*ranks.values(), *special.values()]) + 1, bool)
        for token, i in ranks.items():
            ends[i] = token.endswith((b".", b"!", b"?", b"\n"))
        _state[path] = (lambda t: coder.encode(t, allowed_special="all")), ends
    return _state[path]


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most ``window`` tokens (columns of ``SCHEMA``).

    A document's ids are those of its text (null: none) and then ``end_id``, so
    an empty text is a piece of one token.  Rows are packed as they come:
    repeated rows and null ids each have their own pieces, an empty table has
    none, columns besides the two named are ignored.  ``ids`` holds a piece's
    ids as little-endian unsigned 32-bit.  ``sequence_id`` is the partition's
    number times 2**33 plus the window's number there.  Nothing is shuffled and
    a task holds about ``BLOCK`` tokens and one document at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, ends = encoder(path)
        stride = max(1, min(STRIDE, window // 4))
        sequence = TaskContext.get().partitionId() << 33
        held: list[tuple] = []  # doc_id, start, ids, doc_tokens
        size = 0

        def flush(final: bool):
            nonlocal sequence, held, size
            ids = np.concatenate([h[2] for h in held])
            edges = np.cumsum([len(h[2]) for h in held])
            pen = np.full(len(ids) + 1, FORCED_PENALTY)
            ok = np.zeros(len(ids) + 1, bool)
            ok[stride::stride] = True
            stops = np.flatnonzero(ends[ids]) + 1
            ok[stops], pen[stops] = True, SENTENCE_PENALTY
            ok[edges], pen[edges] = True, 0
            places = np.flatnonzero(ok)
            cuts = plan(places, pen[places], window, window // WINDOW_SHARE)
            if not final and len(cuts) > 1:
                cuts.pop()
            elif not final:
                cuts = []
            # pieces: between any two neighbours among cuts and document edges
            last = cuts[-1] if cuts else 0
            rows, d, at = [], 0, 0
            for n, cut in enumerate(cuts):
                begin = at
                while at < cut:
                    doc_id, start, x, total = held[d]
                    first = edges[d] - len(x)
                    stop = min(cut, edges[d])
                    piece = x[at - first : stop - first]
                    rows.append((doc_id, int(start + at - first), len(piece), piece.tobytes(), total, sequence + n, int(at - begin)))
                    at = stop
                    d += stop == edges[d]
            sequence += len(cuts)
            rest = []
            if d < len(held) and last < edges[-1]:
                doc_id, start, x, total = held[d]
                skip = last - (edges[d] - len(x))
                rest = [(doc_id, start + skip, x[skip:], total), *held[d + 1 :]]
            held, size = rest, int(edges[-1] - last)
            return rows

        def frame(rows):
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            columns = list(zip(*rows)) or [()] * len(names)
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.asarray([*encode(text or ""), end_id], "<u4")
                held.append((doc_id, 0, ids, len(ids)))
                size += len(ids)
                if size >= BLOCK:
                    yield frame(flush(False))
        if held:
            yield frame(flush(True))

    picked = docs.select(docs[id_col].cast("bigint").alias("k"), docs[text_col].cast("string").alias("t"))
    return map_batches(picked, run, SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    """The columns of ``op4_packing``: ids as their CRC-32."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
