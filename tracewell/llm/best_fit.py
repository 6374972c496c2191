"""Packing into few fixed windows by linear grouping of lengths.

Documents longer than a window are cut into whole windows, and what is left
over comes first; every piece then has a length of 1 to ``window``.  How many
pieces have which length is all that a plan needs, so it is made from a table
of at most ``window`` counts, whatever the number of documents:

1. lengths above ``LARGE`` of a window are sorted and split into groups of
   equal numbers of pieces, each length rounded up to its group's largest;
2. for these few sizes, configurations (how many pieces of each size a window
   holds) are chosen by a linear programme with column generation, whose next
   configuration is a knapsack over the window;
3. whole multiples of the configurations are filled with the actual pieces of
   each group, and pieces beyond them wait;
4. these and the small pieces go, longest first, to the fullest window that
   has room.

Windows with the same lengths in them are one entry of the plan with a count,
and step 4 moves whole counts at a time.  The plan is a table of runs: of the
pieces of one length, numbers a to b lie in windows from s on at offset o.
Spark numbers the pieces of each length, by task, and a join finds each
piece's run.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.common import map_batches, materialize
from tracewell.llm.packing import encoder

#: Lengths over this part of a window are grouped; the others are fitted where room is left.
LARGE = 0.25
#: Groups of equal numbers of pieces: more lose less by rounding up and make a longer programme, of bounded size.
GROUPS = 512
#: Steps of the programme at most, and what a new configuration must save; both only bear on how few windows there are.
STEPS, GAIN = 20_000, 1e-4

PIECES = "doc_id bigint, piece int, start bigint, length int, ids binary, task int, nth bigint"
RUNS = "length int, first bigint, stop bigint, per bigint, sequence bigint, at bigint"


def grouped(counts: dict[int, int], groups: int) -> list[tuple[int, dict[int, int]]]:
    """``(size, lengths)``: pieces in descending order in ``groups`` groups of equal numbers; size is a group's largest length.

    Groups that round up to the same size are one.
    """
    total, out, seen = sum(counts.values()), [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            group = seen * groups // total
            stop = -(-(group + 1) * total // groups)  # the first number of the next group
            n = min(left, stop - seen)
            if out and (out[-1][2] == group or out[-1][0] == length):
                out[-1][1][length] = out[-1][1].get(length, 0) + n
                out[-1][2] = group
            else:
                out.append([length, {length: n}, group])
            seen, left = seen + n, left - n
    return [(size, lengths) for size, lengths, _ in out]


def knapsacks(sizes: np.ndarray, values: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For every size the most valuable configuration that holds it: their values, and a row each of how many of each size."""
    at = np.arange(window + 1)[:, None] - sizes  # room left beside a piece
    fits, at = at >= 0, np.maximum(at, 0)
    best, choice = [np.zeros(window + 1)], []
    for _ in range(window // int(sizes.min()) - 1):  # one more piece at a time
        got = np.where(fits, best[-1][at] + values, 0)
        pick = got.argmax(1)
        more = got[np.arange(window + 1), pick]
        choice.append(np.where(more > best[-1], pick, -1))
        best.append(np.maximum(more, best[-1]))
    held = np.eye(len(sizes), dtype=np.int64)
    room, every = window - sizes, np.arange(len(sizes))
    total = values + best[-1][room]
    for taken in choice[::-1]:
        i = taken[room]
        some = i >= 0
        held[every[some], i[some]] += 1
        room = np.where(some, room - sizes[i], room)
    return total, held


def configurations(sizes: list[int], demand: list[int], window: int) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used, fractions allowed, so that every size is met as often as asked with least windows.

    The simplex method with column generation: configurations found are tried
    again before more are sought, and the search ends where no configuration
    saves more than ``GAIN`` of a window.
    """
    s, n = np.array(sizes, np.int64), len(sizes)
    basis = np.diag(window // s).astype(float)
    x = np.array(demand, float) / np.diag(basis)
    inverse, known = np.diag(1 / np.diag(basis)), np.zeros((0, n))
    for step in range(STEPS):
        if step % 64 == 63:
            inverse = np.linalg.inv(basis)
        duals = inverse.sum(0)
        worth = known @ duals
        if not len(worth) or worth.max() <= 1 + GAIN:
            values, found = knapsacks(s, duals, window)
            known = np.concatenate([known[worth > 1 - 0.01], found[values > 1 + GAIN]])
            worth = known @ duals
            if not (worth > 1 + GAIN).any():
                break
        column = known[int(worth.argmax())]
        direction = inverse @ column
        up = direction > 1e-9
        ratio = np.where(up, x / np.where(up, direction, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * direction, 0)
        x[out] = ratio[out]
        basis[:, out] = column
        row = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, row)
        inverse[out] = row
    return [(np.rint(basis[:, i]).astype(np.int64), float(x[i])) for i in range(n)]


@dataclass
class Kind:
    """``count`` windows that hold the same ``lengths`` (a length: how many) and have ``room``."""

    room: int
    count: int
    lengths: dict[int, int]


def substituted(pattern: list[int], times: int, queues: list[list[list[int]]], window: int) -> list[Kind]:
    """``times`` windows of one configuration with actual pieces, taken from the groups' queues of [length, count]."""
    slots = []
    for group, n in enumerate(pattern):
        for _ in range(n):
            taken, left = [], times
            while left:
                length, have = queues[group][0]
                n_taken = min(left, have)
                taken.append((length, n_taken))
                left -= n_taken
                queues[group][0][1] -= n_taken
                if not queues[group][0][1]:
                    queues[group].pop(0)
            slots.append(taken)
    edges = sorted({e for taken in slots for e in np.cumsum([n for _, n in taken]).tolist()})
    out, at, done = [], [0] * len(slots), [0] * len(slots)
    for before, edge in zip([0, *edges], edges):
        held: Counter = Counter()
        for i, taken in enumerate(slots):
            held[taken[at[i]][0]] += 1
            done[i] += edge - before
            if done[i] == taken[at[i]][1]:
                at[i], done[i] = at[i] + 1, 0
        out.append(Kind(window - sum(x * n for x, n in held.items()), edge - before, dict(held)))
    return out


def best_fit(kinds: list[Kind], counts: dict[int, int], window: int) -> list[Kind]:
    """All pieces of ``counts``, longest first, each in the fullest window with room for it, or a new one.

    A window that has just taken a piece is the fullest; if another piece of
    the length fits, it goes there too.  So windows with one room are filled
    one after the other, and whole counts of them change at a time.
    """
    open_, closed = sorted((k for k in kinds if k.room), key=lambda k: k.room), [k for k in kinds if not k.room]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(open_, length, key=lambda k: k.room)
            kind = open_.pop(i) if i < len(open_) else Kind(window, left, {})
            fits = kind.room // length
            full, rest = min(kind.count, left // fits), 0
            if full < kind.count and left > full * fits:
                rest = left - full * fits
            changed = [(fits, full), (rest, 1 if rest else 0), (0, kind.count - full - (1 if rest else 0))]
            if not kind.lengths:  # new windows: no more than are used
                changed.pop()
            for n, count in changed:
                if count:
                    lengths = dict(kind.lengths)
                    if n:
                        lengths[length] = lengths.get(length, 0) + n
                    new = Kind(kind.room - n * length, count, lengths)
                    if new.room:
                        open_.insert(bisect_left(open_, new.room, key=lambda k: k.room), new)
                    else:
                        closed.append(new)
            left -= full * fits + rest
    return closed + open_


def plan(counts: dict[int, int], window: int, groups: int = GROUPS, large: float = LARGE) -> list[Kind]:
    """Windows for ``counts`` pieces of each length from 1 to ``window``."""
    counts = {x: n for x, n in counts.items() if n}
    kinds = [Kind(0, counts.pop(window), {window: 1})] if window in counts else []
    wait = {x: n for x, n in counts.items() if x <= window * large}
    big = {x: n for x, n in counts.items() if x > window * large}
    if big:
        found = grouped(big, groups)
        queues = [[[x, n] for x, n in lengths.items()] for _, lengths in found]
        for pattern, times in configurations([size for size, _ in found], [sum(x.values()) for _, x in found], window):
            held = [sum(n for _, n in q) for q in queues]
            whole = min([int(times + 1e-6), *(h // int(p) for h, p in zip(held, pattern) if p)])
            if whole:
                kinds += substituted(pattern.tolist(), whole, queues, window)
        for q in queues:
            for x, n in q:
                wait[x] = wait.get(x, 0) + n
    return best_fit(kinds, wait, window)


def runs(kinds: list[Kind]) -> list[tuple[int, int, int, int, int, int]]:
    """``length, first, stop, per, sequence, at``: pieces first .. stop - 1 of a length lie ``per`` a window, from window ``sequence`` and place ``at`` on."""
    used: Counter = Counter()
    out, sequence = [], 0
    for k in kinds:
        offset = 0
        for length, per in k.lengths.items():
            out.append((length, used[length], used[length] + k.count * per, per, sequence, offset))
            used[length] += k.count * per
            offset += length * per
        sequence += k.count
    return out


def cut(docs: DataFrame, path: str, window: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents (columns of ``PIECES``): whole windows, but for the first piece of a document.

    A document's ids are those of its text (null: none) and then ``end_id``.
    ``nth`` numbers a task's pieces of one length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, _ = encoder(path)
        task, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.asarray([*encode(text or ""), end_id], "<u4")
                edges = [0, *range((len(ids) - 1) % window + 1, len(ids) + 1, window)]
                for i, (a, z) in enumerate(zip(edges, edges[1:])):
                    rows.append((doc_id, i, a, z - a, ids[a:z].tobytes(), task, int(seen[z - a])))
                    seen[z - a] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64()]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids", "task", "nth"])

    picked = docs.select(docs[id_col].cast("bigint").alias("k"), docs[text_col].cast("string").alias("t"))
    return map_batches(picked, run, PIECES)


def place(pieces: DataFrame, window: int = 1024, groups: int = GROUPS, large: float = LARGE) -> DataFrame:
    """``pieces(length, task, nth, ...)`` with ``sequence_id`` and ``offset`` in place of ``task`` and ``nth``.

    ``pieces`` is written once; the counts by task and length give each
    task's first number of a length, so pieces are numbered without being
    sorted or met at their length, however many have it.  The counts by length
    (at most ``window``) go to the driver, and the runs (a bounded number for
    each length and group) to the tasks.
    """
    pieces = materialize(pieces)
    counts = materialize(pieces.groupBy("task", "length").agg(F.count("*").alias("n")))
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    begin = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    found = runs(plan(total, window, groups, large))
    table = F.broadcast(pieces.sparkSession.createDataFrame(found, RUNS).withColumnRenamed("length", "run"))
    number = F.col("begin") + F.col("nth")
    met = pieces.join(begin, ["task", "length"]).withColumn("number", number)
    met = met.join(table, (F.col("length") == F.col("run")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("stop")))
    nth = F.col("number") - F.col("first")
    sequence = F.col("sequence") + F.expr("(number - first) div per")
    others = [c for c in pieces.columns if c not in ("task", "nth")]
    return met.select(*others, sequence.alias("sequence_id"), (F.col("at") + nth % F.col("per") * F.col("length")).alias("offset"))


def pack(docs: DataFrame, path: str, window: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids, sequence_id, offset``: all documents in few sequences of at most ``window`` tokens.

    ``ids`` are little-endian unsigned 32-bit.  An empty or null text is a
    piece of one token; rows are packed as they come, so repeated rows and
    null ids have pieces of their own; an empty table has none; columns
    besides the two named are ignored.
    """
    return place(cut(docs, path, window, end_id, id_col, text_col), window)


def digests(pieces: DataFrame) -> DataFrame:
    """``pieces`` with their ids' CRC-32 in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
