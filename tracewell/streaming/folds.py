"""Rows of a key folded in their order with bounded state, over a table or a stream ([S2], [R7], [R9], [R11]).

A machine has a state that fits JSON, and a step from a row to the rows it
gives out.  Over a table each task streams through its keys' sorted rows; over
a stream the state outlives micro-batches and restarts.  Neither holds a key's
rows at once; what is sequential by nature, one key, is one task's work.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Keys that appends remember, records that a duplicate is looked for in, and entries of an emission ring.
RECENT, SCANNED, RING = 256, 512, 4_096


class UniqueAppend:
    """[S2, S40] ``id, fingerprint, once``: each row's outcome.

    A row that is not ``once`` is appended.  One that is: a ``duplicate`` if
    its id or fingerprint is among the last ``RECENT`` keys of such appends or
    in the last ``SCANNED`` records; else ``scan_cap_exceeded`` if the log has
    more records than that; else ``appended``.
    """

    OUT = "outcome string"

    def __init__(self, state: dict | None):
        s = state or {"recent": [], "tail": [], "size": 0}
        self.recent, self.tail, self.size = dict.fromkeys(s["recent"]), [tuple(x) for x in s["tail"]], s["size"]

    def dump(self) -> dict:
        return {"recent": list(self.recent), "tail": self.tail, "size": self.size}

    def step(self, row: dict[str, Any]) -> list[tuple]:
        name, print_ = row["id"], row["fingerprint"]
        keys = [f"id:{name}", f"fingerprint:{print_}"] if print_ is not None else [f"id:{name}"]
        if row["once"]:
            seen = any(name == i or print_ is not None and print_ == p for i, p in self.tail)
            if seen or any(k in self.recent for k in keys):
                return [("duplicate",)]
            if self.size > SCANNED:
                return [("scan_cap_exceeded",)]
            for k in keys:
                self.recent[k] = None
            while len(self.recent) > RECENT:
                del self.recent[next(iter(self.recent))]
        self.tail = [*self.tail[1 - SCANNED :], (name, print_)]
        self.size += 1
        return [("appended",)]


class Emission:
    """[R9, T13] ``event, attempts (alias, severity), aliases``: the attempt that an event lets out, if any.

    An event lets out one attempt: the most severe of those whose alias is
    known and which the ring does not have; the events and attempts of the
    last ``RING`` are remembered, the oldest is overwritten.
    """

    OUT = "alias string, severity string"

    def __init__(self, state: dict | None):
        s = state or {"attempts": [], "events": []}
        self.attempts, self.events = dict.fromkeys(s["attempts"]), dict.fromkeys(s["events"])

    def dump(self) -> dict:
        return {"attempts": list(self.attempts), "events": list(self.events)}

    def step(self, row: dict[str, Any]) -> list[tuple]:
        event, known = row["event"], set(row["aliases"] if row["aliases"] is not None else ())
        if event in self.events:
            return []
        ranked = []
        for a in row["attempts"] if row["attempts"] is not None else ():
            alias, severity = a["alias"], a["severity"]
            if alias in known and severity in ("concern", "blocker") and f"{event}:{severity}:{alias}" not in self.attempts:
                ranked.append((severity != "blocker", len(ranked), alias, severity))
        if not ranked:
            return []
        *_, alias, severity = min(ranked)
        for ring, key in ((self.attempts, f"{event}:{severity}:{alias}"), (self.events, event)):
            ring[key] = None
            if len(ring) > RING:
                del ring[next(iter(ring))]
        return [(alias, severity)]


class Drafts:
    """[R11] ``at, settle``: sessions of touches no more than ``TTL`` seconds apart, given out when they are over."""

    OUT = "session bigint, opened double, touched double, touches bigint"
    TTL = 900

    def __init__(self, state: dict | None):
        self.held = state or {"session": 0, "opened": None, "touched": None, "touches": 0}

    def dump(self) -> dict:
        return self.held

    def step(self, row: dict[str, Any]) -> list[tuple]:
        h, at = self.held, float(row["at"])
        over = h["opened"] is not None and (row["settle"] or at - h["touched"] > self.TTL)
        out = [(h["session"], h["opened"], h["touched"], h["touches"])] if over else []
        if row["settle"]:
            self.held = {"session": h["session"], "opened": None, "touched": None, "touches": 0}
        elif over or h["opened"] is None:
            self.held = {"session": h["session"] + 1, "opened": at, "touched": at, "touches": 1}
        else:
            self.held = h | {"touched": at, "touches": h["touches"] + 1}
        return out


class Coalescing:
    """[R7] ``name, drain``: deltas of a name merge while it waits; ``MOST`` names wait, a further one is dropped; a drain gives the first out."""

    OUT = "waiting string, first bigint, last bigint, merged bigint, state string"
    MOST = 5

    def __init__(self, state: dict | None):
        self.queue = state or {}

    def dump(self) -> dict:
        return self.queue

    def step(self, row: dict[str, Any]) -> list[tuple]:
        name, pos = row["name"], int(row["pos"])
        if row["drain"]:
            if not self.queue:
                return []
            first = next(iter(self.queue))
            return [(first, *self.queue.pop(first), "drained")]
        if name in self.queue:
            first, _, merged = self.queue[name]
            self.queue[name] = [first, pos, merged + 1]
        elif len(self.queue) < self.MOST:
            self.queue[name] = [pos, pos, 1]
        else:
            return [(name, pos, pos, 1, "dropped")]
        return []


def _schema(df: DataFrame, key: str, order: str, machine: type) -> str:
    return f"{key} {df.schema[key].dataType.simpleString()}, {order} {df.schema[order].dataType.simpleString()}, {machine.OUT}"


def _records(frame: pd.DataFrame) -> Iterator[dict[str, Any]]:
    names = list(frame.columns)
    columns = [frame[n].astype(object).where(frame[n].notna(), None) for n in names]
    for values in zip(*columns):
        yield dict(zip(names, values))


def fold(rows: DataFrame, machine: type, key: str, order: str) -> DataFrame:
    """``key, order`` and the machine's columns for every row that the machine gives out, keys' rows taken by ``order``."""
    schema = _schema(rows, key, order, machine)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, m = object(), None
        for frame in frames:
            out = []
            for row in _records(frame):
                if m is None or row[key] != now:
                    now, m = row[key], machine(None)
                out += [(now, row[order], *given) for given in m.step(row)]
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


def fold_stream(rows: DataFrame, machine: type, key: str, order: str) -> DataFrame:
    """``fold`` over a stream: rows are taken by ``order`` within a micro-batch, micro-batches as they come."""
    schema = _schema(rows, key, order, machine)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = machine(json.loads(state.get[0]) if state.exists else None)
        frame = pd.concat(list(frames)).sort_values(order, kind="stable")  # one key's rows of one micro-batch, which a trigger bounds
        out = [(group[0], row[order], *given) for row in _records(frame) for given in m.step(row)]
        state.update((json.dumps(m.dump()),))
        yield pd.DataFrame(out, columns=names)

    return rows.groupBy(key).applyInPandasWithState(run, schema, "held string", "append", GroupStateTimeout.NoTimeout)


def settled(rows: DataFrame, key: str, order: str, at: str) -> DataFrame:
    """Touches with ``settle``, and after a key's last a row that settles it (as far as the table goes)."""
    last = rows.groupBy(key).agg((F.max(order) + 1).alias(order), F.max(at).alias(at)).withColumn("settle", F.lit(True))
    return rows.select(key, order, at, F.lit(False).alias("settle")).unionByName(last)
