"""Bounded folds against plain loops, over a table and over streams that are restarted."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.streaming import folds

APPENDS = "log string, pos bigint, id string, fingerprint string, once boolean"
UPDATES = "scope string, pos bigint, event string, attempts array<struct<alias:string,severity:string>>, aliases array<string>"
TOUCHES = "scope string, pos bigint, at double, settle boolean"
DELTAS = "scope string, pos bigint, name string, drain boolean"


def appends(rng, n):
    return [(rng.choice("ab"), i, f"i{rng.randrange(n)}", rng.choice([None, f"f{rng.randrange(n)}"]), rng.random() < 0.6) for i in range(n)]


def plain_appends(rows, recent, scanned):
    logs, rings, out = {}, {}, []
    for log, pos, name, print_, once in rows:
        records, ring = logs.setdefault(log, []), rings.setdefault(log, [])
        keys = [("id", name)] + ([("fp", print_)] if print_ is not None else [])
        if once:
            tail = records[-scanned:]
            if any(k in ring for k in keys) or any(r[0] == name or (print_ is not None and r[1] == print_) for r in tail):
                out.append((log, pos, "duplicate"))
                continue
            if len(records) > scanned:
                out.append((log, pos, "scan_cap_exceeded"))
                continue
            for k in keys:
                if k in ring:
                    ring.remove(k)
                ring.append(k)
            del ring[:-recent]
        records.append((name, print_))
        out.append((log, pos, "appended"))
    return out


def updates(rng, n):
    made = []
    for i in range(n):
        tries = [(rng.choice(["h1", "h2", "h9"]), rng.choice(["concern", "blocker", "note"])) for _ in range(rng.randrange(4))]
        made.append((rng.choice("st"), i, f"e{rng.randrange(n // 2)}", tries, ["h1", "h2"]))
    return made


def plain_updates(rows, ring):
    seen, tried, out = {}, {}, []
    for scope, pos, event, tries, known in rows:
        events, attempts = seen.setdefault(scope, []), tried.setdefault(scope, [])
        if event in events:
            continue
        good = [(a, s) for a, s in tries if a in known and s != "note" and (event, s, a) not in attempts]
        if not good:
            continue
        alias, severity = next((g for g in good if g[1] == "blocker"), good[0])
        attempts.append((event, severity, alias))
        events.append(event)
        del attempts[:-ring], events[:-ring]
        out.append((scope, pos, alias, severity))
    return out


def touches(rng, n):
    at, out = 0.0, []
    for i in range(n):
        at += rng.choice([1, 899, 900, 901, 5000])
        out.append((rng.choice("st"), i, at, rng.random() < 0.05))
    return out


def plain_touches(rows):
    held, number, out = {}, {}, []
    for scope, pos, at, settle in rows:
        h = held.get(scope)
        if h and (settle or at - h[1] > 900):
            out.append((scope, pos, number[scope], *h))
            h = held[scope] = None
        if settle:
            continue
        if h:
            held[scope] = (h[0], at, h[2] + 1)
        else:
            number[scope] = number.get(scope, 0) + 1
            held[scope] = (at, at, 1)
    return out


def deltas(rng, n):
    return [(rng.choice("st"), i, f"k{rng.randrange(9)}", rng.random() < 0.3) for i in range(n)]


def plain_deltas(rows):
    queues, out = {}, []
    for scope, pos, name, drain in rows:
        q = queues.setdefault(scope, [])
        held = next((x for x in q if x[0] == name), None)
        if drain:
            if q:
                out.append((scope, pos, *q.pop(0), "drained"))
        elif held:
            q[q.index(held)] = (name, held[1], pos, held[3] + 1)
        elif len(q) < 5:
            q.append((name, pos, pos, 1))
        else:
            out.append((scope, pos, name, pos, pos, 1, "dropped"))
    return out


CASES = {
    "append": (folds.UniqueAppend, "log", APPENDS, lambda r: appends(r, 400), lambda rows: plain_appends(rows, 20, 60)),
    "emission": (folds.Emission, "scope", UPDATES, lambda r: updates(r, 200), lambda rows: plain_updates(rows, 25)),
    "drafts": (folds.Drafts, "scope", TOUCHES, lambda r: touches(r, 150), plain_touches),
    "coalescing": (folds.Coalescing, "scope", DELTAS, lambda r: deltas(r, 200), plain_deltas),
}


@pytest.mark.parametrize("name", CASES)
def test_machines_against_plain_loops(monkeypatch, name):
    """Random rows, the state dumped and read again after every row."""
    import json

    monkeypatch.setattr(folds, "RECENT", 20), monkeypatch.setattr(folds, "SCANNED", 60), monkeypatch.setattr(folds, "RING", 25)
    machine, _, schema, make, plain = CASES[name]
    fields = [f.split()[0] for f in schema.replace("array<struct<alias:string,severity:string>>", "x").split(", ")]
    for seed in range(20):
        rows, states, out = make(random.Random(seed)), {}, []
        for row in rows:
            m = machine(json.loads(states[row[0]]) if row[0] in states else None)
            values = dict(zip(fields, row))
            if "attempts" in values:
                values["attempts"] = [{"alias": a, "severity": s} for a, s in values["attempts"]]
            out += [(row[0], row[1], *given) for given in m.step(values)]
            states[row[0]] = json.dumps(m.dump())
        assert out == plain(rows), seed
    if name == "append":
        assert {o[2] for o in out} == {"appended", "duplicate", "scan_cap_exceeded"}


@pytest.mark.parametrize("name", CASES)
def test_tables_and_restarted_streams_agree(spark, tmp_path, name):
    machine, key, schema, make, _ = CASES[name]
    rows = make(random.Random(3))
    df = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, folds.fold(df.repartition(3), machine, key, "pos").collect()))
    assert want
    inbox = str(tmp_path / "in")
    third = len(rows) // 3 + 1
    for part in range(3):  # each run is a restart from the checkpoint
        spark.createDataFrame(rows[part * third : (part + 1) * third], schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = folds.fold_stream(spark.readStream.schema(df.schema).parquet(inbox), machine, key, "pos")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want


def test_drafts_equal_the_batch_twin(spark):
    from tracewell.streaming import capture

    rows = [(s, p, a) for s, p, a, _ in touches(random.Random(5), 200)]
    df = spark.createDataFrame(rows, "scope string, pos bigint, at double")
    twin = capture.drafts(df.withColumn("ts", F.timestamp_seconds("at"))).select("scope", "session", F.unix_timestamp("opened").cast("double"), F.unix_timestamp("touched").cast("double"), "touches")
    got = folds.fold(folds.settled(df, "scope", "pos", "at"), folds.Drafts, "scope", "pos").select("scope", "session", "opened", "touched", "touches")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, twin.collect()))
