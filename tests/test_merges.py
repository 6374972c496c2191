"""Chains of merges, and prefixes within a bound."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tracewell.functions import exprs as X
from tracewell.operators import lifecycle


def plain_ends(pairs):
    to = {}
    for a, b in pairs:
        to[a] = min(b, to.get(a, b))
    out = {}
    for a in to:
        seen, x = {a}, to[a]
        while x in to and x not in seen:
            seen.add(x)
            x = to[x]
        out[a] = (None, True) if x in to else (x, False)
    return out


def ends(spark, pairs):
    found = lifecycle.last_survivors(spark.createDataFrame(pairs, "loser long, survivor long")).collect()
    return {r.loser: (r.survivor, r.refused) for r in found}


def test_chains_and_circles(spark):
    chain = [(i, i - 1) for i in range(1, 101)]
    assert ends(spark, chain) == {i: (0, False) for i in range(1, 101)}
    for pairs in ([(1, 2), (2, 1)], [(5, 5)], [(1, 2), (2, 3), (3, 1), (9, 1), (8, 7)], [(1, 4), (1, 2), (2, 0)], []):
        assert ends(spark, pairs) == plain_ends(pairs)


@pytest.mark.parametrize("seed", range(3))
def test_random_decisions(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    assert ends(spark, pairs) == plain_ends(pairs)


def test_evidence_and_references_follow(spark):
    habits = spark.createDataFrame([(i, "active", [f"r{i}", "shared"]) for i in range(200)], "id long, status string, refs array<string>")
    evidence = spark.createDataFrame([(i % 210, i) for i in range(1000)], "habit_id long, seq long")
    plan = spark.createDataFrame([*((i, i - 1) for i in range(1, 150)), (160, 161), (161, 160), (170, 999)], "loser long, survivor long")
    after, moved = lifecycle.merged_chains(habits, evidence, plan)
    rows = {r.id: r for r in after.collect()}
    assert all(rows[i].status == "archived" and rows[i].superseded_by == 0 for i in range(1, 150))
    assert all(rows[i].status == "active" and rows[i].superseded_by is None and rows[i].refs == [f"r{i}", "shared"] for i in (0 + 150, 160, 161, 170))
    assert rows[0].refs == sorted({f"r{i}" for i in range(150)} | {"shared"})[:64]
    proof = moved.collect()
    assert sorted(r.seq for r in proof) == list(range(1000))
    assert sum(r.habit_id == 0 for r in proof) == sum(i % 210 < 150 for i in range(1000))


@pytest.mark.parametrize("n", [1, 2, 5, 12, 13])
def test_prefixes_against_all_lengths(spark, n):
    texts = ["", "a", "plain text of more", 'q"uo\\te"s\n\t', "é😀ü€😀😀", "\x01\x02\x03abc", "  end   ", "😀" * 9, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, b, j in df.select("t", X.utf8_prefix(F.col("t"), n), X.json_prefix(F.col("t"), n)).collect():
        if t is None:
            assert b is None and j is None
            continue
        want = max((t[:k] for k in range(len(t) + 1) if len(t[:k].encode()) <= n), key=len)
        assert b == want.rstrip(" \t\n\r\f\v")
        fits = [t[:k] for k in range(len(t) + 1) if len(json.dumps(t[:k], ensure_ascii=False)) <= n]
        assert j == (max(fits, key=len) if fits else "")


def test_long_bounds_take_seconds(spark):
    df = spark.range(2_000).select(F.concat(F.repeat(F.lit('é"x'), 30_000), F.col("id").cast("string")).alias("t"))
    began = time.perf_counter()
    got = df.select(F.length(X.utf8_prefix(F.col("t"), 65_536)).alias("u"), F.length(X.json_prefix(F.col("t"), 65_536)).alias("j")).agg(F.min("u"), F.max("u"), F.min("j"), F.max("j")).first()
    assert tuple(got) == (49_152, 49_152, 49_150, 49_150) and time.perf_counter() - began < 120
