"""Clustering, infilling and best-fit packing against brute force, and their edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tracewell.llm import best_fit, centroids, infill

BPE = P.path("byte_bpe_50k.json")
VECTORS = "vec_id bigint, embedding array<float>, label int"

# --- 11 ---


def plain_clusters(rows, k, rounds, dim):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in first[:k]]
    for turn in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(at)) for _, v in kept]
        if turn < rounds:
            for n in range(len(at)):
                mine = [v for (_, v), (_, c) in zip(kept, found) if c == n]
                at[n] = [sum(x) // len(mine) for x in zip(*mine)] if mine else at[n]
    return sorted((i if i is not None else -1, n, d) for (i, _), (d, n) in zip(kept, found)), at


def vectors(seed=3, n=300, dim=8):
    rng = random.Random(seed)
    centres = [[rng.uniform(-2, 2) for _ in range(dim)] for _ in range(5)]
    out = [(i, [float(np.float32(rng.gauss(x, 0.4))) for x in rng.choice(centres)]) for i in range(n)]
    same = out[5][1]
    out += [(n + i, same) for i in range(n // 2)]  # a third are one vector
    out += [(7, out[7][1]), (7, out[8][1]), (None, out[9][1]), (None, [0.0] * dim), (9001, None), (9002, []), (9003, [1.0] * (dim + 1))]
    out += [(9004, [None] + [1.0] * (dim - 1)), (9005, [float("nan")] * dim), (9006, [1.0] * (dim - 1) + [float("-inf")])]
    return out


@pytest.mark.parametrize("k, rounds", [(4, 3), (16, 3), (1, 1), (500, 1)])
def test_clusters_equal_those_of_all_comparisons(spark, k, rounds):
    rows = vectors()
    df = spark.createDataFrame([(*r, 0) for r in rows], VECTORS).repartition(5).withColumns({"id": F.lit("x"), "v": F.lit(1), "cluster": F.lit("y"), "distance": F.lit(2), "row": F.lit(3)})
    got, at = centroids.cluster(df, k=k, rounds=rounds, dimensions=8)
    want, want_at = plain_clusters(rows, k, rounds, 8)
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance) for r in got.collect()) == want
    assert at == want_at


def test_digests_sum_up_clusters(spark):
    got, at = centroids.cluster(spark.createDataFrame([(*r, 0) for r in vectors()], VECTORS), k=4, dimensions=8)
    by = Counter()
    rows = centroids.digests(got, at).collect()
    for r in rows:
        by[r.cluster] += r.distance
    assert {(r.cluster, r.cluster_inertia) for r in rows} == set(by.items()) and {r.inertia for r in rows} == {sum(by.values())}
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, at[r.cluster])).encode()).hexdigest() for r in rows)


def test_no_vectors(spark):
    for rows in ([], [(1, [1.0], 0), (None, None, None)]):
        got, at = centroids.cluster(spark.createDataFrame(rows, VECTORS))
        assert at == [] and centroids.digests(got, at).collect() == [] and got.collect() == []


def test_the_annulus_keeps_ties_and_leaves_centroids_out():
    rng = np.random.default_rng(5)
    shells = (rng.normal(size=(64, 6)) * np.repeat([3, 40, 400, 4000], 16)[:, None]).astype(np.int64)
    v = shells[rng.integers(0, 64, 400)] + rng.integers(-2, 3, (400, 6))
    d = ((v[:, None] - shells) ** 2).sum(2)
    for known in (np.full(400, -1), rng.integers(0, 64, 400), d.argmin(1)):
        best, distance, compared = centroids.nearest(v, known, shells)
        assert (best == d.argmin(1)).all() and (distance == d.min(1)).all()
    assert compared < 400 * 64 / 4  # with a good bound other shells are never looked at
    ring = np.array([[0, 5], [5, 0], [0, -5], [-5, 0], [5, 0], [3, 4]])  # all at the same norm and distance of the origin
    best, distance, _ = centroids.nearest(np.zeros((3, 2), np.int64), np.array([5, 4, -1]), ring)
    assert best.tolist() == [0, 0, 0] and distance.tolist() == [25, 25, 25]
    far = np.array([[1 << 29, 0]])
    best, distance, _ = centroids.nearest(np.array([[-(1 << 29), 0]]), np.array([-1]), far)
    assert distance.tolist() == [1 << 60]


# --- 12 ---


def plain_infill(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def test_infill_equals_cuts_of_an_array_and_restores(spark, corpus):
    rows = corpus + [(9000 + i, t) for i, t in enumerate(["<P>", "a<S>b", "<M", "<S<S<P<M", "<", "\n\r\x85  é", "é", "ab1cd", "<P" * 40, "word " * 120_000])] + [(None, "no id here"), (1, "again"), (1, "again")]
    df = spark.createDataFrame([(d, t) for d, t in rows], "doc_id bigint, text string").withColumns({"k": F.lit(0), "h": F.lit("x"), "t": F.lit(1), "output": F.lit(2), "n": F.lit(3), "form": F.lit("z")})
    made = infill.transform(df)
    want = sorted(((d, *plain_infill(d, t)) for d, t in rows), key=repr)
    got = sorted((tuple(r) for r in made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()), key=repr)
    assert got == want
    assert {"plain", "psm", "spm"} == {r[2] for r in got}
    back = made.select(infill.restored(F.col("output"), F.col("form"))).collect()
    assert Counter(r[0] for r in back) == Counter(t or "" for _, t in rows)


def test_infill_of_an_empty_table(spark, empty):
    assert infill.digests(infill.transform(empty)).collect() == []


@pytest.mark.parametrize("ranks", [(0, 0), (0, 3), (2, 2), (1, 4), (5, 5)])
def test_ranks(ranks):
    text, unit = "ab, c1", re.compile(infill.UNIT)
    edges = [0, *(m.end() for m in unit.finditer(text))]
    assert infill.count(text, unit) == len(edges) - 1 == 5
    assert infill.ends(text, unit, ranks) == (edges[ranks[0]], edges[ranks[1]])


# --- 13 ---


def check_plan(counts, window, kinds):
    held = Counter()
    for k in kinds:
        assert k.count > 0 and k.room == window - sum(x * n for x, n in k.lengths.items()) >= 0
        for x, n in k.lengths.items():
            held[x] += n * k.count
    assert held == Counter({x: n for x, n in counts.items() if n})
    return sum(k.count for k in kinds)


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_all_pieces_in_few_windows(seed):
    rng = np.random.default_rng(seed)
    window = 1024
    lengths = np.concatenate([rng.integers(1, window + 1, 3000), np.minimum(rng.geometric(0.004, 4000), window), np.full(2500, 700)])
    counts = dict(Counter(lengths.tolist()))
    least = max(-(-int(lengths.sum()) // window), int((lengths > window // 2).sum()))
    longest_first = sum(k.count for k in best_fit.best_fit([], counts, window))
    assert least <= check_plan(counts, window, best_fit.plan(counts, window)) <= longest_first * 1.002 + 1
    assert check_plan(counts, window, best_fit.plan(counts, window, groups=8)) <= longest_first * 1.25


def test_configurations_beat_greedy_filling():
    counts = {341: 300, 300: 300, 383: 300}  # three of different lengths fill a window; a window takes no four
    assert check_plan(counts, 1024, best_fit.plan(counts, 1024)) <= 304
    thirds = {460: 100, 300: 100, 264: 100}  # longest first puts 460 with 460
    assert check_plan(thirds, 1024, best_fit.plan(thirds, 1024)) == 100 < sum(k.count for k in best_fit.best_fit([], thirds, 1024))


def least_windows(items, window):
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= items[i]:
                rest = list(rooms)
                rest[rest.index(r)] -= items[i]
                go(i + 1, rest)
        go(i + 1, [*rooms, window - items[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(12))
def test_small_plans_against_all_packings(seed):
    rng = random.Random(seed)
    items = sorted((rng.randint(1, 16) for _ in range(rng.randint(1, 9))), reverse=True)
    assert check_plan(Counter(items), 16, best_fit.plan(Counter(items), 16)) <= least_windows(items, 16) + 1


def test_groups_are_equal_and_round_up():
    counts = {900: 3, 700: 40, 500: 7, 400: 10}
    found = best_fit.grouped(counts, 6)
    assert sum((Counter(x) for _, x in found), Counter()) == counts
    assert all(size == max(x) for size, x in found) and [s for s, _ in found] == sorted({s for s, _ in found}, reverse=True)
    assert best_fit.grouped({5: 2, 3: 1}, 512) == [(5, {5: 2}), (3, {3: 1})]


def test_best_fit_takes_the_fullest_window_with_room():
    kinds = [best_fit.Kind(10, 2, {6: 1}), best_fit.Kind(7, 3, {9: 1})]
    got = best_fit.best_fit(kinds, {3: 9}, 16)
    assert sorted((k.room, k.count) for k in got) == [(1, 3), (1, 1), (10, 1)] or sorted((k.room, k.count) for k in got) == [(1, 1), (1, 3), (10, 1)]


def test_pieces_tile_documents_and_sequences(spark, documents, corpus):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(BPE)
    want = {d: [*coder.encode(t or "", add_special_tokens=False).ids, 2] for d, t in corpus}
    rows = best_fit.pack(documents, BPE, window=64).collect()
    by, of = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        of.setdefault(r.sequence_id, []).append(r)
    assert set(by) == set(want)
    for d, found in by.items():
        found.sort(key=lambda r: r.piece)
        assert [r.piece for r in found] == list(range(len(found))) and np.concatenate([np.frombuffer(r.ids, "<u4") for r in found]).tolist() == want[d]
        assert [r.start for r in found] == np.cumsum([0, *(r.length for r in found)])[:-1].tolist()
        assert all(r.length == 64 for r in found[1:]) and found[0].length == (len(want[d]) - 1) % 64 + 1
    for found in of.values():
        found.sort(key=lambda r: r.offset)
        assert [r.offset for r in found] == np.cumsum([0, *(r.length for r in found)])[:-1].tolist() and sum(r.length for r in found) <= 64
    least = -(-sum(map(len, want.values())) // 64)
    assert least <= len(of) <= least + 2


def test_odd_tables_of_documents(spark, odd, empty):
    rows = best_fit.pack(odd, BPE).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter([None, None, 1, 1, 1, 2, 2, 3])
    assert sum(r.length == 1 for r in rows) == 3  # two null texts and an empty one
    assert best_fit.pack(empty, BPE).collect() == []


def test_a_length_that_a_third_of_all_pieces_have(spark):
    df = spark.createDataFrame([(i, "same words" if i % 3 else "other words, " * (i % 50)) for i in range(3000)], "doc_id bigint, text string").repartition(8)
    made = best_fit.place(best_fit.digests(best_fit.cut(df, BPE, 128)), 128)
    rows = made.collect()
    assert made.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) >= 3000
    same = {r.ids_crc32 for r in rows if r.doc_id % 3}
    assert len(same) == 1 and max(Counter(r.sequence_id for r in rows).values()) > 10
