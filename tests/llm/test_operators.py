"""The ten operators' contracts against brute force, and their edge cases."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tracewell.llm import chat, fingerprint, lm_scoring, packing, quality_model, quality_rules, sharding, simhash, suffix_dedup, tokens

BPE = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
LABELS = "doc_id bigint, quality int, toxic int"


def rows(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select(*columns).collect()}


# --- 1 ---


def test_shards_are_even_and_hold_groups_together(spark, documents, corpus):
    got = sharding.shard_documents(documents, 4).collect()
    assert len(got) == len(corpus)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sorted(map(len, by.values()))[-1] - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    text = dict(corpus)
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in got)
    where = defaultdict(set)
    for r in got:
        where[text[r.doc_id] or ""].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_a_group_with_a_third_of_all_rows_is_split_no_more_than_quotas_ask(spark):
    df = spark.createDataFrame([(i, "copy" if i % 3 == 0 else f"text {i}") for i in range(900)], "doc_id bigint, text string")
    got = sharding.shard_documents(df, 10).collect()
    sizes = np.bincount([r.shard for r in got], minlength=10)
    assert sizes.min() == sizes.max() == 90 and len({(r.shard, r.slot) for r in got}) == 900
    hot = np.bincount([r.shard for r in got if r.doc_id % 3 == 0], minlength=10)
    assert hot.max() == 90  # its preferred shard is full of it


def test_a_large_group_lies_in_the_fewest_shards_and_copies_stay_together(spark):
    texts = ["copy" if i % 3 == 0 else f"text {i}" for i in range(1200)]
    got = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 10).collect()
    hot = np.bincount([r.shard for r in got if r.doc_id % 3 == 0], minlength=10)
    assert sorted(hot)[-4:] == [40, 120, 120, 120]  # 400 rows, 120 a shard
    for size in (4, 30):  # every row has copies
        got = sharding.shard_documents(spark.createDataFrame([(i, f"text {i % (1200 // size)}") for i in range(1200)], "doc_id bigint, text string"), 10).collect()
        assert set(np.bincount([r.shard for r in got], minlength=10)) == {120}
        at = defaultdict(list)
        for r in got:
            at[r.doc_id % (1200 // size)].append(r.shard)
        assert sum(np.bincount(x).max() for x in at.values()) >= 0.95 * 1200


def test_propagation_swaps_places_and_follows_several_hubs(spark):
    assert sharding.grants(np.array([[0, 5], [3, 0]]), np.array([10, 10]), [10, 10]).tolist() == [[0, 3], [3, 0]]
    rng = np.random.default_rng(2)
    order = rng.permutation(400)  # blocks of 100 rows, each row in two of its block's hubs
    links = [(int(r), int(h)) for at, r in enumerate(order) for h in rng.permutation(8)[:2] * 4 + at // 100]
    labels = {r.row: r.shard for r in sharding.propagate(spark.createDataFrame(links, "row bigint, hub bigint"), [100] * 4).collect()}
    assert sorted(labels) == list(range(400)) and max(np.bincount(list(labels.values()), minlength=4)) <= 100
    start = {r.row: r.shard for r in sharding.dealt(spark.createDataFrame(links, "row bigint, hub bigint"), [100] * 4).collect()}
    together = lambda where: sum(n * n for n in Counter((h, where[r]) for r, h in links).values())
    assert together(labels) >= together(start)


@pytest.mark.parametrize("groups, others, shards", [([20] * 60, 0, 10), ([400, *range(2, 26)] * 2, 0, 8), (list(range(2, 30)), 300, 12)])
def test_propagation_brings_groups_together_from_an_even_start(spark, groups, others, shards):
    """Rounds move the rows: the start holds few pairs together, the end at least 95 % of those that quotas let."""
    rng = np.random.default_rng(4)
    hub = rng.permutation([g for g, n in enumerate(groups) for _ in range(n)])
    rows = len(hub) + others
    quotas = [rows // shards + (s < rows % shards) for s in range(shards)]
    log = []
    got = {r.row: r.shard for r in sharding.propagate(sharding.materialize(spark.createDataFrame([(i, int(h)) for i, h in enumerate(hub)], "row bigint, hub bigint")), quotas, log=log).collect()}
    assert sorted(got) == list(range(len(hub))) and all(n <= q for n, q in zip(np.bincount(list(got.values()), minlength=shards), quotas))
    most = max(quotas)
    reachable = sum(n // most * most * (most - 1) + n % most * (n % most - 1) for n in groups)
    together = sum(n * (n - 1) for n in Counter((h, got[i]) for i, h in enumerate(hub)).values())
    small = sum(n for n in groups if n <= most)
    assert log[0][0] < together and sum(granted for _, _, granted in log) >= 0.5 * small and 0.95 * reachable <= together <= reachable and len(log) < 10


def test_grants_keep_loads_and_swap_with_idle_rows():
    rng = np.random.default_rng(9)
    for _ in range(50):
        n = int(rng.integers(2, 7))
        asked = rng.integers(0, 6, (n, n)) * (rng.random((n, n)) < 0.5)
        np.fill_diagonal(asked, 0)
        load = asked.sum(1) + rng.integers(0, 9, n)
        idle = np.minimum(load - asked.sum(1), rng.integers(0, 5, n))
        quotas = load + rng.integers(0, 3, n)
        given = sharding.grants(asked, load, list(quotas), idle)
        assert (given >= 0).all() and (load + given.sum(0) - given.sum(1) <= quotas).all()
        assert (np.maximum(given - asked, 0).sum(1) <= idle).all()
        plain = sharding.grants(asked, load, list(quotas))
        assert (plain <= asked).all() and (load + plain.sum(0) - plain.sum(1) <= quotas).all()
    assert sharding.grants(np.array([[0, 4], [0, 0]]), np.array([5, 5]), [5, 5], np.array([0, 3])).tolist() == [[0, 3], [3, 0]]


def test_shards_of_odd_tables(empty, odd):
    assert sharding.shard_documents(empty, 4).count() == 0
    got = sharding.shard_documents(odd, 3).collect()
    assert len(got) == 8 and sorted(np.bincount([r.shard for r in got]).tolist()) == [2, 3, 3]


def test_few_edges_are_cut(spark):
    """Cut edges (pairs of equal texts in two shards) against those of random places and the least that quotas allow."""
    rng = np.random.default_rng(7)
    names = [f"text {i}" for i, n in enumerate([300, *rng.integers(2, 40, 60), *[1] * 200]) for _ in range(n)]
    rng.shuffle(names)
    got = sharding.shard_documents(spark.createDataFrame(list(enumerate(names)), "doc_id bigint, text string"), 8).collect()
    together = lambda where: sum(n * (n - 1) // 2 for n in Counter(zip(names, where)).values())
    found = together([r.shard for r in sorted(got, key=lambda r: r.doc_id)])
    every = together([0] * len(names))
    quota = -(-len(names) // 8)
    most = sum((n // quota) * (quota * (quota - 1) // 2) + (n % quota) * (n % quota - 1) // 2 for n in Counter(names).values())
    assert together(rng.integers(0, 8, len(names)).tolist()) < 0.2 * every and 0.97 * most <= found <= most


# --- 2 ---


def test_suffix_dedup(documents, corpus):
    got = rows(suffix_dedup.digests(suffix_dedup.dedup(documents, 100)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.suffix(corpus)


def test_suffix_dedup_of_windows_dealt_out_by_spark(monkeypatch, documents, corpus):
    monkeypatch.setattr(suffix_dedup, "CROWDED", 1)
    got = rows(suffix_dedup.digests(suffix_dedup.dedup(documents, 70)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.suffix(corpus, 70)


def test_suffix_dedup_streams_groups_across_batches(spark, documents, corpus):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = rows(suffix_dedup.digests(suffix_dedup.dedup(documents, 100)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute.suffix(corpus)


def test_suffix_dedup_where_ids_are_null_or_shared(spark):
    """One id for two texts, and many null ids, half of whose texts repeat: each row is judged by its own text."""
    shared = [(7, "x" * 40 + "passage that two documents have, word for word, and that is long enough to go. " * 2), (7, "quite another text of the same id, which nothing else repeats at all. " * 1 + "0123456789" * 8), (3, "passage that two documents have, word for word, and that is long enough to go. " * 2)]
    got = {(r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(spark.createDataFrame(shared, "doc_id bigint, text string")).filter("doc_id = 7").collect()}
    assert len(got) == 2 and {(n, r) for n, r in got if n == len(shared[1][1])} == {(len(shared[1][1]), 0)}
    texts = [f"{i % 1500} " + f"words of text {i % 1500} and no other, {i % 1500} times over; " * 3 for i in range(3000)]
    none = spark.createDataFrame([(None, t) for t in texts] + [(1, texts[0])], "doc_id bigint, text string")
    done = suffix_dedup.dedup(none)
    assert done.count() == 3001 and done.filter("doc_id = 1").first().kept == b""


def test_suffix_dedup_of_a_row_repeated_over_whole_batches(spark):
    """Rows that repeat fill a batch and leave nothing of it; the anchor's earlier neighbourhoods are not forgotten."""
    head = "abcdefghijklmnopqrstuvwxyz" * 3
    rows = [(1, head + "".join(chr(65 + i % 26) for i in range(k, 150 + k)) + "!") for k in (0, 0, 0, 0, 0, 0)] + [(2, head + "Z" * 80), (3, head + "".join(chr(65 + i % 26) for i in range(150)) + "?")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute.suffix(sorted(set(rows)))


def test_runs_grow_to_whole_characters():
    data = "aé😀éb".encode()
    assert suffix_dedup.outward([[2, 5]], data) == [[1, 7]] and suffix_dedup.outward([[0, 1], [9, 10]], data) == [[0, 1], [9, 10]]
    assert suffix_dedup.outward([[1, 4], [5, 6]], data) == [[1, 7]] and suffix_dedup.outward([], data) == []


def test_suffix_dedup_of_odd_tables(empty, odd):
    assert suffix_dedup.dedup(empty).count() == 0
    got = [(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(odd).collect()]
    a, b = len("some words that repeat " * 12), len("other words entirely, " * 9)
    assert sorted(x for x in got if x[0] == 2) == [(2, 0, 0), (2, b, b)]  # b starts earlier, in document 1
    assert [x for x in got if x[0] == 1 and x[1] == a] == [(1, a, a)] * 2  # a starts earlier, in the document without an id
    assert sorted((x[1] for x in got if x[0] is None)) == [0, a]


# --- 3 ---


def test_quality_statistics(documents, corpus):
    stats = quality_rules.statistics(documents).withColumn("failed", quality_rules.base_failed())
    assert rows(stats, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed") == {d: brute.quality(t) for d, t in corpus}


def test_rules_are_learned_and_tell_bad_from_good(spark):
    good = [(i, "plain words of a text that reads well enough. " * 2 + " ".join(f"w{i}x{j}" for j in range(60))) for i in range(120)]
    bad = [(1000 + i, " ".join(f"w{i}x{j}***" for j in range(60 + i % 7))) for i in range(60)]
    docs = spark.createDataFrame(good + bad, "doc_id bigint, text string")
    labels = spark.createDataFrame([(d, int(d < 1000), 0) for d, _ in good + bad] + [(None, 0, 0), (5, None, None), (7, 1, 1)], LABELS)
    got = rows(quality_rules.judge(docs, labels), "doc_id", "base_failed", "rule", "kept")
    assert all(got[d] == (False, 0, True) for d, _ in good)
    assert all(got[d][1] > 0 and not got[d][2] for d, _ in bad)
    assert {r.doc_id for r in quality_rules.keep(docs, labels).collect()} == {d for d, _ in good}


def test_a_refused_rule_does_not_end_the_list(spark):
    """The first feature tells bad rows from good ones in the growing part only; the list goes on to the one that holds."""
    base = {f: 0.0 for f in quality_rules.FEATURES} | {"n_words": 60.0}
    made = []
    for i in range(600):
        bad, grow = i % 3 == 0, i % 5 < 3
        made.append(base | {"digit_rate": float(i % 7) + 10 * (bad and grow), "mark_rate": float(i % 2) + 3 * (bad and i % 4 > 0), "bad": bad, "grow": grow})
    schema = "bad boolean, grow boolean, " + ", ".join(f"{f} double" for f in quality_rules.FEATURES)
    learned = quality_rules.learn(spark.createDataFrame([tuple(r[c] for c in ("bad", "grow", *quality_rules.FEATURES)) for r in made], schema))
    assert learned == brute.decision_list(made) and len(learned) == 1 and learned[0][0].feature == "mark_rate"
    holds = lambda r, rule: all(r[c.feature] > c.threshold if c.above else r[c.feature] <= c.threshold for c in rule)
    assert {r["bad"] for r in made if any(holds(r, x) for x in learned)} == {True}


def test_bound_of_a_share():
    assert quality_rules.lower_bound(0, 0) == 0 and quality_rules.lower_bound(5, 0) > 0.6 > quality_rules.lower_bound(4, 0)
    assert 0.83 < quality_rules.lower_bound(90, 10) < 0.9 > quality_rules.lower_bound(900, 100) > 0.88


def test_rules_change_what_is_kept_beyond_the_base_rule(spark):
    """Whole tables: rules are learned on what the base rule keeps, and are precise on documents that learned nothing."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    stats = quality_rules.materialize(quality_rules.statistics(docs))
    rules = quality_rules.learn(quality_rules.labelled(stats, labels))
    precision, recall = quality_rules.precision_and_recall(rules, quality_rules.labelled(stats, labels, held_out=True))
    assert rules and precision >= 0.9 and recall >= 0.9
    assert quality_rules.judged(stats, rules).filter("not base_failed and not kept").count() > 20
    assert quality_rules.precision_and_recall([], quality_rules.labelled(stats, labels.limit(0), held_out=True)) == (None, None)


def test_rules_of_odd_tables(spark, empty, odd, documents, corpus):
    none = spark.createDataFrame([], LABELS)
    assert quality_rules.judge(empty, none).count() == 0
    assert quality_rules.judge(odd, none).count() == 8
    kept = quality_rules.keep(documents, none)
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {d for d, t in corpus if not brute.quality(t)[-1]}


# --- 4 ---


def test_packing(documents, corpus):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    want = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for d, t in corpus}
    got = packing.pack(documents, path, window=256).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d, ids in want.items():
        found = sorted(pieces[d], key=lambda r: r.start)
        assert [i for r in found for i in np.frombuffer(r.ids, "<u4").tolist()] == ids
        assert [r.start for r in found] == np.cumsum([0, *(r.length for r in found)])[:-1].tolist()
        assert all(r.doc_tokens == len(ids) for r in found)
    lengths = []
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0, *(r.length for r in s)])[:-1].tolist()
        lengths.append(sum(r.length for r in s))
    assert max(lengths) <= 256
    assert sum(256 - n for n in lengths if n & (n - 1)) < 0.06 * sum(lengths) + 3 * 256
    assert len(lengths) <= 1.05 * sum(lengths) / 256 + 3  # three partitions end in a short window each


def test_plan_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 14))
        places = np.cumsum(rng.integers(1, 8, n))
        pen = rng.integers(0, 5, n)
        window, each = 9, int(rng.integers(0, 4))
        cost = {0: 0}
        for j, x in enumerate(places.tolist()):
            cost[x] = min(cost[y] + (0 if (x - y) & (x - y - 1) == 0 else window - (x - y)) + int(pen[j]) + each for y in cost if x - y <= window)
        cuts = packing.plan(places, pen, window, each)
        of = dict(zip(places.tolist(), pen.tolist()))
        spent = sum((0 if (b - a) & (b - a - 1) == 0 else window - (b - a)) + of[b] + each for a, b in zip([0, *cuts], cuts))
        assert spent == cost[int(places[-1])]


def test_packing_carries_windows_over_blocks(monkeypatch, documents, corpus):
    monkeypatch.setattr(packing, "BLOCK", 500)
    got = packing.pack(documents.coalesce(1), P.path("byte_bpe_50k.json"), window=64).collect()
    total = sum(r.length for r in got)
    assert total == sum(max(r.doc_tokens for r in got if r.doc_id == d) for d, _ in corpus)
    used = defaultdict(int)
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 64 and sum(n < 64 and n & (n - 1) > 0 for n in used.values()) * 64 < total


def test_packing_of_odd_tables(empty, odd):
    path = P.path("byte_bpe_50k.json")
    assert packing.pack(empty, path).count() == 0
    got = packing.pack(odd, path).collect()
    assert sum(r.start == 0 for r in got) == 8 and {r.doc_tokens for r in got if r.doc_id == 3} == {1}


# --- 5 ---


def test_simhash(documents, corpus):
    assert rows(simhash.near_duplicates(documents), "doc_id", "fingerprint", "component_id") == brute.components(corpus)


@pytest.mark.parametrize("crowded", [128, 2])
def test_every_link_is_found(monkeypatch, spark, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 40)]
    near = {(b ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(1, 6), replace=False))) for b in base[:12] for _ in range(25)}
    fps = list({*base, *near, 0, -1})
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint")).collect()}
    far = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    assert got == {(a, b) for a in fps for b in fps if a < b and far(a, b) <= 3}


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101)]
    got = rows(simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")), "node", "root")
    assert got == {i: (0,) for i in range(1, 61)} | {101: (100,), 102: (100,)}


def test_simhash_of_odd_tables(spark, empty, odd, documents, corpus):
    assert simhash.near_duplicates(empty).count() == 0
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 8 and {r.component_id for r in got if r.doc_id == 3} == {2}
    kept = simhash.keep_one(documents, 3)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({c for _, c in brute.components(corpus).values()})


# --- 6 ---


def test_base_scores(documents, corpus):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    path = P.path("piece_bpe_32k.model")
    want = brute.base_scores(corpus)
    for frequent in (lm_scoring.FREQUENT, 20):
        lm_scoring.FREQUENT, before = frequent, lm_scoring.FREQUENT
        try:
            got = rows(lm_scoring.score(documents, documents.filter(~held), path), "doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        finally:
            lm_scoring.FREQUENT = before
        assert {d: x[:3] for d, x in got.items()} == {d: x[1:4] for d, x in want.items()}
        assert all(abs(got[d][3] - want[d][4]) < 1e-6 for d in want)
        assert all(x[4] < 0 for x in got.values())


def test_scores_of_whole_documents(documents, corpus):
    """Piece counts of the training documents by a plain loop, then each word's recursion for one text, word by word."""
    path = P.path("piece_bpe_32k.model")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    got = rows(lm_scoring.score(documents, ~held, path), "doc_id", "score")
    train = [t for d, t in corpus if zlib.crc32(str(d).encode()) % 10]
    sp, pieces = lm_scoring.vocabulary(path), Counter()
    for t in train:
        for w in lm_scoring.tokens(t):
            pieces.update(sp.encode(w.decode()))
    lattice = lm_scoring.Lattice(path, pieces, 0, len(train))
    for d, t in corpus:
        want = lattice.end + sum(lattice.forward("▁" + w.decode()) for w in lm_scoring.tokens(t))
        assert got[d][0] == pytest.approx(want / np.log(10)), d


def test_forward_recursion_sums_all_segmentations():
    lattice = lm_scoring.Lattice(P.path("piece_bpe_32k.model"), {i: i % 7 for i in range(3, 32000)}, 0, 5)

    def every(s):
        if not s:
            return 1.0
        total = sum(np.exp(lattice.log[s[:k]]) * every(s[k:]) for k in range(1, len(s) + 1) if s[:k] in lattice.log)
        if s[0] not in lattice.single:
            total += np.exp(sum(lattice.byte[b] for b in s[0].encode())) * every(s[1:])
        return total

    for w in ("the", "thering", "一\U00010348b", "ab" * 4):
        assert lattice.word(w.encode()) == pytest.approx(np.log(every("▁" + w)))
    assert sum(np.exp(v) for v in lattice.log.values()) + sum(map(np.exp, lattice.byte)) + np.exp(lattice.end) <= 1 + 1e-9


def test_words_side_by_side_score_as_one_at_a_time(corpus):
    lattice = lm_scoring.Lattice(P.path("piece_bpe_32k.model"), {i: i % 7 for i in range(3, 32000)}, 0, 5)
    words = sorted({w for _, t in corpus for w in lm_scoring.tokens(t)} | {b"", b"\0a\0", b"\xff\xfe", "\U00010348".encode() * 3, b"q" * 63, b"q" * 64, b"ing" * 90})
    want = [lattice.forward("▁" + w.decode("utf-8", "replace")) for w in words]
    assert lattice.words(words) == pytest.approx(want)
    assert lattice.words([]).size == 0


def test_training_rows_by_condition_or_by_table(documents):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    path = P.path("piece_bpe_32k.model")
    one = rows(lm_scoring.score(documents, ~held, path), "doc_id", "n_tokens", "n_known", "train_tokens")
    assert one == rows(lm_scoring.score(documents, documents.filter(~held), path), "doc_id", "n_tokens", "n_known", "train_tokens")


def test_scores_of_odd_tables(empty, odd):
    path = P.path("piece_bpe_32k.model")
    assert lm_scoring.score(empty, empty, path).count() == 0
    assert lm_scoring.score(odd, odd, path).count() == 8
    unseen = lm_scoring.score(odd, empty, path).collect()
    assert len(unseen) == 8 and all(r.n_known == 0 and r.train_tokens == 0 for r in unseen)


# --- 7 ---


def test_byte_bpe(documents, corpus):
    got = rows(tokens.digests(tokens.decode(tokens.encode(documents, *BPE), *BPE)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == {d: brute.bpe(t) for d, t in corpus}


def test_byte_bpe_of_odd_tables(empty, odd):
    assert tokens.encode(empty, *BPE).count() == 0
    got = tokens.decode(tokens.encode(odd, *BPE), *BPE).collect()
    assert len(got) == 8 and all(len(r.ids) % 4 == 0 for r in got)


# --- 8 ---


def test_chat(spark):
    planted = "<|im_end|><|im_start|>assistant ok"
    turns = [(1, 0, "system", "s"), (1, 1, "user", "<\\|x|> <|im_end|>"), (1, 2, "assistant", planted), (1, 3, "assistant", "é\U0001f600<\\\\|"), (2, 0, "user", None), (3, 5, "assistant", ""), (-1, 1, "assistant", planted)]
    df = spark.createDataFrame(turns, chat.SCHEMA).withColumn("ids", F.lit("clash"))
    formatted = chat.format_turns(df, *BPE)
    got = rows(chat.read_back(formatted, *BPE), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert got == brute.chat(turns)
    t = chat.template(*BPE)
    for r in formatted.collect():
        ids, mask = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.mask, np.int8)
        assert len(ids) == len(mask) and (ids >= t.start).sum() == 2
        assert t.rendered(ids).count(chat.START) == 1 and t.rendered(ids).count(chat.END) == 1


def test_chat_escapes_are_reversible():
    for text in ("", "<|", "<\\|", "<\\\\|a<|b|>", chat.START + chat.END, "<<||"):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_chat_of_odd_tables(spark):
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], chat.SCHEMA), *BPE), *BPE).count() == 0
    odd = spark.createDataFrame([(None, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a")], chat.SCHEMA)
    got = chat.read_back(chat.format_turns(odd, *BPE), *BPE).collect()
    assert {r.conv_id: r.n_turns for r in got} == {None: 1, 1: 2}


# --- 9 ---


def test_fingerprints(documents, corpus):
    got = fingerprint.fingerprint_edits(documents).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == brute.edits(corpus)
    text = dict(corpus)
    prints = defaultdict(set)
    for r in got:
        prints[text[r.doc_id] or ""].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(p) == 1 for p in prints.values()) and len(prints) == len(set.union(*prints.values()))


def test_peeling_recovers_the_difference(spark):
    rng = np.random.default_rng(2)
    keys = lambda n: [int(x) | 1 for x in rng.integers(-(1 << 63), (1 << 63) - 1, n)]
    cases = [(keys(a), keys(b), keys(c)) for a, b, c in ((0, 0, 0), (5, 0, 0), (30, 2, 3), (0, 40, 1), (200, 60, 60), (1, 1, 1))]
    df = spark.createDataFrame([(sorted(s + x), sorted(s + y), sorted(x + y)) for s, x, y in cases], "a array<bigint>, b array<bigint>, d array<bigint>")
    for plain in (True, False):  # False: by peeling alone
        got = fingerprint.with_difference(df, "found", "a", "b", plain=plain).select("d", F.sort_array("found").alias("found")).collect()
        assert all(r.d == r.found for r in got)


def test_buckets_that_fail_are_peeled_from_larger_tables(spark):
    """Long documents without a common paragraph: some first tables fail, none of the larger ones does."""
    rng = np.random.default_rng(4)
    rows = [(sorted(int(x) | 1 for x in rng.integers(-(1 << 63), (1 << 63) - 1, n)), sorted(int(x) | 1 for x in rng.integers(-(1 << 63), (1 << 63) - 1, n))) for n in (200, 400, 800) for _ in range(4)]
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>")
    lev = fingerprint.level(F.greatest(F.size("a"), F.size("b")))
    first = F.transform(fingerprint.subtract(fingerprint.sketch(F.col("a"), lev), fingerprint.sketch(F.col("b"), lev)), lambda c: fingerprint.peel(c))
    got = fingerprint.with_difference(df, "d", "a", "b", plain=False).select("a", "b", "d", F.exists(first, lambda x: x.isNull()).alias("failed")).collect()
    assert any(r.failed for r in got)
    assert all(sorted(r.d) == sorted(r.a + r.b) for r in got)


def test_likeness_against_sets_of_counted_paragraphs(documents, corpus):
    got = rows(fingerprint.fingerprint_edits(documents), "doc_id", "near_edited", "near_next")
    want = brute.likenesses(corpus)
    assert all(got[d] == pytest.approx(want[d]) for d in want)


def test_next_documents_across_spans(spark):
    ids = [1, 2, 5000, 5001, 900_000, -7, -4096, -4097, (1 << 63) - 1, 1 - (1 << 63)]
    none = [-(1 << 62) + 5, -(1 << 50), -3, 0, 7, 1 << 43, (1 << 62) - 1]  # the ties of rows without an id
    order = [(i, i % 5) for i in sorted(ids, reverse=True)] + [(-(1 << 63), t) for t in none]
    df = spark.createDataFrame([(i, t, f"{i} {t}") for i, t in order], "doc bigint, tie bigint, text string")
    got = {(r.doc, r.tie): r.next.text for r in fingerprint.followed(df, ["text"]).collect()}
    assert got == {a: "%d %d" % b for a, b in zip(order, order[1:] + order[:1])}


def test_fingerprints_of_odd_tables(empty, odd):
    assert fingerprint.fingerprint_edits(empty).count() == 0
    assert fingerprint.fingerprint_edits(odd).count() == 8
    single = fingerprint.fingerprint_edits(odd.filter("doc_id = 3")).first()
    assert (single.n_chars, single.near_edited, single.near_next) == (0, 1.0, 1.0)


# --- 10 ---


def test_shapes_take_whole_words_and_the_cache_is_bounded_by_bytes(monkeypatch):
    head = b"aB1!" * 8
    assert quality_model.shape(head + b"x") != quality_model.shape(head + b"7") and quality_model.shape(b"a" * 99) == b"a"
    words = [b"%d-word" % i for i in range(2000)]
    want = [quality_model.word_features(w) for w in words]
    quality_model.forget()
    monkeypatch.setattr(quality_model, "CACHE", 20_000)
    assert [quality_model.word_features(w) for w in words] == want and [quality_model.word_features(w) for w in words] == want
    assert len(quality_model._cache) < 200 and quality_model._held <= 20_000 + 300
    quality_model.forget()
    assert not quality_model._cache and not quality_model._held


@pytest.fixture(scope="module")
def graded(spark):
    import random

    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bdkl" for b in "aeiou" for c in "nrst"]
    text = lambda n=60: [rng.choice(words) for _ in range(n)]
    out = []
    for i in range(600):
        t = text()
        if i % 5 == 0:
            t[rng.randrange(60)] = rng.choice(["vile", "rotten"])
        elif i % 5 == 1:
            t = [f"{w}***" for w in t]
        out.append((i, " ".join(t), int(i % 5 != 1), int(i % 5 == 0)))
    return out


def test_quality_model_on_held_out_documents(spark, graded):
    docs = spark.createDataFrame([g[:2] for g in graded], "doc_id bigint, text string").withColumn("kept", F.lit("clash"))
    labels = spark.createDataFrame([(g[0], g[2], g[3]) for g in graded if g[0] < 400] + [(None, 1, 1), (3, None, None)], LABELS)
    got = rows(quality_model.score(docs, labels), "doc_id", "expected_grade", "tail_probability", "kept")
    assert all(0 <= e <= 2 and 0 <= t <= 1 and k == (t >= 0.4) for e, t, k in got.values())
    held = [g for g in graded if g[0] >= 400]
    right = np.mean([got[d][2] == (q == 1 and x == 0) for d, _, q, x in held])
    assert right > 0.95
    kept = quality_model.keep(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, x in got.items() if x[2]}


def test_likelihood_and_gradient(monkeypatch):
    """Against plain loops and finite differences."""
    rng = np.random.default_rng(6)
    n, width = 30, 12
    lists = [np.unique(rng.integers(0, width, 5)) for _ in range(n)]
    at, doc = np.concatenate(lists), np.repeat(np.arange(n), [len(x) for x in lists])
    grades, weight = rng.integers(0, 3, n), rng.random(n)
    w, theta = rng.normal(size=width), np.array([-0.4, 0.9])

    def loss(w, theta):
        total = quality_model.L2 / 2 * sum(x * x for x in w)
        for i in range(n):
            z = sum(w[k] for k in lists[i])
            upto = [0.0, *(1 / (1 + np.exp(z - t)) for t in theta), 1.0]
            total -= weight[i] * np.log(upto[grades[i] + 1] - upto[grades[i]])
        return total

    value, g_w, g_theta = quality_model.likelihood(w, theta, at, doc, grades, weight)
    assert value == pytest.approx(loss(w, theta))
    step = lambda x, k: x + 1e-6 * (np.arange(len(x)) == k)
    assert g_w == pytest.approx([(loss(step(w, k), theta) - loss(w, theta)) / 1e-6 for k in range(width)], abs=1e-4)
    assert g_theta == pytest.approx([(loss(w, step(theta, k)) - loss(w, theta)) / 1e-6 for k in range(2)], abs=1e-4)


def test_quality_scores_against_a_plain_loop(spark, graded):
    docs = spark.createDataFrame([g[:2] for g in graded], "doc_id bigint, text string")
    labels = spark.createDataFrame([(g[0], g[2], g[3]) for g in graded], LABELS)
    m = quality_model.trained(docs, labels).value
    got = rows(quality_model.score(docs, labels), "doc_id", "expected_grade", "tail_probability")
    for d, t, _, _ in graded[:100]:
        z = sum(float(m.weights[k]) for k in set(quality_model.features(t).tolist()))
        above = [1 / (1 + np.exp(x - z)) for x in m.thresholds]
        assert got[d] == pytest.approx((sum(above), above[-1]), abs=1e-5)
    assert list(m.thresholds) == sorted(m.thresholds)


def test_the_sample_is_bounded_in_rows_and_whole_in_features(spark):
    """One label for a thousand rows sends one of them; a long text sends all its features."""
    long = " ".join(f"w{i}" for i in range(9000))
    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(1000)] + [(2, long), (3, "a"), (3, "b")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (9, 1, 1)], LABELS)
    found, grades = quality_model.sample(docs, labels, 5)
    assert len(found) == 3 and sorted(grades.tolist()) == [0, 1, 2]
    assert max(map(len, found)) == len(quality_model.features(long)) > 8000
    assert len(quality_model.sample(docs, labels, 2)[0]) <= 2


def test_quality_model_of_odd_tables(spark, empty, odd):
    none = spark.createDataFrame([], LABELS)
    assert quality_model.score(empty, none).count() == 0
    got = quality_model.score(odd, none).collect()
    assert len(got) == 8 and all(abs(r.expected_grade - 1) < 1e-6 for r in got)


def test_chat_query_against_its_sql(spark):
    import duckdb

    from tracewell.llm import queries

    con = duckdb.connect()
    con.sql("create view conversations as select * from '/root/testdata/sf0.001/conversations.parquet'")
    want = con.sql(queries.ORACLE_SQL["op8_chat"])
    names = want.columns
    got = queries.op8_chat(spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want.fetchall())


def test_bins_are_counted_without_more_rows(spark):
    """op3 in round 3: a row was made into eight for each count."""
    rows = spark.createDataFrame([(i % 3 == 0, *([i % 2] * 8)) for i in range(12)], "bad boolean, " + ", ".join(f"bin{i} int" for i in range(8)))
    assert quality_rules.counted(rows) == {(i, b): (2, 4) for i in range(8) for b in (0, 1)}


def test_rules_grow_side_by_side(spark):
    """op3 in round 3: every condition of every refused rule was a query of eight shuffles, more than the driver's memory held."""
    rng = random.Random(11)
    schema = "bad boolean, grow boolean, " + ", ".join(f"{f} double" for f in quality_rules.FEATURES)

    def learned(made, group):
        spark.sparkContext.setJobGroup(group, group)
        try:
            rows = spark.createDataFrame([tuple(r[c] for c in ("bad", "grow", *quality_rules.FEATURES)) for r in made], schema)
            return quality_rules.learn(rows), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            for name in ("spark.jobGroup.id", "spark.job.description"):
                spark.sparkContext.setLocalProperty(name, None)

    made = [{f: float(rng.randrange(20)) for f in quality_rules.FEATURES} | {"bad": rng.random() < 0.3, "grow": rng.random() < 0.75} for _ in range(1500)]
    rules, jobs = learned(made, "refused")
    assert rules == brute.decision_list(made) == [] and jobs <= 20
    for r in made:  # two rules hold, after others that hold in the growing part only
        r["bad"] = r["symbol_rate"] > 17 or (r["mark_rate"] < 2 and r["n_words"] > 9) or (r["grow"] and r["digit_rate"] > 15 and rng.random() < 0.97)
    rules, jobs = learned(made, "taken")
    assert rules == brute.decision_list(made) and len(rules) >= 2 and jobs <= 20 * (len(rules) + 1)
