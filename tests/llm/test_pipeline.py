"""Stages of the corpus pipeline against brute force on what their predecessor kept."""

import random

import pytest

import corpus_pipeline as C
from tests.llm import brute
from tracewell.llm import similar, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    for name, stage in C.STAGES[:-1]:
        before = text(docs)
        docs = C.materialize(stage(spark, docs, SF))
        after = dict(text(docs))
        assert docs.columns == C.COLUMNS and set(after) <= {d for d, _ in before}, name
        if name == "quality_rules":
            assert not any(brute.quality(t)[-1] for t in after.values())
        if name == "suffix_array_dedup":
            want = brute.suffix(before)
            got = {d: t.encode() for d, t in after.items()}
            assert all(len(got[d]) <= n - r for d, (n, r, _, _) in want.items())
            same = sum(brute.sha(got[d]) == want[d][3] for d in got)
            assert same >= 0.97 * len(got)  # the others lost a character that a cut split
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert not any(d in labels and labels[d].quality == 0 for d in after)
    packed = C.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == len(after)


def test_run(spark):
    assert C.run(spark, SF).count() > 0


def test_stages_of_odd_tables(spark, empty, odd):
    """Empty tables, null ids and texts, repeated rows, columns that the table does not have."""
    from pyspark.sql import functions as F

    for name, stage in C.STAGES[:-1]:
        assert stage(spark, empty, SF).count() == 0, name
        got = stage(spark, odd.withColumns({"fp": F.lit("x"), "kept": F.lit(1), "n": F.lit(2)}), SF)
        assert got.columns == C.COLUMNS and {r.doc_id for r in got.collect()} <= {None, 1, 2, 3}, name
    assert C.STAGES[-1][1](spark, empty, SF).count() == 0
    assert C.STAGES[-1][1](spark, odd.withColumn("ids", F.lit(0)), SF).filter("start = 0").count() == 8
    near = [(r.doc_id, r.text) for r in C.near_dedup(spark, odd, SF).collect()]
    assert sum(d is None for d, _ in near) == 2  # rows without an id all stay


def test_very_long_texts(spark):
    """Half a million characters in one document, beside a near copy and a short one, through every stage."""
    import random

    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bdklmnprst" for b in "aeiou" for c in "lmnrst"]
    long = " ".join(rng.choice(words) + (rng.choice([".", ",", ""]) if i % 9 == 0 else "") for i in range(120_000))
    docs = spark.createDataFrame([(1, long, "en", "s", len(long)), (2, long[:-30], "en", "s", len(long) - 30), (3, long[1000:3000], "en", "s", 2000)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    near = C.near_dedup(spark, docs, SF)
    assert sorted(r.doc_id for r in near.collect()) == [1, 3]
    cut = {r.doc_id: r for r in C.passages(spark, near, SF).collect()}
    assert cut[1].text == long and cut[3].text == "" and cut[3].n_chars == 0
    assert C.rules(spark, docs, SF).count() <= 3 and C.classify(spark, docs, SF).count() <= 3
    pieces = C.pack(spark, docs, SF).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(pieces) == 3 and all(r["sum(length)"] == r["max(doc_tokens)"] for r in pieces)


def test_passages_cut_no_character(spark):
    """Repeats that begin or end within a character, and a replacement character that was there before."""
    rng = random.Random(4)
    passage = "".join(chr(rng.randrange(97, 123)) for _ in range(150))
    texts = [f"first À{passage}À end", f"second Ā{passage}Á tail \ufffd", f"third Ā{passage}Ā😀", passage, f"😀{passage}", f"😁{passage}"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r for r in C.passages(spark, docs, SF).collect()}
    assert [got[i].text for i in range(6)] == [texts[0], "second  tail \ufffd", "thirĀ😀", "", "", "😁"]
    assert all(r.n_chars == len(r.text) for r in got.values())


@pytest.mark.parametrize("crowded", [8, 2])
def test_near_dedup_finds_all_pairs_of_similar_texts(monkeypatch, spark, crowded):
    """Against brute force over all pairs: a recall of 1, and nothing below 0.8 linked."""
    monkeypatch.setattr(similar, "CROWDED", crowded)
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(300))
    shared = [word() for _ in range(60)]
    texts = ["", " ", "one", "One", "one two", None]
    for g in range(12):
        base = (shared if g % 3 == 0 else []) + [word() for _ in range(rng.choice([8, 60, 200]))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randrange(9)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy[: len(copy) - rng.randrange(3)]))
    rng.shuffle(texts)
    sets = [brute.shingles(t, 5) for t in texts]
    root = list(range(len(texts)))
    alike = [(j, i) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for j, i in alike:
        low, high = sorted((root[i], root[j]))
        root = [low if r == high else r for r in root]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    kept = C.near_dedup(spark, docs, SF)
    assert kept.columns == C.COLUMNS
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))
    far = [p for p in alike if (simhash.fingerprint(texts[p[0]], 5, 42) ^ simhash.fingerprint(texts[p[1]], 5, 42)).bit_count() > simhash.DISTANCE]
    assert len(far) > 10  # pairs that the fingerprints alone would miss


def test_near_dedup_links_by_fingerprints(spark):
    """F6 of round 3: the stage did without SimHash; fingerprints link what they reach, if the sets are alike, and only the rest is looked for by shingles."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(base), " ".join([*base[:-1], "x"]), " ".join([*base, "y"]), "one two", "three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    prints = [simhash.fingerprint(t, 5, 42) for t in texts]
    sets = similar.Sets(docs, 5, 42)
    name = {r.doc_id: r.fp for r in sets.names.collect()}
    assert {r.doc_id: r.print for r in sets.names.collect()} == dict(enumerate(prints))
    assert all((prints[0] ^ p).bit_count() <= simhash.DISTANCE for p in prints[1:3])
    got = {frozenset((r.a, r.b)) for r in similar.printed(sets).collect()}
    assert len(got) == 2 and set().union(*got) == {name[i] for i in range(3)}
