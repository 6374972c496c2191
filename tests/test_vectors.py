"""Vector preparation: retries, failures that stay where they are, rows that change meanwhile."""

import math
from pathlib import Path

from pyspark.sql import functions as F

from tracewell.operators import vectors

WANTED = "id long, user_id string, checksum string, text string"
CACHE = "id long, checksum string, vector array<float>"


def wanted(spark, n=300):
    return spark.createDataFrame([(i, "u", f"c{i}", f"text {i}") for i in range(n)], WANTED).coalesce(1)


def test_batches_retries_and_failures(spark, tmp_path):
    calls = str(tmp_path)

    def embed(texts):
        name = Path(calls) / f"{texts[0].split()[1]}"
        with open(name, "a") as f:
            f.write(f"{len(texts)}\n")
        if "text 70" in texts:  # this call always fails
            raise OSError("down")
        if "text 140" in texts and len(open(name).readlines()) < 2:  # this one at first
            raise OSError("busy")
        return [[3.0, 4.0] if t != "text 5" else [1.0] for t in texts]

    cache = spark.createDataFrame([(299, "c299", [1.0, 0.0]), (298, "old", [1.0, 0.0])], CACHE)
    rows = wanted(spark)
    moved = rows.filter("id != 11").withColumn("checksum", F.when(F.col("id") == 10, "other").otherwise(F.col("checksum")))
    after, outcomes = vectors.prepared(rows, lambda: moved, cache, embed, 2, batch=64, tries=3)
    told = {r.id: r.outcome for r in outcomes.collect()}
    held = {r.id: r for r in after.collect()}
    failed = {i for i, o in told.items() if o == "model_failed: OSError"}
    assert 70 in failed and len(failed) <= 64  # one call's texts, whichever they were
    want = {299: "cached", 298: "written", 5: "dimensions_invalid", 10: "changed", 11: "changed"}
    assert len(told) == 300 and all(told[i] == o for i, o in want.items() if i not in failed | {10, 11}) and told[10] == told[11] == "changed"
    assert {o for i, o in told.items() if i not in failed | set(want)} == {"written"}
    assert set(held) - {298} == {i for i, o in told.items() if o in ("cached", "written")} - {298}
    assert all(math.isclose(held[i].vector[0], 0.6, rel_tol=1e-6) for i in held if i < 298) and held[298].checksum == ("old" if 298 in failed else "c298") and held[299].vector == [1.0, 0.0]
    sizes = [[int(x) for x in p.read_text().split()] for p in Path(calls).iterdir()]
    assert max(max(s) for s in sizes) <= 64 and max(len(s) for s in sizes) == 3 and 2 <= sum(len(s) - 1 for s in sizes) <= 3
    again, second = vectors.prepared(rows.filter(F.col("id").isin([i for i in held if i < 298])), lambda: moved, after, embed, 2)
    assert {r.outcome for r in second.collect()} == {"cached"} and again.count() == after.count()


def test_wrong_counts_and_nothing_to_do(spark):
    cache = spark.createDataFrame([], CACHE)
    after, outcomes = vectors.prepared(wanted(spark, 3), lambda: wanted(spark, 3), cache, lambda texts: [], 2)
    assert after.count() == 0 and {r.outcome for r in outcomes.collect()} == {"vector_count_invalid"}
    after, outcomes = vectors.prepared(wanted(spark, 0), lambda: wanted(spark, 0), cache, lambda texts: [], 2)
    assert after.count() == outcomes.count() == 0
    for bad in ([0.0, 0.0], [math.nan, 1.0], [math.inf, 1.0]):
        _, outcomes = vectors.prepared(wanted(spark, 1), lambda: wanted(spark, 1), cache, lambda texts, bad=bad: [bad], 2)
        assert outcomes.first().outcome == "vector_invalid"
