"""SimHash near-duplicates by pigeonring filtering.

Two 64-bit fingerprints link if at most three bits differ.  Laid on a ring of
sixteen 4-bit segments, the pigeonring principle says of such a pair that from
some segment on every chain of l consecutive segments differs in at most
3 * l / 16 bits: none in five segments, one in ten, two in fifteen.  So one of
sixteen starts has five equal segments, and of the next five one half is equal:
thirty-two keys of 30 bits find every link.  Pairs that share a key must then
keep the chain budgets before the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.common import discard, map_batches, materialize, met, scratch

BITS, SEGMENTS, DISTANCE = 64, 16, 3
#: A key that more distinct fingerprints share is cut into four finer keys, as often as needed.
CROWDED = 128


def fingerprint(text: str | None, width: int, seed: int) -> int:
    """The SimHash of a text's word shingles, as a signed 64-bit integer.

    A-Z are lower-cased; fewer than ``width`` words are one shingle; no word
    (or a null text) gives zero.  A bit is 1 if set in over half the hashes.
    """
    return fingerprint_of((text or "").encode("utf-8", "replace"), width, seed)


def fingerprint_of(text: bytes, width: int, seed: int) -> int:
    import xxhash

    w = text.lower().split()
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(width)))) if len(w) >= width else [b" ".join(w)]
    hashed = np.array([xxhash.xxh64_intdigest(g, seed) for g in grams], dtype=">u8")
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashed), 1 << 16):  # a very long text in bounded memory
        block = hashed[at : at + (1 << 16)]
        total += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashed)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id bigint, fp bigint`` a row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [fingerprint(t, width, seed) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(made, pa.int64())], ["doc_id", "fp"])

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return map_batches(picked, run, "doc_id bigint, fp bigint")


def ring(first: int, last: int) -> int:
    """Mask of the ring's bits from ``first`` up to ``last``, as a signed 64-bit integer."""
    m = sum(1 << (b % BITS) for b in range(first, last))
    return m - (1 << BITS) if m >> (BITS - 1) else m


def split(mask: int, parts: int) -> list[int]:
    """Masks that each add one of ``parts`` runs of the bits that ``mask`` leaves out."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        m = (mask & (1 << BITS) - 1) | sum(1 << x for x in free[a:b])
        out.append(m - (1 << BITS) if m >> (BITS - 1) else m)
    return out


def probes() -> list[tuple[int, int, int]]:
    """(key mask, ten-segment chain, fifteen-segment chain) of the thirty-two keys."""
    s = BITS // SEGMENTS
    out = []
    for i in range(SEGMENTS):
        a, mid, end = i * s, i * s + 5 * s, i * s + 10 * s
        for lo, hi in ((mid, mid + 5 * s // 2), (mid + 5 * s // 2, end)):
            out.append((ring(a, mid) | ring(lo, hi), ring(a, end), ring(a, a + 15 * s)))
    return out


def links(prints: DataFrame) -> DataFrame:
    """``a, b`` (a < b): every pair of distinct fingerprints at most three bits apart.

    ``prints`` has distinct ``fp``.  Keys that ``CROWDED`` or more share are
    refined by the pigeonhole principle (of four runs of the other bits one is
    equal), so no pair is lost and no key stays crowded for good.
    """

    def shared(keyed: DataFrame) -> DataFrame:
        sized = keyed.withColumn("n", F.count("*").over(W.partitionBy("mask", "key")))
        return materialize(sized.filter("n > 1"))

    def joined(keyed: DataFrame) -> DataFrame:
        a, b = keyed.alias("a"), keyed.alias("b")
        x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
        chain = (F.bit_count(x.bitwiseAND(F.col("a.ten"))) <= 1) & (F.bit_count(x.bitwiseAND(F.col("a.fifteen"))) <= 2)
        same = (F.col("a.mask") == F.col("b.mask")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.probe") == F.col("b.probe"))
        near = a.join(b, same & (F.col("a.fp") < F.col("b.fp")) & chain & (F.bit_count(x) <= DISTANCE))
        return near.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    def lit_rows(rows, names) -> Column:
        return F.array(*(F.struct(*(F.lit(v).cast("bigint").alias(n) for v, n in zip(r, names))) for r in rows))

    names = ("probe", "mask", "ten", "fifteen")
    base = [(i, *p) for i, p in enumerate(probes())]
    spread = prints.select("fp", F.inline(lit_rows(base, names)))
    keyed = shared(spread.withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))).drop("n"))
    masks = {i: [m] for i, m, _, _ in base}
    found = None
    for _ in range(4):
        found = (f := joined(keyed.filter(F.col("n") <= CROWDED))) if found is None else found.union(joined(keyed.filter(F.col("n") <= CROWDED)))
        crowded = keyed.filter(F.col("n") > CROWDED)
        if crowded.isEmpty():
            return found.distinct()
        children = [(i, m, c) for i, ms in masks.items() for m in ms for c in split(m, 4)]
        masks = {i: [c for j, _, c in children if j == i] for i in masks}
        finer = F.inline(lit_rows([(i, m, c) for i, m, c in children], ("p", "m", "c")))
        cut = crowded.drop("n", "key").select("*", finer).filter("p = probe and m = mask")
        cut = cut.select("fp", "probe", F.col("c").alias("mask"), "ten", "fifteen")
        keyed = shared(cut.withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))))
    return found.union(joined(keyed)).distinct()  # by now few bits are left free, which bounds a key's size


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable, for every node of ``edges(a, b)``.

    Large-star and small-star steps in turn, each a grouped minimum and a join,
    until the edges no longer change; every step is written to the shared folder.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, materialize(hung.union(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
        discard(old)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` a row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` that links reach, the row's own
    included; empty and null texts have fingerprint zero, which links like any
    other; rows may repeat, and a null id is passed over unless a component has
    no other.  Equal fingerprints are one node, so a group of copies of any
    size is as cheap as one document.  Columns besides the two are ignored.
    """
    with scratch(docs.sparkSession) as keep:
        rows = materialize(fingerprints(docs, width, seed, id_col, text_col))
        found = placed(rows, grouped(rows, links))
        return keep(found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def grouped(rows: DataFrame, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``fp, of, component_id`` of every ``fp`` of ``rows``: how many rows have it, and the smallest ``doc_id`` that ``link`` reaches."""
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("of")))
    roots = components(link(prints.select("fp")))
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(lowest, "root").select("fp", "of", "component_id")


def placed(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows(fp, ...)`` with their ``component_id``; the rows of a large group of copies stay where they are."""
    groups = materialize(groups.withColumnRenamed("fp", "hub"))
    return met(rows.withColumnRenamed("fp", "hub"), groups, rows.count()).withColumnRenamed("hub", "fp")


def keep_one(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest id, with all its columns.

    Rows without an id stay, as nothing tells them apart; of rows that share
    the id that stays, one does.
    """
    found = near_duplicates(docs, width, id_col=id_col, text_col=text_col)
    first = found.filter("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(first, id_col, "left_semi").dropDuplicates([id_col]).union(docs.filter(F.col(id_col).isNull()))
