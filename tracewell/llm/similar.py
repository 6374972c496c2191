"""Texts whose word shingles have a Jaccard similarity of 0.8 or more, all of them.

Fingerprints of 64 bits cannot find these: at 0.8 some ten bits differ, and no
key that bears so many is selective.  Instead each set of shingles is put in
one order, frequent shingles last.  Sets x and y with |y| <= |x| and similarity
of 0.8 then share one of the first |x| / 5 + 1 shingles of x and the first
|y| / 9 + 1 of y, and from the first shared one on both must be long enough for
the overlap that 0.8 asks (prefix, size and position filter).  The parities of
a set's hashes in ``SLOTS`` slots differ between two sets in no more slots than
the sets have different elements, of which 0.8 allows a ninth of both sizes
(parity filter).  Every candidate is compared exactly, so the order bears on
the cost alone and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm import simhash
from tracewell.llm.common import discard, map_batches, materialize, met, scratch

#: A key with more sets than this compares them with ``PIVOTS`` of them first, then what these leave apart.
CROWDED, PIVOTS = 8, 3
#: Frequent shingles that are ordered last; those beyond it count as rare, which costs time only.
FREQUENT = 100_000
#: Shingles whose counts a task sums up at a time; those that it counts once are left out.
COUNTED = 1 << 21
#: Slots of the parity filter, 64 a column.
SLOTS = 1024
PARITIES = [f"p{i}" for i in range(SLOTS // 64)]
#: log2 of the bits of the filter that keeps most texts that no pair names out of the shuffle.
FILTER_BITS = 22

_ODD, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def shingles(text: bytes, width: int, seed: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles, from its words' hashes; words as in ``simhash.fingerprint``."""
    import xxhash

    w = text.lower().split()
    if not w:
        return np.array([], "<i8")
    h = np.fromiter(map(xxhash.xxh64_intdigest, w, repeat(seed)), np.uint64, len(w))
    width = min(width, len(w))
    n = len(w) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + n]) * _ODD
        out ^= out >> _SHIFT
    out = np.sort(out.view("<i8"))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def signed_hash(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) - (1 << 63)


def encoded(texts: pa.Array) -> list[bytes]:
    return [(t.as_py() or "").encode("utf-8", "replace") for t in texts]


def parities(h: np.ndarray) -> np.ndarray:
    """Whether each of ``SLOTS`` slots has an odd number of the hashes, 64 slots a long."""
    return np.packbits((np.bincount(h & (SLOTS - 1), minlength=SLOTS) & 1).astype(np.uint8)).view("<i8")


def apart(x: str, y: str) -> Column:
    """Whether two rows' parities and sizes show that their similarity is below 0.8."""
    differ = sum((F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in PARITIES), F.lit(0))
    return differ * 9 > F.col(f"{x}.n") + F.col(f"{y}.n")


READ = "doc_id bigint, fp bigint, text bigint, n bigint, print bigint, key bigint, " + ", ".join(f"{p} bigint" for p in PARITIES)


def reader(width: int, seed: int):
    """What ``Sets`` makes of the texts at first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, and rows with the counts of shingles that several sets hold."""
        names = [c.split()[0] for c in READ.split(", ")]
        held, size = {}, 0

        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(list(held.values())), return_counts=True)
            h, n = h[n > 1], n[n > 1]
            none = pa.nulls(len(h), pa.int64())
            return pa.record_batch([none, none, none, pa.array(n.astype("<i8")), none, pa.array(h), *[none] * len(PARITIES)], names)

        for b in batches:
            rows = []
            for t in encoded(b.column(1)):
                h = shingles(t, width, seed)
                name = signed_hash(h.tobytes())
                rows.append((name, signed_hash(t), len(h), simhash.fingerprint_of(t, width, seed), *parities(h).tolist()))
                if name not in held:
                    held[name] = h
                    size += len(h)
                if size >= COUNTED:
                    yield counted()
                    held, size = {}, 0
            if rows:
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.record_batch([b.column(0), *columns[:4], pa.nulls(len(rows), pa.int64()), *columns[4:]], names)
        if held:
            yield counted()

    return run


class Sets:
    """The shingle sets of a table's texts; they are made again where they are needed, which costs less disk than to keep them."""

    def __init__(self, docs: DataFrame, width: int, seed: int, id_col: str = "doc_id", text_col: str = "text"):
        self.docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
        self.width, self.seed = width, seed
        seen = materialize(map_batches(self.docs, reader(width, seed), READ))
        #: A row for each text: hashes that name its set and the text, the set's size, SimHash fingerprint and parities.
        self.names = seen.filter("fp is not null").drop("key")
        self.counts = seen.filter("key is not null").select("key", "n")

    def marks(self, wanted: DataFrame) -> DataFrame:
        """``fp, n`` and parities of the sets that ``wanted(fp)`` names."""
        return self.names.join(wanted, "fp", "left_semi").select("fp", "n", *PARITIES).dropDuplicates(["fp"])

    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """The ``FREQUENT`` shingles that most sets hold, sorted, and about how many."""
        counts = self.counts.groupBy("key").agg(F.sum("n").alias("n"))
        top = counts.filter(F.col("n") > CROWDED).orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
        h, n = (top.column(c).to_numpy() for c in ("key", "n"))
        order = np.argsort(h)
        return h[order], n[order]

    def prefixes(self) -> DataFrame:
        """``key, fp, n, pos``: the first shingles of every set of ``n``, with their places from 0."""
        often, times = self.frequent()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out, seen = [], set()
                for t in encoded(b.column(0)):
                    h = shingles(t, width, seed)
                    name = signed_hash(h.tobytes())
                    if len(h) and name not in seen:
                        seen.add(name)
                        at = np.minimum(np.searchsorted(often, h), max(0, len(often) - 1))
                        weight = np.where(often[at] == h, times[at], 0) if len(often) else np.zeros(len(h), "<i8")
                        first = h[np.argsort(weight, kind="stable")][: len(h) - (4 * len(h) + 4) // 5 + 1]
                        out.append(np.stack([first, np.full(len(first), name), np.full(len(first), len(h)), np.arange(len(first))]))
                if out:
                    yield pa.record_batch([pa.array(c) for c in np.concatenate(out, axis=1)], ["key", "fp", "n", "pos"])

        width, seed = self.width, self.seed
        made = map_batches(self.docs.select("t"), run, "key bigint, fp bigint, n bigint, pos bigint")
        return made.repartition("key").groupBy("key", "fp").agg(F.first("n").alias("n"), F.first("pos").alias("pos"))

    def texts(self, wanted: DataFrame) -> DataFrame:
        """``fp, t``: one text of each set that ``wanted(fp)`` names.

        A filter of 2**FILTER_BITS bits, whatever the size of ``wanted``,
        leaves most other texts where they are; the join decides.
        """
        one = materialize(self.names.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("text").alias("text")))
        slot = F.col("text").bitwiseAND(F.lit((1 << FILTER_BITS) - 1).cast("long"))
        bits = one.select((slot % 64).cast("int").alias("bit"), F.shiftright(slot, 6).alias("at"))
        masks = bits.groupBy("at").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("mask")).toArrow()
        table = np.zeros(1 << FILTER_BITS - 6, "<i8")
        table[masks.column("at").to_numpy()] = masks.column("mask").to_numpy()
        shared = wanted.sparkSession.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            on = shared.value.view("<u8")
            for b in batches:
                name = np.array([signed_hash(t) for t in encoded(b.column(0))], np.int64)
                at = name & (1 << FILTER_BITS) - 1
                hit = pa.array((on[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1)
                yield pa.record_batch([pa.array(name).filter(hit), b.column(0).filter(hit)], ["text", "t"])

        found = map_batches(self.docs.select("t"), run, "text bigint, t string")
        return found.join(one, "text").groupBy("fp").agg(F.first("t").alias("t"))

    def alike(self, pairs: DataFrame) -> DataFrame:
        """``a, b`` of the ``pairs`` whose sets have a similarity of 0.8 or more, by comparing them whole."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, y = None, None
            for b in batches:
                keep = []
                for name, s, t in zip(b.column(1).to_pylist(), b.column(2), b.column(3)):
                    if name != last:  # rows come by b
                        last, y = name, shingles((t.as_py() or "").encode("utf-8", "replace"), width, seed)
                    x = shingles((s.as_py() or "").encode("utf-8", "replace"), width, seed)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(9 * both >= 4 * (len(x) + len(y)))
                yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        width, seed = self.width, self.seed
        found = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        both = lambda df: df.select(F.col("a").alias("fp")).union(df.select("b")).distinct()
        marks = materialize(self.marks(both(found)))
        near = found.join(marks.alias("x"), F.col("a") == F.col("x.fp")).join(marks.alias("y"), F.col("b") == F.col("y.fp")).filter(~apart("x", "y"))
        pairs = materialize(near.select("a", "b"))
        held = materialize(self.texts(both(pairs)))
        of = lambda c: held.select(F.col("fp").alias(c), F.col("t").alias(f"of_{c}"))
        whole = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "of_a", "of_b")
        out = materialize(map_batches(whole, run, "a bigint, b bigint"))
        discard(found, marks, pairs, held)
        return out


def printed(sets: Sets) -> DataFrame:
    """``a, b``: sets whose SimHash fingerprints reach each other at three bits or fewer, of a similarity of 0.8 or more.

    A component of fingerprints has one of its sets as a hub, and each of the
    others is compared with it; ``links`` finds what this leaves apart.
    """
    named = materialize(sets.names.select("print", "fp").distinct())
    roots = simhash.components(simhash.links(named.select(F.col("print").alias("fp")).distinct())).withColumnRenamed("node", "print")
    rooted = materialize(named.join(roots, "print", "left").select("fp", F.coalesce("root", "print").alias("hub")))
    hubs = rooted.groupBy("hub").agg(F.min("fp").alias("b"), F.count("*").alias("of"))
    out = sets.alike(met(rooted, hubs, rooted.count()).filter("fp != b").select(F.col("fp").alias("a"), "b"))
    discard(named, rooted)
    return out


def links(sets: Sets) -> DataFrame:
    """``a, b``: pairs of sets at 0.8 or more, enough of them to connect what all such pairs connect."""
    short = F.col("pos") * 9 <= F.col("n")
    by = W.partitionBy("key")
    sized = sets.prefixes().withColumns({"size": F.count("*").over(by), "shorts": F.count_if(short).over(by)})
    keyed = materialize(sized.filter("size > 1 and shorts > 0"))

    def joined(keyed: DataFrame, more: Column) -> DataFrame:
        x, y = keyed.alias("x"), keyed.filter(short).alias("y")
        overlap = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) * 9 >= (F.col("x.n") + F.col("y.n")) * 4
        order = (F.col("y.n") < F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.fp") != F.col("x.fp")))
        return x.join(y, (F.col("x.key") == F.col("y.key")) & order & overlap & more).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))

    near = printed(sets)
    known = materialize(simhash.components(near).withColumnRenamed("node", "fp"))
    root = lambda c: known.select(F.col("fp").alias(c), F.col("root").alias(f"{c}_root"))

    def apart_still(pairs: DataFrame) -> DataFrame:
        """The pairs that the fingerprints have not brought together."""
        both = pairs.distinct().join(root("a"), "a", "left").join(root("b"), "b", "left")
        return both.filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")

    some = joined(keyed.filter(F.col("size") <= CROWDED), F.lit(True))
    crowd = keyed.filter(F.col("size") > CROWDED)
    if crowd.isEmpty():
        out = near.union(sets.alike(apart_still(some)))
        discard(keyed)
        return out
    ranked = crowd.filter(short).withColumn("nth", F.row_number().over(by.orderBy(F.xxhash64("fp"))))
    pivots = ranked.filter(F.col("nth") <= PIVOTS).select("key", F.col("fp").alias("b"), F.col("n").alias("m"))
    sizes = (F.col("n") * 5 >= F.col("m") * 4) & (F.col("m") * 5 >= F.col("n") * 4) & (F.col("fp") != F.col("b"))
    first = near.union(sets.alike(apart_still(some.union(crowd.join(pivots, "key").filter(sizes).select(F.col("fp").alias("a"), "b")))))
    roots = simhash.components(first).withColumnRenamed("node", "fp")
    rooted = crowd.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    open_ = materialize(rooted.withColumns({"low": F.min("root").over(by), "high": F.max("root").over(by)}).filter("low != high"))
    marked = materialize(open_.drop("low", "high").join(sets.marks(open_.select("fp").distinct()).drop("n"), "fp"))
    rest = sets.alike(joined(marked, (F.col("x.root") != F.col("y.root")) & ~apart("x", "y")))
    discard(keyed, open_, marked)
    return first.union(rest)


def keep_one(docs: DataFrame, width: int = 5, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of similar texts, that of the smallest id, with all its columns; else as ``simhash.keep_one``."""
    with scratch(docs.sparkSession) as keep:
        sets = Sets(docs, width, seed, id_col, text_col)
        of = simhash.grouped(sets.names, lambda _: links(sets))
        found = simhash.placed(sets.names.select("doc_id", "fp"), of)
        first = keep(found.filter("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct())
    return docs.join(first, id_col, "left_semi").dropDuplicates([id_col]).union(docs.filter(F.col(id_col).isNull()))
