"""Removal of byte strings of threshold length that occur earlier in the corpus.

Prefix doubling names the strings of 1, 2, 4 ... bytes at every position: the
name at length 2h is that of the pair (name at i, name at i + h), and 64-byte
hashes serve as names, so equal strings have equal names in every document and
no position has to be shipped to be named.  Spark sorts and reranks only
samples: of the 32-byte names in each threshold-long window the least one is
its anchor, and equal windows have equal anchors.  Anchors that are unique drop
out.  Of those that are not, the names of whole neighbourhoods (all windows
that share the anchor) are sorted; later copies of a neighbourhood are repeats
as they stand, and where an anchor has several neighbourhoods their windows are
extended to the threshold and sorted in turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import map_batches, materialize

#: Length of the sampled names; of the threshold, the least this code takes is 64.
SAMPLE = 32
#: Bytes of text named at a time (a longer document goes by itself).
CHUNK = 1 << 18
#: An anchor with more neighbourhoods than this has its windows dealt out by Spark one by one.
CROWDED = 20_000
#: What stands for a null id.
LOWEST = -(1 << 63)

# Fixed odd multipliers, one for each doubling.
_MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_POS_BITS = 31


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def doubled(data: np.ndarray, upto: int) -> dict[int, np.ndarray]:
    """Names of all strings of 1, 2, 4 ... ``upto`` bytes, by start."""
    h, n, level, out = _mix((data.astype(np.uint64) + np.uint64(1)) * _MULTIPLIERS[0]), 1, 1, {}
    out[1] = h
    while n < upto and len(h) > n:
        h = _mix(h[:-n] * _MULTIPLIERS[level] + h[n:])
        n, level = 2 * n, level + 1
        out[n] = h
    return out


def window_names(data: np.ndarray, length: int, names: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """Names of all strings of ``length`` bytes, from the pair of overlapping halves below it."""
    half = 1 << (length - 1).bit_length() - 1
    names = names or doubled(data, half)
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return _mix(names[half][:n] * _MULTIPLIERS[7] + names[half][length - half : length - half + n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = 1
    while 2 * n <= w:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (w - n)], x[w - n :]) if w > n else x


def anchors(data: np.ndarray, owner: np.ndarray, length: int):
    """Anchors of all windows within one owner: position, first window, count, name, neighbourhood's name."""
    names = doubled(data, 1 << (length - 1).bit_length() - 1)
    h = names[SAMPLE]
    low = np.uint64((1 << _POS_BITS) - 1)
    at = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - SAMPLE + 1) & low
    at = at.astype(np.int64)
    whole = owner[: len(at)] == owner[length - 1 : length - 1 + len(at)]
    edge = np.ones(len(at) + 1, bool)
    edge[1:-1] = (at[1:] != at[:-1]) | (whole[1:] != whole[:-1]) | (owner[1 : len(at)] != owner[: len(at) - 1])
    cuts = np.flatnonzero(edge)
    first, stop = cuts[:-1], cuts[1:]
    keep = whole[first]
    first, stop = first[keep], stop[keep]
    p = at[first]
    w = window_names(data, length, names)
    shape = ((p - first) << 8 | (stop - first)).astype(np.uint64)
    around = _mix(_mix(w[first] * _MULTIPLIERS[3] + w[stop - 1]) * _MULTIPLIERS[5] + shape)
    return p, first, stop - first, h[p], around


# A place in a document as one long: start of the anchor, how far before it the first window starts, number of windows.
def pack(p: np.ndarray, back: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (p << 14) | (back << 7) | n


def unpack(x: np.ndarray):
    return x >> 14, x >> 7 & 127, x & 127


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v) if isinstance(v, np.ndarray) else v for v in columns.values()], list(columns))


def sampled(docs: DataFrame, length: int) -> DataFrame:
    """``name, around, doc, tag, place, later``: the anchors of ``docs(doc, tag, data)``.

    Repeats within an Arrow batch are told at once (``later``) and dealt out at
    random, so a passage that every document has meets in one place no more
    often than there are batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, held, size = [], [], 0

            def flush():
                lengths = np.array([len(d) for _, _, d in held])
                base = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                p, first, n, name, around = anchors(np.frombuffer(b"".join(d for _, _, d in held), np.uint8), np.repeat(np.arange(len(held)), lengths), length)
                of = np.searchsorted(base, first, "right") - 1
                doc, tag = (np.array([h[i] for h in held], np.int64)[of] for i in (0, 1))
                parts.append((name, around, doc, tag, pack(p - base[of], p - first, n)))

            for doc, tag, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                data = data.as_py()
                if len(data) >= length:
                    held.append((doc, tag, data))
                    size += len(data)
                    if size >= CHUNK:
                        flush()
                        held, size = [], 0
            if held:
                flush()
            if not parts:
                continue
            name, around, doc, tag, place = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((place, tag, doc, around, name))
            name, around, doc, tag, place = name[order], around[order], doc[order], tag[order], place[order]
            new = np.ones(len(name), bool)
            new[1:] = (name[1:] != name[:-1]) | (around[1:] != around[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(name)), 0))
            same = ~new & (doc == doc[first]) & (tag == tag[first]) & (place == place[first])  # a repeated row
            name = np.where(new, name, _mix(place.view(np.uint64) + doc.view(np.uint64) + tag.view(np.uint64)))
            keep = ~same
            yield _batch({"name": name[keep].view(np.int64), "around": around[keep].view(np.int64), "doc": doc[keep], "tag": tag[keep], "place": place[keep], "later": pa.array(~new[keep])})

    return map_batches(docs, run, "name bigint, around bigint, doc bigint, tag bigint, place bigint, later boolean")


def ranked(samples: DataFrame) -> DataFrame:
    """``doc, tag, place, name, open``: anchors that repeat.

    Sorted by (name, neighbourhood, position): the first of a neighbourhood
    keeps its bytes, later ones are repeats (``open`` false).  First ones whose
    anchor has other neighbourhoods are ``open``: their windows are told apart
    next.  Unique anchors drop out.  A task streams through its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # name, around, doc, tag, place of the group's last neighbourhood
        several = False  # whether the group has shown more than one
        for b in batches:
            columns = [b.column(i).to_numpy() for i in range(5)]
            later = b.column(5).to_numpy(zero_copy_only=False)
            told, rows = np.flatnonzero(later), np.flatnonzero(~later)
            out = [(*(c[told] for c in (*columns[2:], columns[0])), np.zeros(len(told), bool))]
            if len(rows):
                columns = [c[rows] for c in columns]
                head = last is not None
                if head:
                    columns = [np.concatenate([[x], y]) for x, y in zip(last, columns)]
                name, around, doc, tag, place = columns
                group = np.ones(len(name), bool)
                group[1:] = name[1:] != name[:-1]
                new = group.copy()
                new[1:] |= around[1:] != around[:-1]
                first = np.maximum.accumulate(np.where(new, np.arange(len(name)), 0))
                repeat = ~new & ((doc != doc[first]) | (tag != tag[first]) | (place != place[first]))
                gid = np.cumsum(group) - 1
                kinds = np.bincount(gid, weights=new)
                if head and several:
                    kinds[0] += 1
                multi = new & (kinds[gid] > 1)
                if head:
                    multi[0] &= not several  # told with the batch that showed it
                out += [(doc[x], tag[x], place[x], name[x], np.full(x.sum(), state)) for x, state in ((repeat, False), (multi, True))]
                several = bool(kinds[-1] > 1)
                last = [c[first[-1]] for c in columns]
            yield _batch(dict(zip(("doc", "tag", "place", "name", "open"), (np.concatenate(x) for x in zip(*out)))))

    dealt = samples.repartition("name").sortWithinPartitions("name", "around", "doc", "tag", "place")
    return map_batches(dealt, run, "doc bigint, tag bigint, place bigint, name bigint, open boolean", rows=10_000)


def contexts(docs: DataFrame, length: int) -> DataFrame:
    """``name, doc, tag, place, bytes``: the neighbourhoods of open anchors, from ``docs(doc, tag, data, marks)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            name, doc, tag, place, data = [], [], [], [], []
            for d, t, text, marks in zip(*(b.column(n).to_pylist() for n in ("doc", "tag", "data", "marks"))):
                for m in marks:
                    if m["open"]:
                        p, back, n = unpack(m["place"])
                        name.append(m["name"]), doc.append(d), tag.append(t), place.append(m["place"])
                        data.append(text[p - back : p - back + n - 1 + length])
            yield pa.record_batch([*(pa.array(c, pa.int64()) for c in (name, doc, tag, place)), pa.array(data, pa.binary())], ["name", "doc", "tag", "place", "bytes"])

    return map_batches(docs, run, "name bigint, doc bigint, tag bigint, place bigint, bytes binary")


def _windows(b: pa.RecordBatch, length: int):
    """All windows of a batch of contexts: row, offset to the anchor, start, name."""
    place = b.column("place").to_numpy()
    p, back, n = unpack(place)
    texts = b.column("bytes").to_pylist()
    data = np.frombuffer(b"".join(texts), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]]).astype(np.int64)
    names = window_names(data, length)
    row = np.repeat(np.arange(len(place)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    offset = back[row] - k
    return row, offset, p[row] - offset, names[base[row] + k]


def _spans(doc: np.ndarray, start: np.ndarray, length: int, tag: np.ndarray):
    """Window starts of one document in runs: doc, tag, begin, end of the bytes covered."""
    order = np.lexsort((start, tag, doc))
    doc, start, tag = doc[order], start[order], tag[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > start[:-1] + 1)
    a = np.flatnonzero(new)
    z = np.concatenate([a[1:], [len(doc)]]) - 1 if len(a) else a
    return doc[a], tag[a], start[a], start[z] + length


def told_apart(open_contexts: DataFrame, length: int) -> DataFrame:
    """``doc, tag, begin, stop``: spans of the windows of open anchors that start earlier elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_name, held, before = None, np.zeros(0, np.uint64), None  # the last anchor, its windows so far, the last row
        for b in batches:
            at = np.stack([b.column(n).to_numpy() for n in ("name", "doc", "tag", "place")])
            old = np.all(at[:, 1:] == at[:, :-1], axis=0)  # a repeated row of the table
            fresh = np.concatenate([[before is None or not np.array_equal(at[:, 0], before)], ~old]) if at.shape[1] else np.zeros(0, bool)
            before = at[:, -1] if at.shape[1] else before
            b = b.filter(pa.array(fresh))
            if not b.num_rows:
                continue
            name, doc, tag = (b.column(n).to_numpy() for n in ("name", "doc", "tag"))
            row, offset, start, w = _windows(b, length)
            key = _mix(w + _mix(name.view(np.uint64)[row] * _MULTIPLIERS[2] + offset.astype(np.uint64)))
            order = np.argsort(key, kind="stable")
            new = np.ones(len(key), bool)
            s = key[order]
            new[1:] = s[1:] != s[:-1]
            first = np.empty(len(key), np.int64)
            first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
            repeat = (first != np.arange(len(key))) & ((doc[row] != doc[row[first]]) | (start != start[first]) | (tag[row] != tag[row[first]]))
            if name[0] == held_name:
                repeat |= np.isin(key, held)
            mine = key[name[row] == name[-1]]
            held = np.unique(np.concatenate([held, mine]) if name[-1] == held_name else mine)
            held_name = name[-1]
            d, t, a, z = _spans(doc[row[repeat]], start[repeat], length, tag[row[repeat]])
            yield _batch({"doc": d, "tag": t, "begin": a, "stop": z})

    dealt = open_contexts.repartition("name").sortWithinPartitions("name", "doc", "tag", "place")
    return map_batches(dealt, run, "doc bigint, tag bigint, begin bigint, stop bigint")


def told_apart_by_spark(open_contexts: DataFrame, length: int) -> DataFrame:
    """As ``told_apart``, for anchors with very many neighbourhoods: a grouped minimum over single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, offset, start, w = _windows(b, length)
            name, doc, tag = (b.column(n).to_numpy()[row] for n in ("name", "doc", "tag"))
            yield _batch({"name": name, "window": w.view(np.int64), "off": offset, "doc": doc, "tag": tag, "begin": start})

    w = map_batches(open_contexts, run, "name bigint, window bigint, off bigint, doc bigint, tag bigint, begin bigint")
    first = w.groupBy("name", "window", "off").agg(F.min(F.struct("doc", "tag", "begin")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    met = w.join(first, ["name", "window", "off"]).filter("first != struct(doc, tag, begin)")
    return met.select("doc", "tag", "begin", (F.col("begin") + length).alias("stop"))


def merged(found: list[tuple[int, int]]) -> list[list[int]]:
    """Spans that overlap or touch as one."""
    runs: list[list[int]] = []
    for a, z in sorted(found):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], z)
        else:
            runs.append([a, z])
    return runs


def outward(runs: list[list[int]], data: bytes) -> list[list[int]]:
    """Runs that also take the rest of the UTF-8 characters that they cut."""
    inside = lambda i: i < len(data) and data[i] & 0xC0 == 0x80  # noqa: E731  whether a character goes on at i
    out = []
    for a, z in runs:
        while a and inside(a):
            a -= 1
        while inside(z):
            z += 1
        out.append((a, z))
    return merged(out)


def cut(docs: DataFrame, length: int, whole: bool = False) -> DataFrame:
    """Merged removed runs and kept bytes of ``docs(key, carried, data, marks, more)``; ``whole`` removes whole characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, removed, spans = [], [], []
            for data, marks, more in zip(*(b.column(n).to_pylist() for n in ("data", "marks", "more"))):
                p, back, n = unpack(np.array([m["place"] for m in marks or () if not m["open"]], np.int64))
                found = [*zip((p - back).tolist(), (p - back + n - 1 + length).tolist())]
                found += [(m["begin"], m["stop"]) for m in more or ()]
                runs = merged(found)
                if whole:
                    runs = outward(runs, data)
                edges = [0, *(x for r in runs for x in r), len(data)]
                kept.append(b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2])) if runs else data)
                removed.append(sum(z - a for a, z in runs))
                spans.append([{"begin": a, "stop": z} for a, z in runs])
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))
            yield pa.record_batch([b.column("key"), b.column("carried"), pa.array([len(d) for d in b.column("data").to_pylist()], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["key", "carried", "n_bytes", "n_removed", "spans", "kept"])

    kind = docs.schema["carried"].dataType.simpleString()
    return map_batches(docs, run, f"key bigint, carried {kind}, n_bytes bigint, n_removed bigint, spans array<struct<begin:bigint,stop:bigint>>, kept binary")


def tagged(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """``doc, tag, data, carried``: a row's text and the two longs that tell it from all rows but its repeats.

    ``tag`` is zero where the id alone does so, and the text's 64-bit hash
    where the id is null or shared, so these rows do not meet at one key.
    """
    doc = F.coalesce(F.col(id_col).cast("bigint"), F.lit(LOWEST))
    shared = materialize(docs.groupBy(doc.alias("doc")).count().filter(f"count > 1 and doc != {LOWEST}L").select("doc", F.lit(True).alias("shared")))
    source = docs.select(doc.alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("data"), F.struct(F.lit(0).alias("_"), *carry).alias("carried"))
    tag = F.when(F.col("shared") | (F.col("doc") == LOWEST), F.xxhash64("data")).otherwise(F.lit(0).cast("long"))
    return source.join(shared, "doc", "left").select("doc", tag.alias("tag"), "data", "carried")


def dedup(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept, carried`` a row: whole texts less repeated strings.

    A byte goes if a string of ``length`` bytes (64 to 127) that covers it also
    starts earlier: in a smaller ``doc_id``, or earlier in the same text.  A
    null text is empty; a null id counts as the smallest; texts that share an
    id come in the order of a hash, and equal rows leave each other alone.
    Other columns are ignored but for those of ``carry``, which come back in
    the struct ``carried``.  ``spans`` are the maximal removed runs; with
    ``whole`` they take in characters that they would cut, so that what is
    kept of valid UTF-8 is valid.
    """
    key = ["doc", "tag"]
    source = tagged(docs, id_col, text_col, carry)
    marks = materialize(ranked(sampled(source.select(*key, "data"), length)))
    placed = source.join(marks.groupBy(*key).agg(F.collect_list(F.struct("place", "name", "open")).alias("marks")), key, "left")
    found = materialize(contexts(placed.filter(F.exists("marks", lambda m: m["open"])).select(*key, "data", "marks"), length))
    many = found.groupBy("name").count().filter(F.col("count") > CROWDED).select("name")
    spans = told_apart(found.join(many, "name", "left_anti"), length).union(told_apart_by_spark(found.join(many, "name", "left_semi"), length))
    more = spans.groupBy(*key).agg(F.collect_list(F.struct("begin", "stop")).alias("more"))
    done = cut(placed.join(more, key, "left").select(F.col("doc").alias("key"), "carried", "data", "marks", "more"), length, whole)
    return done.select(F.when(F.col("key") != LOWEST, F.col("key")).alias("doc_id"), "n_bytes", "n_removed", "spans", "kept", "carried")


def digests(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
