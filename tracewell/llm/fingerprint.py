"""Invertible Bloom lookup sketches of documents, in Spark expressions only.

A text is a multiset of paragraphs (lines, long ones in pieces of ``PIECE``
code points); a paragraph and how often it occurs give one 64-bit digest.  The
digests are dealt to 2**level buckets by their top bits and each bucket is a
table of ``3 * CELLS`` cells: a digest adds itself to one cell of each third
(a count, the xor of digests, the xor of their hashes).  Subtracting the
sketches of two versions cancels what they share; a cell that holds a single
digest gives it away, taking it out may leave others single, and so on until
the cells are empty.  A bucket that does not empty is sketched again in both
versions, with four times the cells and other bits of its digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.common import let, materialize

PIECE = 160
CELLS = 8
#: Digests a bucket holds on average, at most, at the first attempt.
LOAD = 4
#: Sizes of a bucket's table, each four times the last; rounds of peeling.
ATTEMPTS, ROUNDS = 4, 12
#: Consecutive ids whose documents are ordered in one task.
SPAN = 2048

_LOWEST = -(1 << 63)


def digests(text: Column) -> Column:
    """Sorted distinct digests of a text's paragraphs; their lowest bit is 1."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{PIECE}}}\n?|\n"), F.lit(0))
    hashed = F.sort_array(F.transform(pieces, lambda p: F.xxhash64(p)))

    def counted(h: Column) -> Column:
        n = F.size(h)
        places = F.sequence(F.lit(0), n - 1)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(h, i) != F.get(h, i - 1)))
        runs = let(starts, lambda s: F.transform(s, lambda i, k: F.xxhash64(F.get(h, i), F.coalesce(F.get(s, k + 1), n) - i).bitwiseOR(F.lit(1).cast("long"))))
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.sort_array(F.array_distinct(runs)))

    return let(hashed, counted)


def level(n: Column) -> Column:
    """Least level at which ``n`` digests load buckets by no more than ``LOAD``."""
    return F.ceil(F.log2(F.greatest(n / LOAD, F.lit(1.0)))).cast("int")


def place(key: Column, third: int, attempt: Column | None = None) -> Column:
    """Cell of a digest in a third of its bucket's first table, or of the larger one of an attempt."""
    if attempt is None:
        return F.shiftright(key, 1 + 3 * third).bitwiseAND(F.lit(CELLS - 1).cast("long")).cast("int")
    bits = F.call_function("shiftright", F.xxhash64(key, attempt), (3 + 2 * attempt) * third)
    return bits.bitwiseAND((cells_of(attempt) - 1).cast("long")).cast("int")


def cells_of(attempt: Column | None) -> Column:
    """Cells of a third of a table."""
    return F.lit(CELLS) if attempt is None else F.call_function("shiftleft", F.lit(CELLS), 2 * attempt)


def added(a: Column, x: Column) -> Column:
    return F.struct((a["n"] + 1).alias("n"), a["k"].bitwiseXOR(x["k"]).alias("k"), a["h"].bitwiseXOR(x["h"]).alias("h"))


def less(a: Column, x: Column) -> Column:
    return F.struct((a["n"] - x["n"]).alias("n"), a["k"].bitwiseXOR(x["k"]).alias("k"), a["h"].bitwiseXOR(x["h"]).alias("h"))


def empty(cell: Column) -> Column:
    return (cell["n"] == 0) & (cell["k"] == 0)


def table(own: Column, attempt: Column | None = None) -> Column:
    """The cells ``(n, k, h)`` of a bucket's digests."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))
    hashed = F.transform(own, lambda k: F.struct(k.alias("k"), F.xxhash64(k).alias("h"), *(place(k, t, attempt).alias(f"c{t}") for t in range(3))))
    cells = F.array(*(F.lit(c) for c in range(CELLS))) if attempt is None else F.sequence(F.lit(0), cells_of(attempt) - 1)

    def third(placed: Column, t: int) -> Column:
        return F.transform(cells, lambda c: F.aggregate(placed, zero, lambda a, x: F.when(x[f"c{t}"] == c, added(a, x)).otherwise(a)))

    return let(hashed, lambda placed: F.concat(*(third(placed, t) for t in range(3))))


def sketch(keys: Column, lev: Column) -> Column:
    """Array of buckets, each the first table of its part of the sorted ``keys``."""
    buckets = F.call_function("shiftleft", F.lit(1), lev)
    low = F.lit(_LOWEST).cast("long")
    marks = F.transform(F.sequence(F.lit(0), buckets - 1), lambda b: F.call_function("shiftleft", b.cast("long"), 64 - lev).bitwiseXOR(low))

    def dealt(s: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.get(s, i).bitwiseAND(F.lit(1).cast("long")) == 0)
        return let(at, lambda a: F.transform(a, lambda i, b: let(F.slice(s, i + 2, F.coalesce(F.get(a, b + 1), F.size(s)) - i - 1), lambda own: table(own))))

    return let(F.sort_array(F.concat(keys, marks)), dealt)


def part(keys: Column, lev: Column, bucket: Column) -> Column:
    """The ``keys`` of one bucket."""
    top = lambda k: F.call_function("shiftrightunsigned", k.bitwiseXOR(F.lit(_LOWEST).cast("long")), 64 - lev)
    return F.filter(keys, lambda k: (lev == 0) | (top(k) == bucket))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.zip_with(x, y, less))


def peel(cells: Column, attempt: Column | None = None) -> Column:
    """Digests that one version's bucket has and the other's has not, or null if the cells did not empty."""

    def single(cells: Column) -> Column:
        pure = F.filter(cells, lambda c: (F.abs(c["n"]) == 1) & (F.xxhash64(c["k"]) == c["h"]))
        return F.array_distinct(F.transform(pure, lambda c: F.struct(*(c[f].alias(f) for f in "knh"), *((place(c["k"], t, attempt) + t * cells_of(attempt)).alias(f"c{t}") for t in range(3)))))

    def without(cells: Column, found: Column) -> Column:
        return F.transform(cells, lambda c, i: F.aggregate(found, c, lambda a, f: F.when((f["c0"] == i) | (f["c1"] == i) | (f["c2"] == i), less(a, f)).otherwise(a)))

    def turn(state: Column, _: Column) -> Column:
        def after(found: Column) -> Column:
            more = F.struct(without(state["cells"], found).alias("cells"), F.concat(state["keys"], F.transform(found, lambda f: f["k"])).alias("keys"), F.lit(False).alias("over"))
            return F.when(F.size(found) == 0, F.struct(state["cells"].alias("cells"), state["keys"].alias("keys"), F.lit(True).alias("over"))).otherwise(more)

        return F.when(state["over"], state).otherwise(let(single(state["cells"]), after))

    none = F.array().cast("array<bigint>")
    start = F.struct(cells.alias("cells"), none.alias("keys"), F.lit(False).alias("over"))
    end = F.aggregate(F.array(*(F.lit(i) for i in range(ROUNDS))), start, turn)
    peeled = let(end, lambda e: F.when(F.forall(e["cells"], empty), e["keys"]))
    return F.when(F.forall(cells, empty), none).otherwise(peeled)


def with_difference(df: DataFrame, name: str, a: str, b: str, first: Column | None = None, plain: bool = True) -> DataFrame:
    """``df`` with ``name``: the digests that one of two columns of sorted digests has and the other has not, from their sketches.

    ``first`` is the difference of the two sketches, if there is one already.
    Buckets that fail are sketched again, larger, up to ``ATTEMPTS`` sizes; one
    that fails at every size (no such bucket is known) has its arrays compared
    if ``plain``, else the result is null.
    """
    lev = F.greatest(level(F.size(a)), level(F.size(b)))
    tables = first if first is not None else subtract(sketch(F.col(a), lev), sketch(F.col(b), lev))
    peeled, again, mended = (f"_{name}_{x}" for x in ("peeled", "again", "mended"))
    parts = F.transform(peeled, lambda keys, i: F.when(keys.isNull(), F.struct(part(F.col(a), lev, i).alias("a"), part(F.col(b), lev, i).alias("b"))))

    def larger(p: Column) -> Column:
        one = lambda keys, i: F.coalesce(keys, peel(F.zip_with(table(p["a"], i), table(p["b"], i), less), i))
        found = F.aggregate(F.array(*(F.lit(i) for i in range(1, ATTEMPTS))), F.lit(None).cast("array<bigint>"), one)
        return F.coalesce(found, F.concat(F.array_except(p["a"], p["b"]), F.array_except(p["b"], p["a"]))) if plain else found

    out = df.withColumn(peeled, F.transform(tables, lambda cells: peel(cells)))
    out = out.withColumn(again, F.when(F.exists(peeled, lambda keys: keys.isNull()), parts))
    out = out.withColumn(mended, F.transform(again, lambda p: F.when(p.isNotNull(), larger(p))))
    both = F.when(F.col(again).isNull(), F.col(peeled)).otherwise(F.zip_with(peeled, mended, lambda x, y: F.coalesce(x, y)))
    return out.withColumn(name, F.flatten(both)).drop(peeled, again, mended)


def likeness(a: str, b: str, difference: str) -> Column:
    """Shared digests over all digests of two versions, 1 for two empty ones."""
    d, both = F.size(difference), F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise((both - d) / (both + d))


def signature(first: Column) -> Column:
    """32 hex digits of a text's sketch at its own level: equal for equal texts."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(first)), 16, "0"), F.lpad(F.hex(F.xxhash64(first, F.lit(1))), 16, "0")))


def followed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs(doc, tie, *columns)`` with ``next``, the ``columns`` of the next row by descending ``doc``, the first after the last.

    Ids are dealt in spans and ordered within each (rows without an id in spans
    of ``tie``); a small table of the spans' first rows closes the gaps between
    them.  It is written first, so Spark
    knows its size and broadcasts it only where it is small.
    """
    none = F.lit(_LOWEST >> 9) - F.floor(F.col("tie") / (1 << 42))  # below the span of any id; a greater tie comes later
    spans = docs.withColumn("span", F.when(F.col("doc") == _LOWEST, none).otherwise(F.call_function("div", F.col("doc") - F.pmod(F.col("doc"), F.lit(SPAN)), F.lit(SPAN))))
    w = W.partitionBy("span").orderBy(F.desc("doc"), "tie")
    within = spans.withColumn("next", F.lead(F.struct(*columns)).over(w))
    heads = spans.groupBy("span").agg(F.max(F.struct("doc", (-F.col("tie")).alias("tie"))).alias("head"))
    order = W.orderBy(F.desc("span"))
    below = materialize(heads.select("span", F.coalesce(F.lead("head").over(order), F.first("head").over(order)).alias("head")))
    firsts = docs.join(below.select("span", F.col("head.doc").alias("doc"), (-F.col("head.tie")).alias("tie")), ["doc", "tie"]).dropDuplicates(["span"])
    edges = firsts.select("span", F.struct(*columns).alias("edge"))
    return within.join(edges, "span", "left").withColumn("next", F.coalesce("next", "edge")).drop("span", "edge")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited version, and their likeness.

    Edited: the last third of the code points gives way to the first as many
    (or all) of the next document's, by descending id; after the last comes the
    first, and a single document is its own next.  Rows that share an id come
    in the order of their texts' hash; a null id is the smallest; a null text
    is empty and, edited, stays empty.  Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("doc"),
        F.shiftright(F.xxhash64(text), 1).alias("tie"),
        text.alias("text"),
    )
    rows = rows.withColumn("keys", digests(F.col("text")))
    pairs = followed(rows, ["text", "keys"]).withColumn("n", F.length("text"))
    third = F.floor(F.col("n") / 3).cast("int")
    edited = pairs.select("doc", "n", "keys", F.col("next.keys").alias("next_keys"), F.concat(F.substring("text", F.lit(1), F.col("n") - third), F.substring(F.col("next.text"), F.lit(1), third)).alias("edited"))
    edited = edited.withColumn("edited_keys", digests(F.col("edited")))
    names = ("keys", "edited_keys", "next_keys")
    leveled = edited.withColumns({f"{k}_level": level(F.size(k)) for k in names})
    sketched = leveled.withColumns({f"{k}_sketch": sketch(F.col(k), F.col(f"{k}_level")) for k in names[:2]})

    def lifted(k: str, lev: Column) -> Column:
        """The sketch of ``k`` at a level, the one at its own level where that will do."""
        again = sketch(F.col(k), lev)
        return F.when(F.col(f"{k}_level") == lev, F.col(f"{k}_sketch")).otherwise(again) if k in names[:2] else again

    for k in names[1:]:
        lev = F.greatest("keys_level", f"{k}_level")
        sketched = with_difference(sketched, f"{k}_differ", "keys", k, subtract(lifted("keys", lev), lifted(k, lev)))
    return sketched.select(
        F.when(F.col("doc") != _LOWEST, F.col("doc")).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        signature(F.col("keys_sketch")).alias("fingerprint"),
        signature(F.col("edited_keys_sketch")).alias("edited_fingerprint"),
        likeness("keys", "edited_keys", "edited_keys_differ").alias("near_edited"),
        likeness("keys", "next_keys", "next_keys_differ").alias("near_next"),
    )
