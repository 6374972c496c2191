"""Fill-in-the-middle documents, cut at two random places between units.

A unit is a match of ``UNIT``: a run of letters or any other character.  Units
are never stored: a first pass over a text counts them, and a second walks a
lazy iterator of matches to the two cuts.  Both passes need no memory besides
the text and one match.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import map_batches

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many stay plain, and of the others so many begin with their suffix.
PLAIN, SUFFIX_FIRST = 10, 20


def draws(id_col: Column, seed: int = 1) -> Column:
    """Four unsigned 32-bit numbers from the hash of ``seed:id``; a null id draws as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)))


def count(text: str, unit: re.Pattern) -> int:
    last = deque(enumerate(unit.finditer(text), 1), maxlen=1)
    return last[0][0] if last else 0


def ends(text: str, unit: re.Pattern, ranks: tuple[int, int]) -> tuple[int, int]:
    """Where the units of the two ascending ``ranks`` end, counted from 1; 0 for rank 0."""
    found, at, out = unit.finditer(text), 0, []
    for rank in ranks:
        if rank > at:
            place, at = next(islice(found, rank - at - 1, None)).end(), rank
        elif not rank:
            place = 0
        out.append(place)
    return out[0], out[1]


def transform(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", unit: str = UNIT) -> DataFrame:
    """``id_col, n, form, prefix_chars, middle_chars, output``, a row for every row.

    ``n`` is the number of units.  ``form`` is ``psm`` (prefix, suffix,
    middle), ``spm`` (suffix, prefix, middle) or ``plain``: an empty or null
    text (whose output is empty), one that holds a marker, and one in ten by
    the draw, whose lengths are null.  Rows that share an id draw alike, null
    ids too; an empty table gives an empty one; other columns are ignored.
    Rows are changed where they are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit)
        for b in batches:
            rows = []
            for text, (h1, h2, h3, h4) in zip(b.column("t").to_pylist(), b.column("h").to_pylist()):
                text = text or ""
                n = count(text, pattern)
                if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - PLAIN:
                    rows.append((n, "plain", None, None, text))
                    continue
                a, z = ends(text, pattern, tuple(sorted((h1 % (n + 1), h2 % (n + 1)))))
                prefix, middle, suffix = text[:a], text[a:z], text[z:]
                if h4 % 100 < SUFFIX_FIRST:
                    rows.append((n, "spm", a, z - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"))
                else:
                    rows.append((n, "psm", a, z - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            columns = list(zip(*rows)) or [()] * len(kinds)
            made = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.record_batch([b.column("k"), *made], ["k", "n", "form", "prefix_chars", "middle_chars", "output"])

    picked = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"), draws(F.col(id_col), seed).alias("h"))
    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(picked, run, f"k {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string").withColumnRenamed("k", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from.

    The first and the second part hold no marker, so they end where the next
    marker first stands, and the third is the rest.
    """
    size = len(PREFIX)
    second = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    at = F.instr(output, second)
    end = F.instr(output, F.lit(MIDDLE))
    first = F.substring(output, F.lit(size + 1), at - size - 1)
    then = F.substring(output, at + size, end - at - size)
    rest = F.substring(output, end + size, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, rest, then)).otherwise(F.concat(then, rest, first))


def digests(made: DataFrame) -> DataFrame:
    """The columns of ``op12_infill``: digests of the output and of the text rebuilt from it."""
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
