"""Ordinal cumulative-link regression on graded ratings over hashed text.

Grades 0 .. K-1 share one weight vector over hashed features and have ordered
thresholds: P(grade <= k) = sigmoid(theta_k - w.x).  The fit runs on a bounded
sample of labelled rows; scoring covers every row and needs no shuffle.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import map_batches

#: log2 of the number of hash buckets.
HASH_BITS = 18
#: Labelled documents to fit on (those with the least hashed ids), one row for each; the bound on what reaches the driver.
SAMPLE = 16_000
#: Buckets that fewer sampled documents have stay at weight zero.
MIN_DOCUMENTS = 10
STEPS, RATE, L2 = 120, 0.1, 3e-4
#: Bytes that the words whose features a Python task remembers may take, and what an entry has besides its word.
CACHE, ENTRY = 32 << 20, 240
GRADES = 3

_cache: dict[bytes, tuple[int, ...]] = {}
_held = 0  # bytes in the cache

#: Bytes by class: letters (all of UTF-8's further bytes among them), digits, and signs as they are.
_CLASSES = bytes(97 if 97 <= b < 123 or b > 127 else 65 if 65 <= b < 91 else 48 if 48 <= b < 58 else b for b in range(256))
_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_fold = re.compile(rb"(.)\1+").sub


def shape(word: bytes) -> bytes:
    """The whole word's classes of characters, runs folded: ``Aa``, ``A!``, ``a*``, ``0`` ..."""
    return _fold(rb"\1", word.translate(_CLASSES))


def bucket(data: bytes) -> int:
    return (zlib.crc32(data) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - HASH_BITS)


def word_features(word: bytes) -> tuple[int, ...]:
    global _held
    got = _cache.get(word)
    if got is None:
        bare = word.strip(_SIGNS).lower() or word
        got = (bucket(b"w" + bare), bucket(b"s" + shape(word)))
        if _held > CACHE:
            forget()
        _cache[word] = got
        _held += ENTRY + len(word)
    return got


def features(text: str | None) -> np.ndarray:
    """Distinct buckets of a text's words, their shapes, and how often words repeat; none for a text without words."""
    found = (text or "").encode("utf-8", "replace").split()
    distinct = set(found)
    out: set[int] = set()
    for w in distinct:
        out.update(_cache.get(w) or word_features(w))
    if found:
        double = sum(map(eq, found, islice(found, 1, None)))
        out.add(bucket(b"d%d" % int(math.log2(1 + 100 * double / len(found)))))
        out.add(bucket(b"r%d" % int(10 * len(distinct) / len(found))))
        out.add(bucket(b"n%d" % len(found).bit_length()))
    return np.fromiter(out, np.int32, len(out))


def forget() -> None:
    global _held
    _cache.clear()
    _held = 0


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def cumulative(self, text: str | None) -> np.ndarray:
        """P(grade > k) for k = 0 .. K-2."""
        z = float(self.weights[features(text)].sum())
        return 1 / (1 + np.exp(np.clip(self.thresholds - z, -60, 60)))


def likelihood(w: np.ndarray, theta: np.ndarray, at: np.ndarray, doc: np.ndarray, grades: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The penalised negative log-likelihood and its gradients by ``w`` and ``theta``.

    Document ``doc[i]`` has feature ``at[i]``; ``weight`` is each document's share.
    """
    n, i, k = len(grades), np.arange(len(grades)), np.arange(len(theta))
    z = np.bincount(doc, w[at], minlength=n)
    below = 1 / (1 + np.exp(np.clip(z[:, None] - theta, -60, 60)))  # P(grade <= k)
    padded = np.hstack([np.zeros((n, 1)), below, np.ones((n, 1))])
    p = np.maximum(padded[i, grades + 1] - padded[i, grades], 1e-9)
    slope = np.hstack([np.zeros((n, 1)), below * (1 - below), np.zeros((n, 1))])
    dz = weight * (slope[i, grades + 1] - slope[i, grades]) / p
    g_theta = -(weight[:, None] * slope[:, 1:-1] * ((k == grades[:, None]).astype(float) - (k == grades[:, None] - 1)) / p[:, None]).sum(0)
    g_w = np.bincount(at, dz[doc], minlength=len(w)) + L2 * w
    return float(-(weight * np.log(p)).sum() + L2 / 2 * (w * w).sum()), g_w, g_theta


def fit(rows: list[np.ndarray], grades: np.ndarray) -> Model:
    """Full-batch Adam on the penalised likelihood; without rows every grade is as likely as the next."""
    size = 1 << HASH_BITS
    weights, start = np.zeros(size), np.log(np.arange(1, GRADES) / (GRADES - np.arange(1, GRADES)))
    if not len(rows):
        return Model(weights.astype(np.float32), start)
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    doc = np.repeat(np.arange(len(rows)), lengths)
    keep = np.bincount(flat, minlength=size)[flat] >= MIN_DOCUMENTS
    flat, doc = flat[keep], doc[keep]
    used, at = np.unique(flat, return_inverse=True)
    w, theta = np.zeros(len(used)), start.copy()
    share = np.bincount(grades, minlength=GRADES) / len(grades)
    weight = (1 / np.sqrt(np.maximum(share, 1e-3)))[grades]
    weight /= weight.sum()
    m = [np.zeros(len(used)), np.zeros(GRADES - 1)]
    v = [np.zeros(len(used)), np.zeros(GRADES - 1)]
    for step in range(1, STEPS + 1):
        _, g_w, g_theta = likelihood(w, theta, at, doc, grades, weight)
        for n, (x, g) in enumerate(((w, g_w), (theta, g_theta))):
            m[n] = 0.9 * m[n] + 0.1 * g
            v[n] = 0.99 * v[n] + 0.01 * g * g
            x -= RATE * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-8)
        theta.sort()
    weights[used] = w
    return Model(weights.astype(np.float32), theta)


def sample(docs: DataFrame, labels: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[np.ndarray], np.ndarray]:
    """All features and the grades of at most ``size`` labelled documents.

    Grade 0: toxic; 1: of low quality; 2: neither.  Several labels of a
    document count as the worst; null labels and ids do not count.  Of rows
    that share an id the one whose text has the least hash stands for it, so
    the bound holds however often a row repeats.
    """
    graded = labels.filter("doc_id is not null and (toxic is not null or quality is not null)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    graded = graded.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("grade"))
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [features(t).astype("<i4").tobytes() for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(made, pa.binary())], ["grade", "at"])

    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    one = text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("grade").alias("grade"), F.min_by("t", F.xxhash64("t")).alias("t"))
    found = map_batches(one.select("grade", "t"), run, "grade int, at binary").toArrow()
    return [np.frombuffer(x, "<i4") for x in found["at"].to_pylist()], np.array(found["grade"].to_pylist(), int)


def score(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, least: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, expected_grade, tail_probability, kept`` for every row.

    ``tail_probability`` is that of the highest grade; ``kept`` if it is at
    least ``least``.  A null or empty text has no features and the thresholds
    alone decide; repeated rows and null ids are scored like any other, an
    empty table gives none; other columns are ignored.
    """
    shared = trained(docs, labels, size, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            p = np.array([m.cumulative(t) for t in b.column(1).to_pylist()]).reshape(-1, GRADES - 1)
            yield pa.record_batch([b.column(0), pa.array(p.sum(1)), pa.array(p[:, -1]), pa.array(p[:, -1] >= least)], ["k", "expected_grade", "tail_probability", "kept"])

    picked = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    return map_batches(picked, run, f"k {kind}, expected_grade double, tail_probability double, kept boolean", forget).withColumnRenamed("k", id_col)


def trained(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text"):
    """The fitted model, shared with the executors: 2**HASH_BITS weights, however much there is to score."""
    return docs.sparkSession.sparkContext.broadcast(fit(*sample(docs, labels, size, id_col, text_col)))


def keep(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, least: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, with all their columns."""
    shared = trained(docs, labels, size, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield b.filter(pa.array([bool(m.cumulative(t)[-1] >= least) for t in b.column(text_col).to_pylist()], pa.bool_()))

    return map_batches(docs, run, docs.schema, forget)
