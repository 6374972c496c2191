"""Document likelihood over all segmentations into subword pieces.

The pieces of a public sentencepiece vocabulary carry unigram probabilities
estimated from the training documents (its file has BPE ranks in their place,
which are no likelihoods): word counts of the corpus, each word segmented by
the vocabulary, give piece counts, and byte pieces spell what has no piece.
Words start with the word mark, which no piece has inside, so the lattice of a
text falls apart at its words; the forward recursion

    alpha(0) = 0,  alpha(j) = logsumexp over pieces w[i:j] of alpha(i) + log p(piece)

runs once for each distinct word of the corpus, beside its count, and a text's
marginal log probability is the sum over its words and the end event.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import map_batches, materialize

MARK = "▁"
#: Most frequent training words that every task gets a copy of; the other words are joined by key.
FREQUENT = 60_000
ALPHA = 0.1
#: Words that a task holds before it sends them on: bounds its memory.
SENT = 20_000
#: Distinct words that a counting task holds before it sends their counts on.
COUNTED = 200_000
#: Words that a task takes at a time.
WORDS = 10_000
#: Words scored side by side, and the longest of them; longer words are scored one at a time.
BESIDE, LONGEST = 4096, 64
#: Bits of a code point, below a trie node in the key of an edge.
CHAR_BITS = 21

_state: dict = {}


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "replace").lower().split()


def vocabulary(path: str):
    if path not in _state:
        import sentencepiece

        _state[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _state[path]


def count_words(flagged: DataFrame) -> DataFrame:
    """``word binary, n bigint`` of ``text, train``: all words, with their counts in the rows that train.

    Counts are summed in each task before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        others: set[bytes] = set()

        def found():
            others.difference_update(counts)
            n = pa.array([*counts.values(), *[0] * len(others)], pa.int64())
            made = pa.record_batch([pa.array([*counts, *others], pa.binary()), n], ["word", "n"])
            counts.clear()
            others.clear()
            return made

        for b in batches:
            for text, train in zip(b.column(0), b.column(1).to_pylist()):
                (counts if train else others).update(tokens(text.as_py()))
                if len(counts) + len(others) > COUNTED:
                    yield found()
        yield found()

    return map_batches(flagged, run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def piece_counts(words: DataFrame, path: str) -> DataFrame:
    """``piece int, n bigint``: counts of the vocabulary's pieces; bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = vocabulary(path)
        total = np.zeros(sp.get_piece_size(), np.int64)
        for b in batches:
            found = encode_words(sp, [w.decode("utf-8", "replace") for w in b.column("word").to_pylist()])
            ids = np.fromiter((i for word in found for i in word), np.int64)
            np.add.at(total, ids, np.repeat(b.column("n").to_numpy(), [len(word) for word in found]))
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["piece", "n"])

    return map_batches(words, run, "piece int, n bigint", rows=WORDS).groupBy("piece").agg(F.sum("n").alias("n"))


def encode_words(sp, words: list[str]) -> list[list[int]]:
    """The vocabulary's own segmentation of each word (its normaliser adds the word mark)."""
    return sp.encode(words, num_threads=1)


class Lattice:
    """Natural log probabilities of words: sums over their segmentations."""

    def __init__(self, path: str, counts: dict[int, int], n_words: int, n_ends: int):
        sp = vocabulary(path)
        size = sp.get_piece_size()
        total = sum(counts.values()) + n_ends + ALPHA * (size + 1)
        self.end = math.log((n_ends + ALPHA) / total)
        self.log: dict[str, float] = {}
        self.byte = [0.0] * 256
        for i in range(size):
            p = math.log((counts.get(i, 0) + ALPHA) / total)
            if sp.is_byte(i):
                self.byte[int(sp.id_to_piece(i)[3:5], 16)] = p
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.log[sp.id_to_piece(i)] = p
        self.single = {p for p in self.log if len(p) == 1}
        self._trie()

    def _trie(self) -> None:
        """The pieces' trie as arrays: a sorted key (node, character) for each edge, its child, each node's log probability."""
        nodes: dict[str, int] = {"": 0}
        edges: dict[int, int] = {}
        for piece in self.log:
            for k in range(1, len(piece) + 1):
                if piece[:k] not in nodes:
                    nodes[piece[:k]] = len(nodes)
                    edges[nodes[piece[: k - 1]] << CHAR_BITS | ord(piece[k - 1])] = nodes[piece[:k]]
        self.keys = np.array(sorted(edges), np.int64)
        self.child = np.array([edges[k] for k in self.keys.tolist()], np.int64)
        self.weight = np.array([self.log.get(s, -np.inf) for s in nodes])
        self.nodes = nodes

    def spelled(self, char: str) -> float:
        """Log probability of a character's bytes."""
        return sum(self.byte[b] for b in char.encode("utf-8", "replace"))

    def word(self, word: bytes) -> float:
        return float(self.words([word])[0])

    def words(self, words: list[bytes]) -> np.ndarray:
        """The words' marginal log probabilities; words of like length are taken through the recursion side by side."""
        texts = [MARK + w.decode("utf-8", "replace") for w in words]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        out = np.empty(len(texts))
        order = np.argsort(lengths, kind="stable")
        short = int((lengths <= LONGEST).sum())
        for k in range(0, short, BESIDE):
            at = order[k : min(k + BESIDE, short)]
            out[at] = self.beside([texts[i] for i in at], lengths[at])
        for i in order[short:]:
            out[i] = self.forward(texts[i])
        return out

    def beside(self, texts: list[str], lengths: np.ndarray) -> np.ndarray:
        """``forward`` of many texts at once; what stands past the end of a text adds nothing to its result."""
        longest = int(lengths[-1])
        chars = np.frombuffer("".join(t.ljust(longest, "\0") for t in texts).encode("utf-32-le"), "<u4").reshape(len(texts), longest)
        chars = np.ascontiguousarray(chars.T.astype(np.int64))
        kinds, codes = np.unique(chars, return_inverse=True)
        codes = codes.reshape(chars.shape)
        first = np.array([self.nodes.get(chr(c), -1) for c in kinds])
        bytewise = np.array([-np.inf if chr(c) in self.single else self.spelled(chr(c)) for c in kinds])
        alpha = np.full((longest + 1, len(texts)), -np.inf)
        alpha[0] = 0.0
        for i in range(longest):
            here, spelled = alpha[i], bytewise[codes[i]]
            rows = np.flatnonzero(spelled > -np.inf)
            alpha[i + 1, rows] = np.logaddexp(alpha[i + 1, rows], here[rows] + spelled[rows])
            node = first[codes[i]]
            rows = np.flatnonzero(node >= 0)
            node = node[rows]
            for j in range(i + 1, longest + 1):
                p = self.weight[node]
                ends = np.flatnonzero(p > -np.inf)
                r = rows[ends]
                alpha[j, r] = np.logaddexp(alpha[j, r], here[r] + p[ends])
                if j == longest:
                    break
                key = node << CHAR_BITS | chars[j, rows]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                on = np.flatnonzero(self.keys[at] == key)
                if not len(on):
                    break
                rows, node = rows[on], self.child[at[on]]
        return alpha[lengths, np.arange(len(texts))]

    def forward(self, s: str) -> float:
        """The recursion for one text; from each start, strings are lengthened while some piece begins with them."""
        n = len(s)
        alpha = [-math.inf] * (n + 1)
        alpha[0] = 0.0
        for i in range(n):
            moves = [] if s[i] in self.single else [(i + 1, self.spelled(s[i]))]
            j = i + 1
            while j <= n and (node := self.nodes.get(s[i:j])) is not None:
                moves.append((j, self.weight[node]))
                j += 1
            for j, p in moves:
                low, high = sorted((alpha[j], alpha[i] + p))
                alpha[j] = high if low == -math.inf else high + math.log1p(math.exp(low - high))
        return alpha[n]


def add_likelihoods(words: DataFrame, path: str, pieces: dict[int, int], n_words: int, n_ends: int) -> DataFrame:
    """``words`` with ``ll double``, the natural log of each word's marginal probability."""
    shared, key = words.sparkSession.sparkContext.broadcast(pieces), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _state.get("lattice", ("",))[0] != key:
            _state["lattice"] = key, Lattice(path, shared.value, n_words, n_ends)
        lattice = _state["lattice"][1]
        for b in batches:
            ll = pa.array(lattice.words(b.column("word").to_pylist()), pa.float64())
            yield pa.record_batch([b.column("word"), b.column("n"), ll], ["word", "n", "ll"])

    return map_batches(words.select("word", "n"), run, "word binary, n bigint, ll double", rows=WORDS)


def frequent_words(words: DataFrame, most: int) -> list:
    """Rows of the words with the highest counts, at most ``most``: a small histogram of counts gives the least one."""
    level = F.floor(F.log2("n") * 16)
    seen = words.filter(F.col("n") > 0)
    sizes = seen.groupBy(level.alias("level")).agg(F.count("*").alias("size"), F.min("n").alias("least")).orderBy(F.desc("level")).collect()
    least, total = None, 0
    for r in sizes:
        total += r["size"]
        if total > most:
            break
        least = r["least"]
    return words.filter(F.col("n") >= least).collect() if least is not None else []


def score(docs: DataFrame, train: DataFrame | Column, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every row of ``docs`` by a model of the rows of ``train``.

    ``train`` is a table of its own, or a condition on the rows of ``docs``
    (null: not taken), which reads the texts once less.
    Columns: ``id_col, n_tokens, n_known, train_tokens, base_score, score``.
    A null text is empty and has the end token only; with no training rows all
    counts are zero and every word has the smoothed probability; repeated rows
    (and rows that share an id, null included) each get their own result;
    other columns are ignored.

    Corpus counts cover all training rows, and each distinct word is taken
    through the lattice once.  The ``FREQUENT`` commonest words (a stated
    bound) go to every task; each document's other words are joined to the
    table of counts and likelihoods by word, so the vocabulary may be of any size.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string").alias("text")
    if isinstance(train, Column):
        flagged, ends = docs.select(text, F.coalesce(train, F.lit(False)).alias("train")), docs.filter(train).count()
    else:
        flagged = docs.select(text, F.lit(False).alias("train")).union(train.select(text, F.lit(True)))
        ends = train.count()
    counted = materialize(count_words(flagged))
    n, v = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    pieces = {r.piece: r.n for r in piece_counts(counted.filter(F.col("n") > 0), path).collect()}
    words = materialize(add_likelihoods(counted, path, pieces, n, ends))
    total, kinds = n + ends, v + (1 if ends else 0)  # tokens and distinct tokens, the end among them
    scale = math.log10(total + ALPHA * (kinds + 1)) if total + ALPHA * (kinds + 1) > 0 else 0.0
    known = {bytes(r.word): (math.log10(r.n + ALPHA) - scale, r.ll) for r in frequent_words(words, FREQUENT)}
    shared = spark.sparkContext.broadcast(known)
    end_ll = Lattice(path, pieces, n, ends).end
    out = "row bigint, k bigint, n_tokens bigint, n_known bigint, base double, ll double, rest array<struct<word:binary,n:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        types = [pa.int64()] * 4 + [pa.float64()] * 2
        names = ["row", "k", "n_tokens", "n_known", "base", "ll", "rest"]

        def frame(rows, offsets, rare, counts):
            rest = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(counts, pa.int32())], ["word", "n"]))
            columns = list(zip(*rows)) or [()] * 6
            return pa.record_batch([*(pa.array(c, t) for c, t in zip(columns, types)), rest], names)

        for b in batches:
            rows, offsets, rare, counts = [], [0], [], []
            for row, k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                found = tokens(text.as_py())
                n_known, base, ll = 0, 0.0, 0.0
                rest: Counter = Counter()
                for w in found:
                    if w in known:
                        more_base, more_ll = known[w]
                        n_known += 1
                        base += more_base
                        ll += more_ll
                    else:
                        rest[w] += 1
                rare += rest
                counts += rest.values()
                offsets.append(len(rare))
                rows.append((row, k, len(found), n_known, base, ll))
                if len(rare) >= SENT:
                    yield frame(rows, offsets, rare, counts)
                    rows, offsets, rare, counts = [], [0], [], []
            yield frame(rows, offsets, rare, counts)

    picked = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("k"), F.col(text_col).cast("string").alias("t"))
    scored = materialize(map_batches(picked, run, out))
    rare = scored.select("row", F.explode("rest").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("tf"))
    sums = rare.join(words, "word").groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("more_known"),
        F.sum(F.col("tf") * (F.log10(F.col("n") + F.lit(ALPHA)) - F.lit(scale))).alias("more_base"),
        F.sum(F.col("tf") * F.col("ll")).alias("more_ll"),
    )
    return scored.join(sums, "row", "left").select(
        F.col("k").alias(id_col),
        (F.col("n_tokens") + 1).alias("n_tokens"),
        (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) + F.lit(math.log10(ends + ALPHA) - scale)).alias("base_score"),
        ((F.col("ll") + F.coalesce("more_ll", F.lit(0.0)) + F.lit(end_ll)) / math.log(10)).alias("score"),
    )
