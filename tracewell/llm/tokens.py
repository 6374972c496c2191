"""Byte-level BPE as a sentencepiece model, without any training.

The ranks of a public byte-level vocabulary are written out as a sentencepiece
``ModelProto`` of type BPE: each piece is the byte-mapped spelling of a token,
its score the negative rank, its index the rank itself, and the normaliser is
the identity.  Sentencepiece then merges the pair with the highest score first,
which is the lowest rank first.  A text is split by the vocabulary's pattern
and each match encoded by itself; decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import map_batches

#: Pre-tokens a Python worker remembers before it starts afresh: bounds its memory, not the result.
CACHE = 500_000

_state: dict = {}


def byte_alphabet() -> dict[int, str]:
    """One printable character for every byte: itself where printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece BPE model of ``ranks`` (which run from 0 without gaps)."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    to = byte_alphabet()
    model = pb.ModelProto()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = model.pieces.add()
        piece.piece, piece.score = token.decode("latin-1").translate(to), -float(rank)
    unknown = model.pieces.add()  # sentencepiece asks for one; every byte has a piece, so it is never met
    unknown.piece, unknown.type = "<unk>", pb.ModelProto.SentencePiece.Type.UNKNOWN
    model.trainer_spec.model_type = pb.TrainerSpec.ModelType.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    spec = model.normalizer_spec
    spec.name, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString()


class Codec:
    """Encoder and decoder of one rank file; ids are little-endian unsigned 32-bit in ``bytes``."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        self.table = byte_alphabet()
        self.tokens = [b""] * len(ranks)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.cache: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        parts = self.split(text or "")
        missing = [p for p in set(parts) if p not in self.cache]
        if missing:
            if len(self.cache) > CACHE:
                self.cache = {}
                missing = list(set(parts))
            mapped = [p.encode("utf-8", "replace").decode("latin-1").translate(self.table) for p in missing]
            for p, ids in zip(missing, self.model.encode(mapped, num_threads=1)):
                self.cache[p] = np.asarray(ids, "<u4").tobytes()
        return b"".join(map(self.cache.__getitem__, parts))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(path: str, pattern: str) -> Codec:
    """The codec of this Python worker, built once."""
    if (path, pattern) not in _state:
        _state[path, pattern] = Codec(path, pattern)
    return _state[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids binary``: the ids of each whole text, little-endian unsigned 32-bit.

    A null text is empty and has no ids; null and repeated ids of rows pass
    through, a row in a row out; other columns are left out, whatever they
    are called.  No shuffle: rows are encoded where they are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            ids = pa.array([c.encode(t) for t in b.column(1).to_pylist()], pa.binary())
            yield pa.record_batch([b.column(0), ids], ["k", "ids"])

    picked = docs.select(docs[id_col].alias("k"), docs[text_col].cast("string").alias("t"))
    return map_batches(picked, run, f"k {docs.schema[id_col].dataType.simpleString()}, ids binary").withColumnRenamed("k", id_col)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with ``decoded binary``, the bytes that its ``ids`` stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            decoded = pa.array([c.decode(i) for i in b.column("ids").to_pylist()], pa.binary())
            yield pa.record_batch([*b.columns, decoded], [*b.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return map_batches(encoded, run, f"{schema}, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """The digest columns of ``op7_byte_bpe``."""
    return decoded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
