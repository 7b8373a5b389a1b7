"""Byte-level BPE encoding and decoding through a sentencepiece model serialised straight from the rank file.

The rank file (base64 token, rank a line) becomes a sentencepiece ModelProto: each token's bytes, mapped one to one to
printable characters, are a piece whose score is the negative rank, and normalisation is the identity. sentencepiece
merges the adjacent pair of highest score, leftmost first, which is the merge of lowest rank, so encoding each match of
the splitting pattern by itself gives the ids of the rank file. Decoding maps each id back to its bytes.

Defined results: null text is encoded as the empty text (no ids, empty bytes); repeated rows are encoded each; other
columns are left out of encode() and decode() results, so their names cannot clash; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.llm import common
from tideframe.llm.shingles import slices

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Entries that a worker's cache of pre-tokens holds before it starts anew, and the longest pre-token it keeps.
CACHE_ENTRIES, CACHE_CHARS = 1 << 17, 64


def byte_chars() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file by rank; ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks are not 0 to {len(pairs) - 1}")
    return [token for _, token in pairs]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n & (1 << 64) - 1)


def _blob(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def serialise(tokens: list[bytes]) -> bytes:
    """The sentencepiece ModelProto of a byte-level BPE vocabulary; piece 0 is the unknown one, piece r + 1 has rank r."""
    chars = byte_chars()

    def piece(text: str, score: float, kind: int) -> bytes:
        return _blob(1, _blob(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))

    pieces = [piece("<unk>", 0.0, 2)] + [piece("".join(chars[b] for b in t), -float(r), 1) for r, t in enumerate(tokens)]
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, 0) + b"".join(_number(f, -1) for f in (41, 42, 43))
    normalizer = _blob(1, b"identity") + b"".join(_number(f, 0) for f in (3, 4, 5))
    return b"".join(pieces) + _blob(2, trainer) + _blob(3, normalizer)


class Codec:
    """Encoder and decoder of one rank file. Pre-tokens recur, so their ids are kept in a bounded cache."""

    def __init__(self, path: str = RANKS, pattern: str = public_tokenizers.PATTERN):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.split = regex.compile(pattern).findall
        model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.tokens))
        chars = byte_chars()

        seen = common.Seen()

        class Cache(dict):
            def __missing__(self, text: str) -> bytes:
                ids = model.encode("".join([chars[b] for b in text.encode()]))
                packed = struct.pack(f"<{len(ids)}i", *[i - 1 for i in ids])
                if len(text) <= CACHE_CHARS and seen.before(text):
                    if len(self) >= CACHE_ENTRIES:
                        self.clear()
                    self[text] = packed
                return packed

        self.cache = Cache()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian signed 32-bit integers."""
        return b"".join(map(self.cache.__getitem__, self.split(text)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _id_lists(packed: list[bytes]) -> pa.Array:
    ends = [0]
    for p in packed:
        ends.append(ends[-1] + len(p) // 4)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(packed))]))


def encode(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(key, ids array<int>) of every row; with decoded, also the bytes that the ids decode to. A map over the input, without a shuffle."""
    common.with_workers(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        own = codec(path, pattern)
        for part in slices(batches, 1000, 1):
            packed = [own.encode(t or "") for t in part.column(1).to_pylist()]
            out = [part.column(0), _id_lists(packed)]
            if decoded:
                out.append(pa.array([own.decode(np.frombuffer(p, "<i4").tolist()) for p in packed], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=["key", "ids", "decoded"][: len(out)])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>" + ", decoded binary" * decoded).withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str = RANKS, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded binary) of every row of ids; null ids decode to empty bytes."""
    common.with_workers(encoded.sparkSession)
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches):
        own = codec(path, public_tokenizers.PATTERN)
        for part in slices(batches, 100):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([own.decode(x.as_py() or []) for x in part.column(1)], pa.binary())], names=["key", "decoded"])

    return encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, decoded binary").withColumnRenamed("key", key)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded, and its ids decoded again: counts and digests."""
    both = encode(common.table(spark, sf_dir, "documents"), decoded=True)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
