"""Token-ID files with directly addressable codes (Brisaboa, Ladra, Navarro 2009).

An id is cut into chunks of WIDTHS bits. Level 0 holds the lowest chunk of every id; a bit of its continuation bitmap
says whether the id goes on, and if so its next chunk stands at level 1 at the place that the rank of that bit gives,
and so on. A rank directory (set bits before each block of 512) makes a rank one lookup and one popcount, so any token is
read from as many places as it has chunks, without decoding a block around it.

A file holds documents in ascending key order, in segments of at most SEGMENT tokens, each an own set of levels:

    magic "DACIDS01"
    segment: for each level: chunks (1 or 2 bytes each), bitmap (padded to 64 bytes), rank directory (unsigned 64-bit);
             then the token offset of each document that begins in it, and the documents' keys
    footer:  JSON with the place of every section, then its length (unsigned 64-bit) and the magic again

All numbers are little-endian. Files are written under a name of their own attempt and renamed, so a repeated task
replaces its file with an equal one. One file per partition of a range partitioning by key; a manifest of a row per file
gives the tokens before each file by a running sum.

Defined results: null and empty texts have only the end id; rows of one key are ordered by text; null keys come first;
an empty table gives no files and an empty result; only the key and text columns are read, so others cannot clash.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideframe.llm import common

TOKENIZER, END = public_tokenizers.path("word_bpe_49k.json"), 2
WIDTHS = (8, 8, 16)
SEGMENT = 1 << 22
BLOCK = 512
MAGIC = b"DACIDS01"
#: Words that a generation of a worker's cache holds, and the longest word it keeps.
CACHE_ENTRIES, CACHE_BYTES = 450_000, 64


def encode_levels(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap bytes, rank directory) of each level that some id reaches."""
    rest, out = ids.astype(np.uint64), []
    for level, width in enumerate(widths):
        chunks = (rest & np.uint64((1 << width) - 1)).astype(np.uint8 if width <= 8 else np.uint16)
        rest = rest >> np.uint64(width)
        more = rest > 0
        if more.any() and level + 1 == len(widths):
            raise ValueError(f"an id needs more than {sum(widths)} bits")
        bits = np.packbits(np.concatenate([more, np.zeros(-len(more) % BLOCK, bool)]), bitorder="little")
        per_block = np.bitwise_count(bits.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint64)
        out.append((chunks, bits, np.concatenate([[0], np.cumsum(per_block)]).astype(np.uint64)))
        rest = rest[more]
        if not len(rest):
            break
    return out


class Segment:
    """Random access to the ids of one segment, given its levels as arrays over the file's bytes."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], widths: tuple[int, ...]):
        self.levels, self.widths = levels, widths

    def __getitem__(self, i: int) -> int:
        """One id, from one chunk a level and one rank between levels."""
        value, shift = 0, 0
        for (chunks, bits, ranks), width in zip(self.levels, self.widths, strict=False):
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // BLOCK
            head = bits[block * BLOCK // 8 : (i >> 3) + 1].copy()
            head[-1] &= (1 << (i & 7)) - 1
            i, shift = int(ranks[block]) + int(np.bitwise_count(head).sum()), shift + width
        raise ValueError("corrupt segment: a last chunk continues")

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop, as unsigned 32-bit integers."""
        out, at, shift = np.zeros(stop - start, np.uint32), np.arange(stop - start), 0
        for (chunks, bits, ranks), width in zip(self.levels, self.widths, strict=False):
            out[at] |= chunks[start:stop].astype(np.uint32) << np.uint32(shift)
            lo = start // BLOCK * BLOCK
            window = np.unpackbits(bits[lo // 8 : -(-stop // 8)], bitorder="little")
            more = window[start - lo : stop - lo].astype(bool)
            if not more.any():
                break
            first = int(ranks[lo // BLOCK]) + int(window[: start - lo].sum())
            at, start, stop, shift = at[more], first, first + int(more.sum()), shift + width
        return out


class Writer:
    """Builds one file from documents that come in order."""

    def __init__(self, widths: tuple[int, ...] = WIDTHS, segment: int = SEGMENT):
        self.parts, self.size, self.widths, self.limit = [MAGIC], len(MAGIC), widths, segment
        self.segments, self.held, self.held_n, self.offsets, self.keys = [], [], 0, [], []
        self.n_tokens = self.n_docs = 0

    def _put(self, data: bytes) -> list[int]:
        pad = -self.size % 8
        self.parts += [b"\0" * pad, data]
        at = [self.size + pad, len(data)]
        self.size += pad + len(data)
        return at

    def add(self, key: int | None, ids: np.ndarray) -> None:
        """A document's ids; one longer than a segment goes on in the next."""
        self.offsets.append(self.held_n)
        self.keys.append(key)
        self.n_docs += 1
        self.n_tokens += len(ids)
        while self.held_n + len(ids) > self.limit:
            room = self.limit - self.held_n
            self.held.append(ids[:room])
            self.held_n += room
            self._flush()
            ids = ids[room:]
        self.held.append(ids)
        self.held_n += len(ids)

    def _flush(self) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        levels = [[self._put(part.tobytes()) for part in level] for level in encode_levels(ids, self.widths)]
        keys = np.array([0 if k is None else k for k in self.keys], np.int64)
        null = np.array([k is None for k in self.keys], np.uint8)
        sections = [self._put(x.tobytes()) for x in (np.array(self.offsets, np.uint64), keys, null)]
        self.segments.append({"n": len(ids), "docs": len(self.keys), "levels": levels, "offsets": sections[0], "keys": sections[1], "null": sections[2]})
        self.held, self.held_n, self.offsets, self.keys = [], 0, [], []

    def finish(self) -> bytes:
        self._flush()
        footer = json.dumps({"widths": self.widths, "tokens": self.n_tokens, "docs": self.n_docs, "segments": self.segments}).encode()
        return b"".join([*self.parts, footer, struct.pack("<Q", len(footer)), MAGIC])


class Reader:
    """Opens a file's bytes; reads any token or document."""

    def __init__(self, data: bytes | memoryview):
        view = memoryview(data)
        if bytes(view[: len(MAGIC)]) != MAGIC or bytes(view[-len(MAGIC) :]) != MAGIC:
            raise ValueError("not a token file")
        (length,) = struct.unpack("<Q", view[-8 - len(MAGIC) : -len(MAGIC)])
        self.meta = json.loads(bytes(view[-8 - len(MAGIC) - length : -8 - len(MAGIC)]))
        arr = lambda at, kind: np.frombuffer(view[at[0] : at[0] + at[1]], kind)
        self.segments, self.starts, docs, self.keys = [], [0], [], []
        for s in self.meta["segments"]:
            levels = [(arr(c, np.uint8 if w <= 8 else np.uint16), arr(b, np.uint8), arr(r, np.uint64)) for (c, b, r), w in zip(s["levels"], self.meta["widths"], strict=False)]
            self.segments.append(Segment(levels, tuple(self.meta["widths"])))
            docs.append(arr(s["offsets"], np.uint64).astype(np.int64) + self.starts[-1])
            self.keys += [None if z else int(k) for k, z in zip(arr(s["keys"], np.int64), arr(s["null"], np.uint8), strict=True)]
            self.starts.append(self.starts[-1] + s["n"])
        self.docs = np.concatenate([*docs, [self.starts[-1]]])

    def __len__(self) -> int:
        return self.starts[-1]

    def token(self, i: int) -> int:
        s = int(np.searchsorted(self.starts, i, "right")) - 1
        return self.segments[s][i - self.starts[s]]

    def slice(self, start: int, stop: int) -> np.ndarray:
        s, out = int(np.searchsorted(self.starts, start, "right")) - 1, []
        while start < stop:
            upto = min(stop, self.starts[s + 1])
            out.append(self.segments[s].slice(start - self.starts[s], upto - self.starts[s]))
            start, s = upto, s + 1
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def document(self, d: int) -> np.ndarray:
        return self.slice(int(self.docs[d]), int(self.docs[d + 1]))


#: A comma or full stop that ends a word of ASCII: a token of its own, so that the word is the same with and without.
_STOP = re.compile(rb"([A-Za-z0-9])([.,])(?=[ \n])").sub
#: Bytes of ASCII and of U+00C0 to U+00FF, which are letters but for two signs.
_LATIN = bytes([*range(0x80), 0xC3, *range(0x80, 0xC0)])
#: Bytes by kind: space, comma or full stop, other ASCII sign, or part of a word.
_KINDS = bytes(0x20 if b in b" \t\n\x0b\x0c\r" else 0x2E if b in b".," else 0x61 if b >= 0x80 or chr(b).isalnum() else 0x21 for b in range(256))


def prepared(text: str) -> bytes:
    """A text whose parts between ASCII spaces have the ids of the whole: A-Z lower-cased as the tokenizer does, stops
    that end a word apart from it.

    Texts with the first sign of a special token, or with a combining mark that could join a letter (bytes CC and CD
    begin those), stay as they are. Where signs can only follow letters, stops are cut off by plain replacement.
    """
    data = text.encode()
    if b"<|" in data or b"\xcc" in data or b"\xcd" in data:
        return data
    data = data.lower()
    kinds = data.translate(_KINDS)
    if b"!. " in kinds or b".. " in kinds or data.translate(None, _LATIN) or b"\xc3\x97" in data or b"\xc3\xb7" in data:
        return _STOP(rb"\1 \2", data)
    return data.replace(b". ", b" . ").replace(b", ", b" , ").replace(b".\n", b" .\n").replace(b",\n", b" ,\n")


#: Words of a-z and the lower-case letters U+00DF to U+00FF, which no normalisation changes and no pattern splits.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch


class WordEncoder:
    """Ids of the tokenizers library's file, word by word: it drops white space and no token spans it, so the ids of a
    text are those of its pieces between ASCII spaces. Pieces recur, so their ids are kept in a cache of two generations,
    each bounded. New plain words are encoded many at a time by the same model without its normaliser and pattern, which
    leave them as they are; the token that ends a word has the model's suffix. Other new pieces are encoded one by one."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.young, self.old = Tokenizer.from_file(path), {}, {}
        self.suffix, self.bare = getattr(self.tokenizer.model, "end_of_word_suffix", None), None
        if self.suffix:
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer = normalizers.Sequence([])
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(self.suffix)]] = True

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        plain = [w for w in words if _PLAIN(w)] if self.bare else []
        found = {}
        for start in range(0, len(plain), 4096):
            some = plain[start : start + 4096]
            parts = [some[i : i + 256] for i in range(0, len(some), 256)]
            encoded = self.bare.encode_batch_fast([b" ".join(part).decode() for part in parts], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in encoded])
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) != len(some):
                raise ValueError("the tokenizer does not end each word by its suffix")
            packed, at = ids.tobytes(), 0
            for w, end in zip(some, ends.tolist(), strict=True):
                found[w] = packed[at:end]
                at = end
        rest = [w for w in words if w not in found]
        single = self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)
        return found | {w: np.array(e.ids, np.uint32).tobytes() for w, e in zip(rest, single, strict=True)}

    def encode_texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers. Distinct pieces are told apart and looked up once a call."""
        words = pc.ascii_split_whitespace(pa.array([prepared(t or "") for t in texts], pa.large_string()))
        coded = words.values.dictionary_encode()
        distinct, which = coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        known = list(map(self.young.get, distinct))
        new = [w for w, ids in zip(distinct, known, strict=True) if ids is None]
        again = {w: self.old[w] for w in new if w in self.old}
        learnt = self._learn([w for w in new if w not in again and w])
        fresh = again | learnt | {b"": b""}
        known = [fresh[w] if ids is None else ids for w, ids in zip(distinct, known, strict=True)]
        self.young |= again
        self.young |= {w: ids for w, ids in learnt.items() if len(w) <= CACHE_BYTES}
        if len(self.young) >= CACHE_ENTRIES:
            self.young, self.old = {}, self.young
        # the ids of all pieces in a row, then those of each place by its piece
        pool, sizes = np.frombuffer(b"".join(known), np.uint32), np.fromiter(map(len, known), np.int64, len(known)) // 4
        first = np.cumsum(sizes) - sizes
        size = sizes[which]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = pool[np.repeat(first[which] - ends[:-1], size) + np.arange(ends[-1])]
        at = ends[words.offsets.to_numpy(zero_copy_only=False) - words.offsets[0].as_py()]
        return [ids[at[k] : at[k + 1]] for k in range(len(texts))]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_texts([text])[0]


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end: int | None = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write every row's ids, with the end id after each, into folder; returns the manifest (shard, file, docs, tokens, before)."""
    common.with_workers(docs.sparkSession)
    tail = np.array([] if end is None else [end], np.uint32)

    def run(batches):
        own, out = encoder(tokenizer), Writer()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                for k, ids in zip(part.column(0).to_pylist(), own.encode_texts(part.column(1).to_pylist()), strict=True):
                    out.add(k, np.concatenate([ids, tail]))
        if not out.n_docs:
            return
        shard = TaskContext.get().partitionId()
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name, attempt = f"shard-{shard:06d}.dac", f"{base}/_attempt-{uuid.uuid4().hex}"
        with fs.open_output_stream(attempt) as f:
            f.write(out.finish())
        fs.move(attempt, f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name], "docs": [out.n_docs], "tokens": [out.n_tokens]})

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    ordered = rows.repartitionByRange("key").sortWithinPartitions(F.col("key").asc_nulls_first(), F.col("text").asc_nulls_first())
    written = common.settle(ordered.mapInArrow(run, "shard long, file string, docs long, tokens long"), "token-manifest")
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return written.withColumn("before", before)


def read(manifest: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, start, ids binary) of every document in the files: start counts the ids of all documents before it."""
    common.with_workers(manifest.sparkSession)

    def run(batches):
        fs, base = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{base}/{name}") as f:
                    own = Reader(f.read_buffer())
                for first in range(0, len(own.keys), 256):
                    some = range(first, min(first + 256, len(own.keys)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([own.keys[d] for d in some], pa.int64()),
                            pa.array([before + int(own.docs[d]) for d in some], pa.int64()),
                            pa.array([own.document(d).astype("<u4").tobytes() for d in some], pa.binary()),
                        ],
                        names=["key", "start", "ids"],
                    )

    spread = manifest.select("file", "before").repartition(max(1, manifest.count()), "file")
    return spread.mapInArrow(run, "key long, start long, ids binary").withColumnRenamed("key", key)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{common.shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    manifest = write(common.table(spark, sf_dir, "documents"), folder)
    return read(manifest, folder).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def crc(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
