"""Token ids in raw binary shards, with a minimal perfect hash index over the documents' keys.

A shard is one file: the ids of its documents one after another (two bytes each where the vocabulary allows, else four,
little-endian), then the documents' offsets in ids (8 bytes each, one more than there are documents), then a trailer of the
number of documents, the number of ids and the width. Shards follow each other in ascending order of the key (null first;
equal keys by their text), so the documents of one key are neighbours, even across shards.

The index is dealt into buckets by a hash of the key. A bucket has a minimal perfect hash of levels of bits: a key is at
home on the first level where no other key that is still without a place falls on its bit; the number of set bits before it
is its slot. The record of the slot has a 64-bit fingerprint of the key and the place of the key's first and last document,
so one key takes a constant number of small reads, and a key that isn't stored is told by its fingerprint (it passes for
another with a chance of 2^-64).

Each task writes files under names of its own attempt; what counts is the log of names, which Spark commits once for each
task. A lost executor leaves files that no log names, and the task that runs again writes its own. Files are opened with
pyarrow's file systems (local, hdfs, s3, gs), as Spark has no writer for raw bytes.

Defined results: a null text counts as empty and still has its end id; null keys are a key of their own; repeated rows are
stored each; an empty table gives no shard, no bucket and no row. Other columns of the table are ignored. A text is encoded
whole, whatever its length.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import uuid
from array import array
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import row_blocks, shared_dir, stash, text_bytes, trimmed

#: Ids of a shard before the next one begins, keys of a bucket; bytes of payload that are read, and of texts that are encoded at once.
SHARD_IDS, BUCKET_KEYS, BLOCK, TEXTS = 16_000_000, 4096, 8 << 20, 2 << 20
TRAILER = "<QQI8s"
MAGIC = b"idshard1"
RECORD = np.dtype([("print", "<u8"), ("first_no", "<i8"), ("first_row", "<i8"), ("last_no", "<i8"), ("last_row", "<i8")])


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path of a folder; a plain path or ``file:`` is local."""
    if re.match(r"file:|/", uri):
        return pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


# ---- encoding --------------------------------------------------------------------------------------------------------

_SPACE_AFTER_SPACE, _CUT = re.compile(r"\s "), re.compile(r"(?<=\S)(?= )")


def _splits_at_spaces(path: str) -> bool:
    """Whether a tokenizer is byte-level with the usual splitting, so that it always parts a text before a space behind a
    character that isn't white space."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    pre = t.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not t.get("normalizer")
    return plain and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"\s", a["content"]) for a in t["added_tokens"])


#: Letters of Latin scripts and then ASCII marks without the apostrophe: the tokenizer parts them where the letters end, and a
#: space with letters behind it is one word to it.
_WORD = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]*)")

#: A line's end between characters that aren't white space is a word of its own to it.
_LINE = re.compile(r"(?<=\S)\n(?=\S)")


def _byte_names() -> dict[int, str]:
    """How byte-level tokenizers write bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Known(dict):
    """The ids of pieces as bytes, learned when first asked for. Long pieces, and those there is no room for, are kept in
    ``extra``."""

    def __init__(self, learn, room: int) -> None:
        self.learn, self.room, self.extra = learn, room, {}

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.extra.get(piece)) is None:
            ids = self.learn(piece)
            (self if len(piece) <= 64 and len(self) < self.room else self.extra)[piece] = ids
        return ids


class Encoder:
    """The ids of whole texts as bytes, each followed by ``end_id``.

    Where the tokenizer parts every text before a space that follows a character other than white space, the text is cut
    there, and pieces are looked up among those seen before (the first ``remember`` different ones of a worker); the
    library's model encodes a single word, and the library any other piece. The ids are those of the whole text. Other
    tokenizers get the text in one piece."""

    def __init__(self, path: str, end_id: int, remember: int = 1_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library, self.pieces = Tokenizer.from_file(path), _splits_at_spaces(path)
        self.kind = np.dtype("<u2" if max(self.library.get_vocab_size(), end_id + 1) <= 65536 else "<u4")
        self.end = np.array([end_id], self.kind).tobytes()
        #: by whether a space stands before the piece
        self.known = {spaced: _Known(partial(self._piece, spaced=spaced), remember) for spaced in (False, True)}
        self.model, self.names = self.library.model, _byte_names()

    def _bytes(self, ids: list[int]) -> bytes:
        out = array("H" if self.kind.itemsize == 2 else "I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _library(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 5000):
            out += [self._bytes(e.ids) for e in self.library.encode_batch(texts[i : i + 5000], add_special_tokens=False)]
        return out

    def _word(self, letters: str, space: str = "") -> bytes:
        raw = space + (letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.names))
        return self._bytes([t.id for t in self.model.tokenize(raw)])

    def _piece(self, piece: str, spaced: bool = False) -> bytes:
        space = self.names[32] if spaced else ""
        if piece.isascii() and piece.isalpha():
            return self._word(piece, space)
        if m := _WORD.fullmatch(piece):
            return (self.known[spaced].get(m[1]) or self._word(m[1], space)) + (self.known[False][m[2]] if m[2] else b"")
        head, *lines = _LINE.split(piece)
        if lines:
            plain = self.known[False]
            return self.known[spaced][head] + b"".join(plain["\n"] + plain[x] for x in lines)
        return self._bytes(self.library.encode(f" {piece}" if spaced else piece, add_special_tokens=False).ids)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.pieces:
            return [x + self.end for x in self._library(texts)]
        first, then, out = self.known[False], self.known[True].__getitem__, []
        for t in texts:
            if _SPACE_AFTER_SPACE.search(t):
                head, *rest = _CUT.split(t)
                rest = [x[1:] for x in rest]
            else:
                head, *rest = t.split(" ")
            out.append(b"".join((first[head], *map(then, rest), self.end)))
        for known in self.known.values():
            known.extra.clear()
        return out


@cache
def encoder(path: str, end_id: int) -> Encoder:
    """A worker's encoder; what it remembers serves all tasks that the worker runs."""
    return Encoder(path, end_id)


# ---- shards ----------------------------------------------------------------------------------------------------------


class _Shard:
    def __init__(self, fs: pafs.FileSystem, base: str, number: int) -> None:
        self.name, self.offsets = f"shard-{number:016x}-{uuid.uuid4().hex}.bin", array("Q", [0])
        self.out = fs.open_output_stream(f"{base}/{self.name}")

    def add(self, ids: bytes, width: int) -> None:
        self.out.write(ids)
        self.offsets.append(self.offsets[-1] + len(ids) // width)

    def close(self, width: int) -> tuple[int, int]:
        docs, ids = len(self.offsets) - 1, self.offsets[-1]
        self.out.write(np.frombuffer(self.offsets, np.uint64).astype("<u8").tobytes())
        self.out.write(struct.pack(TRAILER, docs, ids, width, MAGIC))
        self.out.close()
        return docs, ids


_LOG = pa.schema([("key", pa.int64()), ("shard", pa.int64()), ("first_row", pa.int64()), ("last_row", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("file", pa.string())])


def _write(folder: str, tokenizer: str, end_id: int, shard_ids: int):
    """Writes a partition's documents; says where the documents of each key are, and which files it has written."""

    def run(batches):
        encode, part, rolls = encoder(tokenizer, end_id), TaskContext.get().partitionId(), 0
        fs, base = filesystem(folder)
        width, shard, log, key, since = encode.kind.itemsize, None, [], None, None

        def end_run():
            if since is not None:
                log.append((key, number, since, len(shard.offsets) - 2, None, None, None))

        for b in batches:
            keys, (raw, off) = b.column(0).to_pylist(), text_bytes(b.column(1))
            for i, j in row_blocks(off, TEXTS):
                texts = [raw[off[k] : off[k + 1]].tobytes().decode() for k in range(i, j)]
                for own, ids in zip(keys[i:j], encode(texts), strict=True):
                    if shard is not None and shard.offsets[-1] >= shard_ids:
                        end_run()
                        log.append((None, number, None, None, *shard.close(width), shard.name))
                        shard, since = None, None
                    if shard is None:
                        fs.create_dir(base, recursive=True)
                        number, rolls = (part << 24) + rolls, rolls + 1
                        shard = _Shard(fs, base, number)
                    if since is None or own != key:
                        end_run()
                        key, since = own, len(shard.offsets) - 1
                    shard.add(ids, width)
                if len(log) > 50_000:
                    yield pa.RecordBatch.from_pylist([dict(zip(_LOG.names, r, strict=True)) for r in log], _LOG)
                    log.clear()
        end_run()
        if shard is not None:
            log.append((None, number, None, None, *shard.close(width), shard.name))
        yield pa.RecordBatch.from_pylist([dict(zip(_LOG.names, r, strict=True)) for r in log], _LOG)

    return trimmed(run)


# ---- minimal perfect hash --------------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bit(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    turn = np.uint64(((level + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1))
    return (_mix(h1 + turn) ^ _mix(h2 ^ turn)) % np.uint64(size)


def perfect_hash(h1: np.ndarray, h2: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The levels of bits (as 64-bit words) for different pairs of hashes, and the slot of each pair, 0 to n-1."""
    levels, at, slot, before = [], np.arange(len(h1)), np.zeros(len(h1), np.int64), 0
    while len(at):
        if len(levels) == 64:
            raise ValueError("keys with equal 128-bit hashes")
        size = max(64, -(-2 * len(at) // 64) * 64)
        bit = _bit(h1[at], h2[at], len(levels), size).astype(np.int64)
        alone = np.bincount(bit, minlength=size)[bit] == 1
        bits = np.zeros(size, np.uint8)
        bits[bit[alone]] = 1
        slot[at[alone]] = before + np.cumsum(bits)[bit[alone]] - 1
        levels.append(np.packbits(bits, bitorder="little").view("<u8"))
        before += int(alone.sum())
        at = at[~alone]
    return levels, slot


def pack_bucket(h1: np.ndarray, h2: np.ndarray, places: np.ndarray) -> bytes:
    """One bucket as bytes: number of keys and levels, words of each level, then words, ranks before each word, records."""
    levels, slot = perfect_hash(h1, h2)
    words = np.concatenate(levels) if levels else np.zeros(0, "<u8")
    ranks = (np.cumsum(np.bitwise_count(words), dtype=np.uint64) - np.bitwise_count(words)).astype("<u8")
    records = np.zeros(len(h1), RECORD)
    records["print"][slot] = h2
    for name, column in zip(RECORD.names[1:], places, strict=True):
        records[name][slot] = column
    head = np.array([len(h1), len(levels), *map(len, levels)], "<u8")
    return b"".join(x.tobytes() for x in (head, words, ranks, records))


def find(bucket: bytes, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the asked keys a bucket holds, and the records of those."""
    n, count = np.frombuffer(bucket, "<u8", 2).astype(int)
    sizes = np.frombuffer(bucket, "<u8", count, 16).astype(np.int64)
    total, at = int(sizes.sum()), 16 + 8 * count
    words, ranks = np.frombuffer(bucket, "<u8", total, at), np.frombuffer(bucket, "<u8", total, at + 8 * total)
    records = np.frombuffer(bucket, RECORD, n, at + 16 * total)
    slot, first = np.full(len(h1), -1, np.int64), 0
    for level, size in enumerate(sizes):
        open_ = np.flatnonzero(slot < 0)
        bit = _bit(h1[open_], h2[open_], level, 64 * int(size)).astype(np.int64)
        word, low = words[first + bit // 64], (bit % 64).astype(np.uint64)
        on = (word >> low) & np.uint64(1) == 1
        below = np.bitwise_count(word & ((np.uint64(1) << low) - np.uint64(1)))
        slot[open_[on]] = (ranks[first + bit // 64] + below)[on].astype(np.int64)
        first += int(size)
    held = slot >= 0
    held[held] = records["print"][slot[held]] == h2[held]
    return held, records[slot[held]]


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _runs(batches, name: str):
    """Rows of a sorted column that are equal, as tables; a run that ends a batch goes on in the next one."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        value = b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
        if not len(value):
            continue
        ends = [*(np.flatnonzero(value[1:] != value[:-1]) + 1), len(value)]
        if rest and rest[0].column(b.schema.get_field_index(name))[0].as_py() != value[0]:
            yield pa.Table.from_batches(rest).combine_chunks()
            rest = []
        i = 0
        for j in ends:
            rest.append(b.slice(i, j - i))
            if j < len(value):
                yield pa.Table.from_batches(rest).combine_chunks()
                rest = []
            i = j
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def _build(folder: str):
    def run(batches):
        fs, base = filesystem(folder)
        name, out, rows, at = f"index-{uuid.uuid4().hex}.bin", None, [], 0
        for t in _runs(batches, "bucket"):
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}")
            places = [t[c].to_numpy() for c in RECORD.names[1:]]
            packed = pack_bucket(_unsigned(t["h1"]), _unsigned(t["h2"]), places)
            out.write(packed)
            rows.append({"bucket": t["bucket"][0].as_py(), "index_file": name, "at": at, "length": len(packed)})
            at += len(packed)
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("bucket", pa.int64()), ("index_file", pa.string()), ("at", pa.int64()), ("length", pa.int64())]))

    return trimmed(run)


def _locate(folder: str):
    names = list(RECORD.names[1:])

    def run(batches):
        fs, base = filesystem(folder)
        name, file = None, None
        for t in _runs(batches, "bucket"):
            if t["index_file"][0].as_py() != name:
                name = t["index_file"][0].as_py()
                file = fs.open_input_file(f"{base}/{name}")
            bucket = file.read_at(t["length"][0].as_py(), t["at"][0].as_py())
            held, found = find(bucket, _unsigned(t["h1"]), _unsigned(t["h2"]))
            keys = t["key"].combine_chunks().filter(pa.array(held))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(found[c].astype(np.int64)) for c in names)], ["key", *names])

    return trimmed(run)


def _read(folder: str):
    """Documents of runs of rows of a shard; neighbouring rows are read at once."""
    names = ["key", "start", "n_tokens", "ids"]

    def run(batches):
        fs, base = filesystem(folder)
        for t in _runs(batches, "no"):
            file = fs.open_input_file(f"{base}/{t['file'][0].as_py()}")
            size = file.size()
            docs, ids, width, magic = struct.unpack(TRAILER, file.read_at(28, size - 28))
            if magic != MAGIC:
                raise ValueError(f"not a shard: {t['file'][0].as_py()}")
            off = np.frombuffer(file.read_at(8 * (docs + 1), width * ids), "<u8").astype(np.int64)
            first, last, begin = t["a"].to_numpy(), t["b"].to_numpy(), t["start"][0].as_py()
            n = last - first + 1
            rows = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            keys = t["key"].combine_chunks().take(pa.array(np.repeat(np.arange(len(n)), n)))
            i = 0
            while i < len(rows):
                # as many neighbours as a block holds, one document at least
                j = i + 1
                while j < len(rows) and rows[j] == rows[j - 1] + 1 and width * (off[rows[j] + 1] - off[rows[i]]) <= BLOCK:
                    j += 1
                lo, hi = off[rows[i]], off[rows[j - 1] + 1]
                payload = np.frombuffer(file.read_at(int(width * (hi - lo)), int(width * lo)), f"<u{width}").astype("<u4")
                cuts = off[rows[i] : rows[j - 1] + 2] - lo
                values = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((4 * cuts).astype(np.int32)), pa.py_buffer(payload)])
                yield pa.RecordBatch.from_arrays([keys[i:j], pa.array(begin + lo + cuts[:-1]), pa.array(np.diff(cuts)), values], names)
                i = j

    return trimmed(run)


# ---- the store -------------------------------------------------------------------------------------------------------


def _hashed(keys: DataFrame, buckets: int) -> DataFrame:
    name: Column = F.when(F.col("key").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("key").cast("string")))
    out = keys.withColumns({"h1": F.xxhash64(name), "h2": F.xxhash64(F.lit("print"), name)})
    return out.withColumn("bucket", F.pmod("h1", F.lit(buckets)))


@dataclass
class TokenStore:
    """Shards and index of a table: ``shards`` has one row for each file, ``index`` one for each bucket."""

    folder: str
    shards: DataFrame
    index: DataFrame
    buckets: int

    def locate(self, keys: DataFrame) -> DataFrame:
        """(key, place of its first and of its last document) of the keys that are stored; ``keys`` has a column key."""
        asked = _hashed(keys.select(F.col("key").cast("long").alias("key")).distinct(), self.buckets).join(self.index, "bucket")
        places = ", ".join(f"{c} long" for c in RECORD.names[1:])
        return asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_locate(self.folder), f"key long, {places}")

    def fetch(self, keys: DataFrame) -> DataFrame:
        """(key, start, n_tokens, ids) of every stored document with one of the keys; ids are little-endian 32-bit numbers,
        start counts the ids of all documents before it."""
        spans = self.locate(keys).withColumn("no", F.explode(F.sequence("first_no", "last_no"))).join(self.shards, "no")
        a = F.when(F.col("no") == F.col("first_no"), F.col("first_row")).otherwise(F.lit(0))
        b = F.when(F.col("no") == F.col("last_no"), F.col("last_row")).otherwise(F.col("n_docs") - 1)
        runs = spans.select("key", "no", "file", "start", a.alias("a"), b.alias("b"))
        return runs.repartition("no").sortWithinPartitions("no", "a").mapInArrow(_read(self.folder), "key long, start long, n_tokens long, ids binary")


def write_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS, bucket_keys: int = BUCKET_KEYS) -> TokenStore:
    """Encodes every text, writes the shards in ascending order of the key, and builds the index.

    The texts are shuffled once, by ranges of (key, hash of the text, place in the input), so that even a key with a third
    of all rows is split over tasks. What passes a single ordering is one row for each shard."""
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "nth": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first("key"), F.asc("h"), F.asc("nth")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    schema = "key long, shard long, first_row long, last_row long, n_docs long, n_ids long, file string"
    log = stash(dealt.mapInArrow(_write(folder, tokenizer, end_id, shard_ids), schema), "tokens-log")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    numbered = log.filter("file is not null").select(
        "shard", (F.row_number().over(Window.orderBy("shard")) - 1).cast("long").alias("no"), "file", "n_docs", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start")
    )
    shards = stash(numbered, "tokens-shards")
    runs = log.filter("file is null").select("key", "shard", "first_row", "last_row").join(shards.select("shard", "no"), "shard")
    places = runs.groupBy("key").agg(F.min(F.struct("no", "first_row")).alias("a"), F.max(F.struct("no", "last_row")).alias("b"))
    buckets = max(1, -(-log.filter("file is null").count() // bucket_keys))
    keyed = _hashed(places.select("key", F.col("a.no").alias("first_no"), "a.first_row", F.col("b.no").alias("last_no"), "b.last_row"), buckets)
    index = keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_build(folder), "bucket long, index_file string, at long, length long")
    return TokenStore(folder, shards.drop("shard"), stash(index, "tokens-index"), buckets)
