"""Token ids in binary shards, reached by key through a minimal perfect hash index.

Payload: documents in ascending order of their key are cut into ranges; a range is written as one or more files of about
SHARD_BYTES, while it is encoded: the raw ids (little-endian, two bytes where
the vocabulary allows it, else four), the number of ids before each document, and a footer. Index: keys are dealt by hash into
buckets; each bucket is one file that holds a minimal perfect hash function (levels of bit arrays: a key belongs to the first
level where no other key of the bucket falls on its bit; its slot is the number of set bits before it, counted per block of
bits) and, per slot, a fingerprint of the key and where its segments are listed: runs of rows of one file. A look-up of one
key reads a header, a block of 64 bytes for each level it tries, a slot, a segment, two offsets and the ids: the same few small
reads whatever the number of documents. Look-ups of many keys read whole index files, and ranges of the payload.

Files are written under a name of their own try and renamed when whole, so a task may be lost or
run twice. Null text is the empty text (the end id alone). A null key is a key like others and comes
first. Rows that repeat a key are stored one after the other, possibly over several ranges, and all returned by a look-up. An
empty table writes no file, and look-ups find nothing. An id that doesn't fit the width is an error. Other columns aren't
stored."""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from ..session import map_arrow
from .common import by_group, cut, lookup_join, new_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Bytes of ids in a payload file, and of text that a range stands for; keys of an index file.
SHARD_BYTES, BUCKET_KEYS = 32 << 20, 1 << 20
#: Greatest number of ranges, and of files in one: the number of a file is range * FILES + its place.
MAX_RANGES, FILES = 20_000, 1 << 20
MAGIC = b"LOOMIDS2"
_U = np.uint64


class _Writer:
    """A file that appears under its name when it is closed."""

    def __init__(self, folder: str, name: str) -> None:
        self.at, path = fs.FileSystem.from_uri(folder)
        self.at.create_dir(path, recursive=True)
        self.own, self.name = f"{path}/.{name}.{uuid.uuid4().hex}", f"{path}/{name}"
        self.out = self.at.open_output_stream(self.own)
        self.write = self.out.write

    def close(self) -> None:
        self.out.close()
        try:
            self.at.move(self.own, self.name)
        except OSError:  # some stores don't replace: another try of this task was first, with the same rows
            if self.at.get_file_info(self.name).type != fs.FileType.File:
                raise
            self.at.delete_file(self.own)


def _put(folder: str, name: str, parts: list[bytes]) -> None:
    out = _Writer(folder, name)
    for p in parts:
        out.write(p)
    out.close()


class _Reader:
    """Ranges of a file; `bytes` counts what was read."""

    def __init__(self, folder: str, name: str) -> None:
        at, path = fs.FileSystem.from_uri(folder)
        self.file = at.open_input_file(f"{path}/{name}")
        self.size, self.bytes = self.file.size(), 0

    def range(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        self.bytes += n
        return self.file.read_at(n, at)

    def array(self, at: int, n: int, kind) -> np.ndarray:
        return np.frombuffer(self.range(at, n * np.dtype(kind).itemsize), kind)


def _get(folder: str, name: str) -> bytes:
    f = _Reader(folder, name)
    return f.range(0, f.size)


# --- minimal perfect hashing ---


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def hash_keys(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each key (integers or strings; null is a key of its own)."""
    if pa.types.is_integer(keys.type):
        x = keys.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).view(_U)
    else:
        import xxhash

        x = np.array([xxhash.xxh64_intdigest(str(k)) for k in keys.to_pylist()], _U)
    x = np.where(keys.is_null().to_numpy(zero_copy_only=False), _mix(x + _U(0x9E3779B97F4A7C15)) ^ _U(1 << 63), x)
    return _mix(x + _U(0x9E3779B97F4A7C15)), _mix(x * _U(0xC2B2AE3D27D4EB4F) + _U(0x165667B19E3779F9))


class PerfectHash:
    """Levels of bits over distinct (h1, h2); slots 0 .. n-1 without gaps."""

    GAMMA = 2

    def __init__(self, sizes: np.ndarray, words: np.ndarray) -> None:
        self.sizes, self.words = sizes, words
        counts = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(counts) - counts
        self.base = np.cumsum(sizes) - sizes  # bits before each level

    @staticmethod
    def _bit(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_mix(h1 + _U(level + 1) * h2) % _U(size)).astype(np.int64)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(h1):
            size = -(-cls.GAMMA * len(h1) // 64) * 64
            bit = cls._bit(h1, h2, len(sizes), size)
            alone = np.bincount(bit, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little"))
            rest = ~alone[bit]
            h1, h2 = h1[rest], h2[rest]
            if len(sizes) > 200:
                raise ValueError("keys repeat")
        words = np.concatenate(levels).view("<u8").astype(_U) if levels else np.zeros(0, _U)
        return cls(np.array(sizes, np.int64), words)

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each key; -1, or a slot of another key, for keys that weren't there."""
        out, todo = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level, size in enumerate(self.sizes.tolist()):
            bit = self.base[level] + self._bit(h1[todo], h2[todo], level, size)
            word, shift = self.words[bit >> 6], (bit & 63).astype(_U)
            found = (word >> shift & _U(1)).astype(bool)
            below = np.bitwise_count(word & ((_U(1) << shift) - _U(1))).astype(np.int64)
            out[todo[found]] = (self.before[bit >> 6] + below)[found]
            todo = todo[~found]
            if not len(todo):
                break
        return out


#: What a slot holds: the key's fingerprint, how many segments it has, and the place of the first.
_SLOT = np.dtype([("print", "<u4"), ("segments", "<u4"), ("first", "<u8")])
_SEGMENT = np.dtype([("shard", "<u8"), ("row", "<u4"), ("rows", "<u4")])
#: Bits of a block: seven words, after the number of bits set before it.
_BLOCK = 7 * 64


def _print(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return ((h1 ^ (h2 >> _U(7))) >> _U(16)).astype("<u4")


def _bucket(h2: np.ndarray, n: int) -> np.ndarray:
    return ((h2 >> _U(32)) % _U(n)).astype(np.int32)


def _write_bucket(folder: str, bucket: int, h1, h2, segments: np.ndarray, shard, row, rows) -> None:
    """Keys (h1, h2) with the number of segments of each, and all segments in the order of the keys."""
    function = PerfectHash.build(h1, h2)
    table, listed = np.zeros(len(h1), _SLOT), np.zeros(len(shard), _SEGMENT)
    at = function.slots(h1, h2)
    for name, x in (("print", _print(h1, h2)), ("segments", segments), ("first", np.cumsum(segments) - segments)):
        table[name][at] = x
    for name, x in (("shard", shard), ("row", row), ("rows", rows)):
        listed[name] = x
    words = np.pad(function.words, (0, -len(function.words) % 7)).reshape(-1, 7)
    counts = np.bitwise_count(words).sum(1).astype(_U)
    blocks = np.column_stack([np.cumsum(counts) - counts, words]).astype("<u8")
    head = np.array([len(function.sizes), len(h1), len(blocks), *function.sizes], "<u8")
    _put(f"{folder}/index", f"{bucket:07d}.mph", [MAGIC, head.tobytes(), blocks.tobytes(), table.tobytes(), listed.tobytes()])


class Bucket:
    """One index file. `find` reads all of it once, for many keys; `find_one` a few ranges."""

    def __init__(self, folder: str, bucket: int) -> None:
        self.file = _Reader(f"{folder}/index", f"{bucket:07d}.mph")
        head = self.file.range(0, 2048)  # levels shrink, so there are some dozens of them
        if head[:8] != MAGIC:
            raise ValueError("not an index file")
        levels, self.keys, self.blocks = (int(x) for x in np.frombuffer(head[8:32], "<u8"))
        self.sizes = np.frombuffer(head[32 : 32 + 8 * levels], "<u8").astype(np.int64)
        self.blocks_at = 32 + 8 * levels
        self.slots_at = self.blocks_at + 64 * self.blocks
        self.segments_at = self.slots_at + _SLOT.itemsize * self.keys
        self.function = None

    def find(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the key of each segment that is there, and the segments."""
        if self.function is None:
            blocks = self.file.array(self.blocks_at, 8 * self.blocks, "<u8").reshape(-1, 8)
            self.function = PerfectHash(self.sizes, blocks[:, 1:].ravel().astype(_U))
            self.table = self.file.array(self.slots_at, self.keys, _SLOT)
            self.segments = self.file.array(self.segments_at, (self.file.size - self.segments_at) // _SEGMENT.itemsize, _SEGMENT)
        slot = self.function.slots(h1, h2)
        if not self.keys:
            return slot[:0], self.segments[:0]
        entries = self.table[np.maximum(slot, 0)]
        there = np.flatnonzero((slot >= 0) & (entries["print"] == _print(h1, h2)))
        n, first = entries["segments"][there].astype(np.int64), entries["first"][there].astype(np.int64)
        return np.repeat(there, n), bpe.gather(self.segments, first, n)

    def find_one(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The segments of one key; none if it isn't there."""
        base = 0
        for level, size in enumerate(self.sizes.tolist()):
            bit = base + int(PerfectHash._bit(h1, h2, level, size)[0])
            block = self.file.array(self.blocks_at + 64 * (bit // _BLOCK), 8, "<u8")
            word, shift = divmod(bit % _BLOCK, 64)
            if int(block[1 + word]) >> shift & 1:
                below = int(block[1 + word]) & ((1 << shift) - 1)
                slot = int(block[0]) + int(np.bitwise_count(block[1 : 1 + word]).sum()) + below.bit_count()
                entry = self.file.array(self.slots_at + _SLOT.itemsize * slot, 1, _SLOT)[0]
                if entry["print"] != _print(h1, h2)[0]:
                    break
                return self.file.array(self.segments_at + _SEGMENT.itemsize * int(entry["first"]), int(entry["segments"]), _SEGMENT)
            base += size
        return np.zeros(0, _SEGMENT)


class Shard:
    """One payload file, of which ranges are read."""

    def __init__(self, folder: str, shard: int) -> None:
        self.file = _Reader(f"{folder}/payload", _payload_name(shard))
        foot = self.file.range(self.file.size - 24, 24)
        if foot[16:] != MAGIC:
            raise ValueError("not a payload file")
        self.docs, self.width = int.from_bytes(foot[:8], "little"), int.from_bytes(foot[8:16], "little")
        self.offsets_at = self.file.size - 24 - 8 * (self.docs + 1)

    def rows(self, row: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of n rows, and the number of ids in the file before each of them and the next."""
        before = self.file.array(self.offsets_at + 8 * row, n + 1, "<u8").astype(np.int64)
        return self.file.array(int(before[0]) * self.width, int(before[-1] - before[0]), f"<u{self.width}"), before


def _payload_name(shard: int) -> str:
    return f"{shard // FILES:05d}-{shard % FILES:07d}.ids"


class _Payload:
    """Writes a range's documents, as one file after the other."""

    def __init__(self, folder: str, number: int, width: int) -> None:
        self.folder, self.shard, self.width, self.out = folder, number * FILES, width, None

    def add(self, flat: np.ndarray, n: np.ndarray) -> None:
        if len(flat) and int(flat.max()) >> 8 * self.width:
            raise ValueError(f"an id doesn't fit {self.width} bytes")
        if self.out is None:
            self.out, self.sizes, self.ids = _Writer(f"{self.folder}/payload", _payload_name(self.shard)), [np.zeros(1, np.int64)], 0
        self.out.write(flat.astype(f"<u{self.width}").tobytes())
        self.sizes.append(n)
        self.ids += len(flat)

    def full(self) -> bool:
        return self.out is not None and self.ids * self.width >= SHARD_BYTES

    def close(self) -> None:
        before = np.cumsum(np.concatenate(self.sizes))
        for part in (before.astype("<u8").tobytes(), (len(before) - 1).to_bytes(8, "little"), self.width.to_bytes(8, "little"), MAGIC):
            self.out.write(part)
        self.out.close()
        self.out, self.shard = None, self.shard + 1


# --- writing ---


class WholeTexts:
    """The ids of whole texts, as the tokenizers library gives them without special tokens of its own: tokens added to the
    vocabulary are cut out of a text first, and what lies between two of them is a text by itself. Texts that hold an added
    token with conditions (a single word, white space taken along) go to the library whole."""

    def __init__(self, encoder: bpe.Encoder, tokenizer) -> None:
        self.encoder, self.tokenizer = encoder, tokenizer
        added = tokenizer.get_added_tokens_decoder()
        longest = lambda kept: "|".join(map(re.escape, sorted((t.content for t in added.values() if kept(t)), key=len, reverse=True))) or r"(?!)"
        conditions = lambda t: t.single_word or t.lstrip or t.rstrip
        self.ids = {t.content: i for i, t in added.items()}
        self.cut, self.hard = re.compile(f"({longest(lambda t: True)})"), re.compile(longest(conditions))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, and their number for each text."""
        if not any(map(self.cut.search, texts)):
            return self.encoder.encode(texts)[:2]
        if any(map(self.hard.search, texts)):
            return bpe.flat_lists([self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts])
        parts = [self.cut.split(t) for t in texts]  # text, token, text, ..., text
        flat, n, _, _ = self.encoder.encode([x for p in parts for x in p[::2]])
        counts = np.array([len(p) // 2 + 1 for p in parts])
        last = np.cumsum(counts) - 1
        before_token = np.ones(len(n), bool)
        before_token[last] = False
        flat = np.insert(flat, np.cumsum(n)[before_token], [self.ids[x] for p in parts for x in p[1::2]])
        return flat, np.add.reduceat(n + before_token, last - counts + 1)


def _hf(path: str) -> WholeTexts:
    """An encoder whose slices are merged by the tokenizers library's model.

    The library itself maps a slice's bytes to the characters of its byte alphabet and hands them to
    its model; here the same is done for many new slices without its other steps. The alphabet is taken from
    the library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = Tokenizer.from_file(path)
    model = tokenizer.model
    alphabet = sorted(ByteLevel.alphabet())  # bytes that have no visible character get the later ones
    visible = [b for b in range(256) if chr(b) in alphabet]
    hidden = [b for b in range(256) if chr(b) not in alphabet]
    table = {b: chr(b) for b in visible} | dict(zip(hidden, (c for c in alphabet if ord(c) > 255)))

    def merge(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokens = model.tokenize
        return bpe.flat_lists([[t.id for t in tokens(x.encode("utf-8", "replace").decode("latin-1").translate(table))] for x in new])

    return WholeTexts(bpe.Encoder(merge, bits=22), tokenizer)


def largest_id(path: str) -> int:
    """The greatest id that the vocabulary, added tokens included, can give."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())


_encoders: dict[str, WholeTexts] = {}


def write(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = END_ID, key: str = "doc_id", text: str = "text", width: int | None = None) -> tuple[str, DataFrame]:
    """Encode and write all rows of docs; return the folder and its manifest: one row a file
    (shard, docs, ids, start: the ids of all files before it). Ids take `width` bytes, by default as many (2 or 4)
    as the vocabulary needs.

    The tokenizers library encodes each slice of a text once per worker's cache; slices are cut as its
    own pre-tokenizer cuts them, and no merge crosses them, so a text's ids are its slices' ids and those of
    the added tokens in it. Rows are dealt into ranges by key and, within a key, by a hash of the text and their place, so that
    a key of many rows takes several ranges."""
    spark, path = docs.sparkSession, path or public_tokenizers.path(VOCABULARY)
    folder = folder or new_path(spark, "token-ids")
    width = width or (2 if max(largest_id(path), end_id) < 1 << 16 else 4)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n_bytes, n_docs = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(n_docs, MAX_RANGES, max(least, -(-(n_bytes or 0) // SHARD_BYTES))))
    buckets = max(1, min(parts, -(-n_docs * 16 // BUCKET_KEYS)), -(-n_docs // BUCKET_KEYS))

    def payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = _hf(path)
        encoder, out, keys = _encoders[path], _Payload(folder, TaskContext.get().partitionId(), width), []

        def close() -> pa.RecordBatch:
            held, total, shard = pa.concat_arrays(keys), out.ids, out.shard
            keys.clear()
            out.close()
            h1, h2 = hash_keys(held)
            first = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))  # rows of a key stand together
            row = np.flatnonzero(first)
            count = np.diff(np.append(row, len(held)))
            cols = [np.full(len(row), shard), _bucket(h2[row], buckets), h1[row].view(np.int64), h2[row].view(np.int64), row, count, np.where(row == 0, total, 0)]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["shard", "bucket", "h1", "h2", "row", "rows", "ids"])

        for b in batches:
            done = 0
            for run in bpe.pieces(b.column(1).to_pylist()):
                flat, n = encoder.encode(run)
                out.add(np.insert(flat, np.cumsum(n), end_id), n + 1)
                keys.append(b.column(0).slice(done, len(run)))
                done += len(run)
                if out.full():
                    yield close()
        if keys:
            yield close()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, 1):
            cols = {c: table[c].to_numpy() for c in table.column_names}
            bucket, h1, h2 = int(cols["bucket"][0]), cols["h1"].view(_U), cols["h2"].view(_U)
            at = np.flatnonzero(np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
            _write_bucket(folder, bucket, h1[at], h2[at], np.diff(np.append(at, len(h1))), cols["shard"], cols["row"], cols["rows"])
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([len(at)], pa.int64())], ["bucket", "keys"])

    kinds = "shard long, bucket long, h1 long, h2 long, row long, rows long, ids long"
    order = ["key", F.xxhash64("text"), F.monotonically_increasing_id()]
    dealt = rows.withColumns({"tie": order[1], "place": order[2]}).repartitionByRange(parts, "key", "tie", "place").sortWithinPartitions("key", "tie", "place")
    entries = cut(dealt.select("key", "text").transform(map_arrow, payload, kinds))
    listed = entries.drop("ids").select("bucket", "h1", "h2", "shard", "row", "rows").repartition(buckets, "bucket").sortWithinPartitions("bucket", "h1", "h2", "shard")
    indexed = listed.transform(map_arrow, index, "bucket long, keys long").agg(F.sum("keys"), F.count("*")).first()
    sums = entries.groupBy("shard").agg(F.sum("rows").alias("docs"), F.sum("ids").alias("ids"))
    manifest = cut(sums.selectExpr("shard", "docs", "ids", "sum(ids) OVER (ORDER BY shard) - ids AS start"))
    head = {"buckets": buckets, "ranges": parts, "indexed_keys": int(indexed[0] or 0), "bucket_files": int(indexed[1]), "end_id": end_id, "width": width}
    _put(folder, "head.json", [json.dumps(head).encode()])
    return folder, manifest


# --- reading ---

#: Rows of a file that stand together in one task of a look-up.
TOGETHER = 1024


def look_up(spark: SparkSession, folder: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, shard, row, offset, ids): every stored row of each distinct key of `keys`; offset counts
    the ids before it in its file. Keys that aren't stored give no row, but for one in 2**32."""
    head = json.loads(_get(folder, "head.json"))
    buckets, ranges = head["buckets"], head["ranges"]
    kind = keys.schema[key].dataType.simpleString()

    def hashed(batches):
        for b in batches:
            h1, h2 = hash_keys(b.column(0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_bucket(h2, buckets)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["key", "bucket", "h1", "h2"])

    def entries(batches):
        bucket, number = None, -1
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 4)]
            ends = np.flatnonzero(np.append(np.diff(cols[0]) != 0, True)) + 1
            for a, z in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
                if cols[0][a] != number:
                    number = int(cols[0][a])
                    try:
                        bucket = Bucket(folder, number)
                    except FileNotFoundError:
                        bucket = None
                if bucket is None:
                    continue
                at, found = bucket.find(cols[1][a:z].view(_U), cols[2][a:z].view(_U))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(a + at)), *(pa.array(found[c].astype(np.int64)) for c in ("shard", "row", "rows"))], ["key", "shard", "row", "rows"])

    def payload(batches):
        shard, number = None, -1
        for b in batches:
            where, row, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "row", "rows"))
            # entries that follow on one another are read as one range, of bounded size
            follows = (where[1:] == where[:-1]) & (row[1:] == row[:-1] + n[:-1])
            starts = np.flatnonzero(np.append(True, ~follows)) if len(where) else np.zeros(0, np.int64)
            for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(where)]):
                if where[a] != number:
                    number = int(where[a])
                    shard = Shard(folder, number)
                entry = np.repeat(np.arange(a, z), n[a:z])
                for k in range(0, len(entry), TOGETHER):
                    of = entry[k : k + TOGETHER]
                    at = int(row[a]) + k
                    ids, before = shard.rows(at, len(of))
                    lists = pa.ListArray.from_arrays(pa.array(before - before[0], pa.int32()), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(of)), pa.array(where[of]), pa.array(np.arange(at, at + len(of))), pa.array(before[:-1]), lists], ["key", "shard", "row", "offset", "ids"])

    asked = keys.select(F.col(key).alias("key")).distinct().transform(map_arrow, hashed, f"key {kind}, bucket int, h1 long, h2 long")
    found = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket").transform(map_arrow, entries, f"key {kind}, shard long, row long, rows long")
    dealt = found.repartition(ranges, "shard", F.floor(F.col("row") / TOGETHER)).sortWithinPartitions("shard", "row")
    got = dealt.transform(map_arrow, payload, f"key {kind}, shard long, row long, offset long, ids array<int>")
    return got.withColumnRenamed("key", key)


def checksums(got: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, shard, offset, n_tokens, ids_crc32) of what look_up returns."""
    kind = got.schema[key].dataType.simpleString()

    def batches(it):
        for b in it:
            flat = b.column("ids").flatten().to_numpy(zero_copy_only=False).astype("<u4")
            n = b.column("ids").value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(n)
            crc = [zlib.crc32(flat[e - k : e]) for e, k in zip(ends.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("shard"), b.column("offset"), pa.array(n.astype(np.int64)), pa.array(crc, pa.int64())], [key, "shard", "offset", "n_tokens", "ids_crc32"])

    return got.transform(map_arrow, batches, f"`{key}` {kind}, shard long, offset long, n_tokens long, ids_crc32 long")


def with_starts(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """found (with shard, offset) and the ids of all documents before each."""
    starts = manifest.select(F.col("shard").cast("long").alias("shard"), F.col("start").alias("__start"))
    return lookup_join(found, starts, "shard").withColumn("start", F.col("__start") + F.col("offset")).drop("__start")


class Store:
    """Keyed access from one process. `bytes` counts what was read after opening."""

    def __init__(self, folder: str) -> None:
        self.folder, self.head, self.bytes = folder, json.loads(_get(folder, "head.json")), 0

    def get(self, key) -> list[np.ndarray]:
        h1, h2 = hash_keys(pa.array([key], pa.string() if isinstance(key, str) else pa.int64()))
        try:
            bucket = Bucket(self.folder, int(_bucket(h2, self.head["buckets"])[0]))
        except FileNotFoundError:
            return []
        out = []
        for segment in bucket.find_one(h1, h2):
            shard = Shard(self.folder, int(segment["shard"]))
            ids, before = shard.rows(int(segment["row"]), int(segment["rows"]))
            out += np.split(ids, before[1:-1] - before[0])
            self.bytes += shard.file.bytes
        self.bytes += bucket.file.bytes
        return out
