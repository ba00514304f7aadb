"""Packing documents into training sequences: shortest pack first over the histogram of lengths.

A document is its token ids and an end id. What exceeds whole sequences of `width` ids, its tail, is counted in a histogram of at
most `width` - 1 lengths. Lengths are placed longest first, each into the shortest pack that has room (as often as it fits), else
into new packs; packs that look alike are one pattern with a count, so the work depends on the lengths, not on the documents.
Packs that are left with a gap of more than SLACK ids are then filled up: the shortest of them, as many as the others' gaps can hold, are taken
apart and their tails are cut to fit these gaps. What is over in the end, less than one sequence, is cut into powers of two,
which aren't padded. So at most SLACK ids of a sequence are padding, and about one tail is cut for each pack that had a gap.

Patterns come back to the documents by rank: the tails of one length are numbered (by the part of the input that they are in and
their place there), and a pattern says which ranks of which length it takes. Numbers within a part are given while it is encoded, the
parts' sums are added by a window over at most `width` counts a part. Ids are written once, in the shared folder, and shuffled
once, to meet the sums of their part.

Null text is the empty text (the end id alone). Null keys and rows that repeat are packed like others, each row by itself. Ties (equal
lengths) are told apart by rank. Long texts are cut at every `width` ids. An empty table gives an empty result. Other columns, whatever
their names, aren't returned."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import map_arrow
from . import binary, bpe
from .common import new_path

VOCABULARY = "byte_bpe_50k.json"
END_ID, WIDTH = 0, 1024
#: Packs that lack so many ids at most are left as they are: nothing is cut to fill so small a gap.
SLACK = 2
#: Ids of the pieces that go back to Spark at once.
BATCH_IDS = 1 << 20


class Slot(NamedTuple):
    """Part of a pattern: each of its packs takes `each` tails of one length, by consecutive ranks."""

    length: int
    rank: int
    each: int


class Pattern(NamedTuple):
    count: int
    slots: tuple[Slot, ...]
    free: int

    def split(self, k: int) -> tuple[Pattern, Pattern]:
        """The first k packs and the others."""
        others = tuple(s._replace(rank=s.rank + k * s.each) for s in self.slots)
        return self._replace(count=k), Pattern(self.count - k, others, self.free)

    def add(self, slot: Slot) -> Pattern:
        return Pattern(self.count, (*self.slots, slot), self.free - slot.length * slot.each)


def shortest_pack_first(histogram: dict[int, int], width: int = WIDTH) -> list[Pattern]:
    """Patterns for `histogram[length]` tails of each length below `width`."""
    packs: dict[int, list[Pattern]] = defaultdict(list)  # by free room

    def keep(p: Pattern) -> None:
        if p.count:
            packs[p.free].append(p)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def take(p: Pattern) -> None:
            """Fill packs of p with the length, as often as it fits."""
            nonlocal left, rank
            each = p.free // length
            k = min(p.count, left // each)
            full, rest = p.split(k)
            if k:
                keep(full.add(Slot(length, rank, each)))
                left, rank = left - k * each, rank + k * each
            if rest.count and left:  # fewer than one pack's share are left
                one, rest = rest.split(1)
                keep(one.add(Slot(length, rank, left)))
                left, rank = 0, rank + left
            keep(rest)

        for free in sorted((f for f in packs if f >= length), reverse=True):
            for p in packs.pop(free):
                if left:
                    take(p)
                else:
                    keep(p)
            if not left:
                break
        if left:
            take(Pattern(-(-left // (width // length)), (), width))
    return [p for ps in packs.values() for p in ps]


class Plan:
    """Where the tail of each length and rank goes, as arrays for look-ups by binary search.

    Patterns whose packs stay whole are looked up as they are. For the others there is a tape: the gaps of the packs
    that are filled up, run by run, and at its end the sequences of powers of two; the tails of the packs that are taken apart lie on it one
    after the other and are cut where gaps end. A run is one row, whatever its number of gaps."""

    def __init__(self, patterns: list[Pattern], width: int = WIDTH, slack: int = SLACK) -> None:
        self.width = width
        whole = [p for p in patterns if p.free <= slack]
        short = sorted((p for p in patterns if p.free > slack), key=lambda p: p.free)
        tokens = sum(p.count * (width - p.free) for p in short)
        stay, gaps, apart = tokens // width, [], []
        for p in short:  # the fullest, as many as the tokens can fill
            kept, rest = p.split(min(stay, p.count))
            stay -= kept.count
            gaps += [kept] * (kept.count > 0)
            apart += [rest] * (rest.count > 0)

        found, base, runs, tape, number = defaultdict(list), 0, [], 0, 0  # found[length]: (ranks from, upto, each, sequence, offset, place on the tape)
        for p in whole + gaps:
            at = 0
            for s in p.slots:
                found[s.length].append((s.rank, s.rank + p.count * s.each, s.each, base, at, -1))
                at += s.length * s.each
            if p.free > slack:
                runs.append((tape, number, p.free, base, at))
                tape, number = tape + p.count * p.free, number + p.count
            base += p.count
        for bit in reversed(range(width.bit_length())):
            if tokens % width >> bit & 1:
                runs.append((tape, number, 1 << bit, base, 0))
                tape, number, base = tape + (1 << bit), number + 1, base + 1
        self.sequences, at = base, 0
        for p in apart:
            for s in p.slots:
                found[s.length].append((s.rank, s.rank + p.count * s.each, 1, 0, 0, at))
                at += p.count * s.each * s.length
        assert at == tape
        rows = [(length, *x) for length, xs in sorted(found.items()) for x in sorted(xs)]
        self.rows = np.array(rows, np.int64).reshape(-1, 7)
        self.low = np.searchsorted(self.rows[:, 0], np.arange(width + 1))
        self.runs = np.array(runs, np.int64).reshape(-1, 5)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of tails (length > 0): the number of pieces of each, and of all pieces from, upto, sequence, offset."""
        low, high = self.low[length], self.low[length + 1]
        while len(low) and (high - low > 1).any():  # the last row of the length that begins at or before the rank
            mid = (low + high) // 2
            right = (high - low > 1) & (self.rows[mid, 1] <= rank)
            low, high = np.where(right, mid, low), np.where(right | (high - low <= 1), high, mid)
        _, first, _, each, base, offset, tape = self.rows[low].T
        pack, place = np.divmod(rank - first, each)
        cut, n = tape >= 0, np.ones(len(length), np.int64)
        if not cut.any():
            return n, np.zeros_like(length), length, base + pack, offset + place * length
        begin = np.where(cut, tape + (rank - first) * length, 0)
        gap = self._gap(begin[cut])
        n[cut] = self._gap(begin[cut] + length[cut] - 1) - gap + 1
        of = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        start, upto, sequence, at = np.zeros(len(of), np.int64), length[of], (base + pack)[of], (offset + place * length)[of]
        k = cut[of]
        number = np.zeros(len(n), np.int64)
        number[cut] = gap
        number = number[of][k] + nth[k]
        run = self.runs[np.searchsorted(self.runs[:, 1], number, "right") - 1]
        opens = run[:, 0] + (number - run[:, 1]) * run[:, 2]  # places of the gaps on the tape
        left = np.maximum(begin[of][k], opens)
        right = np.minimum((begin + length)[of][k], opens + run[:, 2])
        start[k], upto[k] = left - begin[of][k], right - begin[of][k]
        sequence[k], at[k] = run[:, 3] + number - run[:, 1], run[:, 4] + left - opens
        return n, start, upto, sequence, at

    def _gap(self, at: np.ndarray) -> np.ndarray:
        """The number of the gap at a place of the tape."""
        run = self.runs[np.searchsorted(self.runs[:, 0], at, "right") - 1]
        return run[:, 1] + (at - run[:, 0]) // run[:, 2]


_ENCODED = "key {}, ids binary, n long, tail int, tail_rank long, wholes long, whole_rank long, part int"


def _encode(docs: DataFrame, path: str, end_id: int, width: int, key: str, text: str, number: str) -> DataFrame:
    """Written once: ids as little-endian integers of a kind, and each row's place among those of its part whose tails are as long."""
    kind = docs.schema[key].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in binary._encoders:
            binary._encoders[path] = binary._hf(path)
        encoder, part = binary._encoders[path], TaskContext.get().partitionId()
        tails, wholes = np.zeros(width, np.int64), np.zeros(width, np.int64)
        for b in it:
            done = 0
            for run in bpe.pieces(b.column(1).to_pylist()):
                flat, n = encoder.encode(run)
                flat, n = np.insert(flat, np.cumsum(n), end_id).astype(number), n + 1
                ends = np.cumsum(n)
                whole, tail = np.divmod(n, width)
                order = np.argsort(tail, kind="stable")
                first = np.searchsorted(tail[order], tail[order])
                rank, before = np.empty_like(n), np.empty_like(n)
                rank[order] = tails[tail[order]] + np.arange(len(n)) - first
                summed = np.cumsum(whole[order]) - whole[order]
                before[order] = wholes[tail[order]] + summed - summed[first]
                tails += np.bincount(tail, minlength=width)
                wholes += np.bincount(tail, weights=whole, minlength=width).astype(np.int64)
                offsets = pa.array(np.append(0, ends * flat.itemsize).astype(np.int32)).buffers()[1]
                ids = pa.Array.from_buffers(pa.binary(), len(n), [None, offsets, pa.py_buffer(flat)])
                cols = [pa.array(x.astype(t)) for x, t in ((n, np.int64), (tail, np.int32), (rank, np.int64), (whole, np.int64), (before, np.int64), (np.full(len(n), part), np.int32))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(run)), ids, *cols], ["key", "ids", "n", "tail", "tail_rank", "wholes", "whole_rank", "part"])
                done += len(run)

    at = new_path(docs.sparkSession, "packed-ids")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows.transform(map_arrow, batches, _ENCODED.format(kind)).write.parquet(at)
    return docs.sparkSession.read.parquet(at)


def pack(docs: DataFrame, width: int = WIDTH, path: str | None = None, end_id: int = END_ID, key: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """A row a piece: key, start (its document's ids before it), length, ids_crc32 (of the ids as little-endian 32-bit
    integers), doc_tokens, sequence_id (from 0 without gaps), offset in the sequence, and the ids themselves, if wanted."""
    if width < 2 or width & (width - 1):
        raise ValueError("the width of sequences must be a power of two")
    path = path or public_tokenizers.path(VOCABULARY)
    number = "<u2" if max(binary.largest_id(path), end_id) < 1 << 16 else "<u4"
    encoded = _encode(docs, path, end_id, width, key, text, number)
    counts = encoded.groupBy("part", "tail").agg(F.count("*").alias("n"), F.sum("wholes").alias("w"))
    # at most `width` rows
    totals = {r["tail"]: (r["n"], r["w"]) for r in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).collect()}
    plan = Plan(shortest_pack_first({t: n for t, (n, _) in totals.items() if t}, width), width)
    wholes = np.zeros(width, np.int64)
    for t, (_, w) in totals.items():
        wholes[t] = w
    whole_base = plan.sequences + np.cumsum(wholes) - wholes
    earlier = Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.select("part", "tail", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("n", "w")])
    joined = encoded.join(sums, ["part", "tail"]).select(
        "key", "ids", "n", "tail", "wholes", (F.col("tail_rank") + F.col("n_before")).alias("rank"), (F.col("whole_rank") + F.col("w_before")).alias("whole_rank")
    )
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sizes = b.column("n").to_numpy()
            row = 0
            while row < len(sizes):  # rows of so many ids, one at least
                end = row + max(1, int(np.searchsorted(np.cumsum(sizes[row:]), BATCH_IDS, "right")))
                yield pieces(b.slice(row, end - row))
                row = end

    def pieces(b: pa.RecordBatch) -> pa.RecordBatch:
        n, tail, whole, rank, whole_rank = (b.column(c).to_numpy() for c in ("n", "tail", "wholes", "rank", "whole_rank"))
        rows = np.arange(len(n))
        k = np.repeat(rows, whole)
        nth = np.arange(len(k)) - np.repeat(np.cumsum(whole) - whole, whole)
        parts = [(k, nth * width, np.full(len(k), width), whole_base[tail[k]] + whole_rank[k] + nth, np.zeros(len(k), np.int64))]
        has = np.flatnonzero(tail)
        if len(has):
            many, first, upto, sequence, offset = plan.find(tail[has].astype(np.int64), rank[has])
            k = np.repeat(has, many)
            parts.append((k, whole[k] * width + first, upto - first, sequence, offset))
        k, start, length, sequence, offset = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((start, k))
        k, start, length, sequence, offset = k[order], start[order], length[order], sequence[order], offset[order]
        held = b.column("ids")
        flat = np.concatenate([np.frombuffer(x.as_buffer(), number) for x in held]).astype("<u4") if len(held) else np.zeros(0, "<u4")  # pieces follow one another as the ids do
        ends = np.cumsum(length)
        crc = [zlib.crc32(flat[e - m : e]) for e, m in zip(ends.tolist(), length.tolist())]
        cols = [b.column("key").take(pa.array(k)), *(pa.array(x.astype(np.int64)) for x in (start, length, np.array(crc, np.int64), n[k], sequence, offset))]
        if not ids:
            return pa.RecordBatch.from_arrays(cols, names)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat.astype(np.int32)))
        return pa.RecordBatch.from_arrays([*cols, lists], [*names, "ids"])

    schema = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * ids
    return joined.transform(map_arrow, batches, schema).withColumnRenamed("key", key)


def sequences(packed: DataFrame, width: int = WIDTH, pad_id: int = END_ID, key: str = "doc_id") -> DataFrame:
    """(sequence_id, ids, keys, ends, n_tokens): the sequences themselves, padded to `width` except at a power of two; `keys` and
    `ends` say whose ids they are and up to where, for a mask of attention between documents. A sequence has at most `width` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.col(key).alias("key"), "ids")))
    whole = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    flat = F.flatten(F.transform("parts", lambda p: p["ids"]))
    n = F.size("flat")
    padded = F.when(F.bit_count(n.cast("long")) == 1, F.col("flat")).otherwise(F.concat("flat", F.array_repeat(F.lit(pad_id), (F.lit(width) - n).cast("int"))))
    return whole.withColumn("flat", flat).select(
        "sequence_id", padded.alias("ids"), F.transform("parts", lambda p: p["key"]).alias("keys"), F.transform("parts", lambda p: p["offset"] + F.size(p["ids"])).alias("ends"), n.cast("long").alias("n_tokens")
    )
