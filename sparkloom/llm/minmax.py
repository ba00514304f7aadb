"""Near-duplicate documents by min-max hashing.

A document is the set of its distinct word shingles. Under each permutation both the least and the
greatest image are kept, so K permutations give 2K signature values; they are dealt into bands, and
documents that agree in a band are candidates. Equal sets are one class throughout.

Links are confirmed on full sets, in two steps that never list the pairs of a group: each bucket's
members against its least member, then, for buckets whose other members are still of several
components, all pairs across components inside blocks of bounded size, of which only links that join
components come out. Thus no link between candidates is lost, and work on rows is linear in the
buckets' sizes.

With fewer words than a shingle takes, the whole sequence is the one shingle; without words or
text the set is empty and linked with nothing. A null id takes no part: its component is null and
it is kept. Rows that repeat an id are one document with several texts: any link counts. Whole texts are
used. An empty table gives an empty result; other columns are ignored, or kept by `dedup`."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow
from .common import SALT, Forest, by_group, components, cut, numbered, triangle

#: Words of a shingle and least similarity in percent, unless a caller says otherwise.
WORDS, PERCENT = 5, 80
#: Signature values, and the greatest chance of missing a pair at the least similarity.
VALUES, MISS = 160, 1e-5
#: Bytes of sets in one chunk of a block.
CHUNK_BYTES = 4 << 20

_U = np.uint64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def banding(percent: int) -> tuple[int, int]:
    """Bands and values in each: the longest bands that miss a pair at the least similarity with no more than
    the chance MISS."""
    fit = [(VALUES // r, r) for r in range(1, 33) if (1 - (percent / 100) ** r) ** (VALUES // r) <= MISS]
    return max(fit, key=lambda x: x[1]) if fit else (VALUES, 1)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = _WordHash()


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    seq = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not seq:
        return np.zeros(0, _U)
    w = np.fromiter(map(_words.__getitem__, seq), _U, len(seq))
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, _U)
    for i in range(k):
        h = (h ^ w[i : len(w) - k + 1 + i]) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
    return np.unique(_finish(h))


@lru_cache
def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    """x -> (x ^ r) * a with odd a permutes the 64-bit numbers."""
    i = np.arange(1, 2 * k + 1, dtype=_U)
    x = _finish(i * _U(0x9E3779B97F4A7C15))
    return x[:k, None], x[k:, None] | _U(1)


def signature(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k least and the k greatest images of a set that isn't empty."""
    r, a = _permutations(k)
    low, high = np.full(k, ~_U(0)), np.zeros(k, _U)
    for at in range(0, len(hashes), 1024):
        y = (hashes[None, at : at + 1024] ^ r) * a
        np.minimum(low, y.min(1), out=low)
        np.maximum(high, y.max(1), out=high)
    return np.concatenate([low, high])


@lru_cache
def _deal(values: int, bands: int, rows: int) -> np.ndarray:
    """Which values make up each band: a fixed shuffle, so that a permutation's two values
    seldom meet in a band."""
    return np.argsort(_finish(np.arange(values, dtype=_U) + _U(77)))[: bands * rows].reshape(bands, rows)


def bands_of(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    v = values[_deal(len(values), bands, rows)]
    h = np.arange(bands, dtype=_U) * _U(0xC2B2AE3D27D4EB4F)
    for j in range(rows):
        h = _finish(h ^ v[:, j]) * _U(0x9E3779B97F4A7C15)
    return h.view(np.int64)


def signatures(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, s1, s2, bands): the size of each row's set, two hashes that stand for the set
    (null if empty) and its band hashes."""
    bands, rows = banding(percent)
    k = -(-bands * rows // 2)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for t in b.column(1):
                h = shingles(t.as_py(), words)
                if len(h):
                    d = xxhash.xxh3_128_digest(h.tobytes())
                    out.append((len(h), *np.frombuffer(d, np.int64).tolist(), bands_of(signature(h, k), bands, rows)))
                else:
                    out.append((0, None, None, None))
            n, s1, s2, bs = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bs, pa.list_(pa.int64()))], ["id", "n", "s1", "s2", "bands"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).transform(map_arrow, batches, "id long, n long, s1 long, s2 long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """(id, set): the sets of wanted (id, s1), as sorted 64-bit numbers."""

    def batches(it):
        done: tuple = (None, set())
        for b in it:
            ids, sets = [], []
            for i, s1, t in zip(*(c.to_pylist() for c in b.columns)):
                if i != done[0]:
                    done = (i, set())
                if s1 in done[1]:
                    continue
                h = shingles(t, words)
                if np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)[0] == s1:
                    done[1].add(s1)
                    ids.append(i)
                    sets.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "set"])

    texts = docs.select(F.col(key).cast("long").alias("__id"), F.col(text).alias("__text")).where("__text IS NOT NULL")
    return wanted.join(texts, F.col("id") == F.col("__id")).select("id", "s1", "__text").transform(map_arrow, batches, "id long, set binary")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def batches(it):
        b_id, b_set = None, None
        for b in it:
            keep = []
            for i, (x, other, y) in enumerate(zip(b.column(2), b.column(1).to_pylist(), b.column(3))):
                if other != b_id or b_set[1] != y:
                    b_id, b_set = other, (np.frombuffer(y.as_py(), _U), y)
                if _linked(np.frombuffer(x.as_py(), _U), b_set[0], percent):
                    keep.append(i)
            yield b.select([0, 1]).take(pa.array(keep, pa.int64()))

    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    return two.select("a", "b", "set_a", "set_b").transform(map_arrow, batches, "a long, b long")


def _across(table: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links that join the components of a block's members; columns id, label, set."""
    ids, labels = table["id"].to_numpy(), table["label"].to_numpy()
    sets = [np.frombuffer(s.as_py(), _U) for s in table["set"]]
    names, label = np.unique(labels, return_inverse=True)
    counts = np.bincount(label)
    if len(names) < 2:
        return []
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    begins = np.cumsum(sizes) - sizes
    flag, forest, out = np.zeros(local.max() + 1, np.int32), Forest(len(names)), []
    for x in np.flatnonzero(label != counts.argmax()).tolist():
        mine = local[begins[x] : begins[x] + sizes[x]]
        flag[mine] = 1
        both = np.add.reduceat(flag[local], begins)
        flag[mine] = 0
        for y in np.flatnonzero((100 * both >= percent * (sizes + sizes[x] - both)) & (label != label[x])).tolist():
            if forest.join(int(label[x]), int(label[y])):
                out.append((int(labels[x]), int(labels[y])))
    return out


def groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept), a row for each row of docs."""
    signed = cut(signatures(docs, words, percent, key, text))
    full = signed.where("n > 0 AND id IS NOT NULL")
    classes = full.groupBy("s1", "s2").agg(F.min("id").alias("id"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))
    # a band that many documents share is dealt over SALT tasks, with one row for each of them in the lookup table
    posted = classes.select("id", "s1", "n", F.explode("bands").alias("band"), F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int").alias("salt"))
    posted = posted.repartition("band", "salt")
    cells = posted.groupBy("band", "salt").agg(F.min(F.struct("id", "n")).alias("center"), F.count("*").alias("m"))
    buckets = cells.groupBy("band").agg(F.min("center").alias("center"), F.sum("m").alias("m"), F.collect_set("salt").alias("salts")).where("m > 1")
    buckets = buckets.select(F.col("band").alias("__band"), "center", F.explode("salts").alias("__salt"))
    members = cut(posted.join(buckets, (F.col("band") == F.col("__band")) & (F.col("salt") == F.col("__salt"))).selectExpr("band", "id", "s1", "n", "center.id AS center", "center.n AS center_n"))

    sets = cut(_sets(docs, members.select("id", "s1").distinct(), words, key, text))
    close = F.col("n") * 100 >= F.col("center_n") * percent
    close = close & (F.col("center_n") * 100 >= F.col("n") * percent)
    stars = members.where((F.col("id") != F.col("center")) & close).select(F.col("id").alias("a"), F.col("center").alias("b")).distinct()
    labels = components(_confirm(stars, sets, percent))

    others = members.where("id <> center").join(labels.withColumnRenamed("node", "__node"), F.col("id") == F.col("__node"), "left")
    others = cut(others.select("band", "id", "n", F.coalesce("component", "id").alias("label")))
    mixed = others.groupBy("band").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.ceil(F.sum("n") * 8 / CHUNK_BYTES).cast("int").alias("chunks")).where("l1 <> l2")
    left = others.join(mixed.select(F.col("band").alias("__band"), "chunks"), F.col("band") == F.col("__band")).drop("__band")
    left = triangle(left, F.pmod(F.xxhash64("id"), F.col("chunks")), F.col("chunks")).select("band", "__i", "__j", "id", "label")
    shipped = left.join(sets.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id")).select("band", "__i", "__j", "id", "label", "set")

    def blocks(it):
        for table in by_group(it, 3):
            pairs = _across(table, percent)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    bridges = shipped.repartition("band", "__i", "__j").sortWithinPartitions("band", "__i", "__j").transform(map_arrow, blocks, "a long, b long")
    merged = components(bridges)
    final = labels.join(merged.select(F.col("node").alias("__node"), F.col("component").alias("__to")), F.col("component") == F.col("__node"), "left").select("node", F.coalesce("__to", "component").alias("component"))
    alone = merged.join(labels.select(F.col("node").alias("__n")), F.col("node") == F.col("__n"), "left_anti")
    final = final.union(alone.select("node", "component"))

    placed = classes.select("s1", "s2", "id").join(final, F.col("id") == F.col("node"), "left")
    placed = placed.select(F.col("s1").alias("__s1"), F.col("s2").alias("__s2"), F.coalesce("component", "id").alias("component"))
    out = signed.join(placed, (F.col("s1") == F.col("__s1")) & (F.col("s2") == F.col("__s2")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that aren't their component's first document; columns stay, whatever their names. Rows that
    repeat a kept id stay, as they are that document."""
    dropped = groups(docs, words, percent, key=key, text=text).where("NOT kept").select(F.col("id").alias("dropped")).distinct()
    left = numbered(docs).join(dropped, F.col(f"c{docs.columns.index(key)}").cast("long") == F.col("dropped"), "left_anti")
    return left.toDF(*docs.columns)
