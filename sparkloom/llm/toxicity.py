"""Toxicity by compression distance.

Two zstandard dictionaries are trained, on ordinary and on toxic text. A text is cut into windows
of words; a window's gain is how many bytes shorter it gets with the toxic dictionary. Counts of windows
above several gains, the greatest gains and the number of windows are calibrated to a probability
by a logistic regression on labelled documents that the dictionaries didn't see.

The dictionaries hold words in order of use. Both hold the ordinary text's frequent words, at the
same distance from the end; the toxic one begins with the words that toxic text has in excess,
counted over distinct contexts so that copies of a document count once. Words that gain in
ordinary windows are then added to both, as they are no sign.

Learning uses at most MAX_DOCS labelled documents of each class, the first by a hash of the id; seven tenths of them make
the dictionaries, the rest calibrates. Contexts, gains and measures are taken where the texts are; only words, counts
and measures come to the driver, so the texts' lengths don't matter. Rows
with a null label or id aren't learnt from; several labels of one id count as toxic if one is.
Null and empty texts have no window and get the score of that; nothing but the text is an input of a score. Without both
classes among the labels every score is the labelled share of toxic documents (0 without labels).
Whole texts are scored, whatever their length. Repeated rows give repeated results; an empty table
gives an empty result; other columns are ignored."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow
from .common import cut

MAX_DOCS = 4000
WINDOW = 32
GAINS = (1, 2, 3, 4, 5, 6)
#: Bytes of frequent words and of words that gain in ordinary text.
FREQUENT, NO_SIGN = 16384, 12288
#: Least contexts, ratio of shares and significance of a word in excess.
CONTEXTS, RATIO, G2 = 3, 4, 20

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_EDGES = b".,;:!?|()\"*%$&#"


def words(text: str | None) -> list[bytes]:
    return [w.strip(_EDGES) for w in (text or "").encode("utf-8", "replace").translate(_LOWER).split()]


def windows(seq: list[bytes], size: int = WINDOW) -> list[bytes]:
    return [b" " + b" ".join(seq[i : i + size]) + b" " for i in range(0, len(seq), size)]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=17, chain_log=17, search_log=6, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_checksum=0, write_content_size=0, write_dict_id=0,
    )
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)


class Pair:
    """The two dictionaries at work."""

    def __init__(self, excess: bytes, ordinary: bytes) -> None:
        self.toxic, self.plain = _compressor(excess + ordinary), _compressor(ordinary)

    def gains(self, parts: list[bytes]) -> np.ndarray:
        a, b = self.plain.compress, self.toxic.compress
        return np.fromiter((len(a(w)) - len(b(w)) for w in parts), np.int64, len(parts))


def features(gains: np.ndarray) -> list[float]:
    if not len(gains):
        gains = np.zeros(1, np.int64)
    counts = [int((gains >= g).sum()) for g in GAINS]
    return [*map(math.log1p, counts), math.log1p(len(gains)), min(int(gains.max()), 10) / 10, float(np.sort(gains)[-3:].mean()) / 10, counts[1] / len(gains), counts[3] / len(gains)]


@dataclass
class Model:
    share: float
    excess: bytes = b""
    ordinary: bytes = b""
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def probability(self, rows: list[list[float]]) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(rows), self.share)
        x = (np.array(rows, np.float64).reshape(len(rows), -1) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def contexts(seq: list[bytes]) -> list[tuple[bytes, int]]:
    """(word, hash of the words before and after it) of a text's words, each once."""
    padded = [b"", *seq, b""]
    return list({(w, zlib.crc32(before + b"\0" + after)) for before, w, after in zip(padded, seq, padded[2:])})


def _join(ranked: list[bytes], size: int) -> bytes:
    """The first words, last in place, up to so many bytes."""
    take, n = [], 0
    for w in ranked:
        if n > size:
            break
        take.append(b" " + w)
        n += len(w) + 1
    return b"".join(reversed(take))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    penalty = np.eye(z.shape[1]) * ridge
    penalty[0, 0] = 1e-9
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def _excess(sample: DataFrame) -> tuple[list[bytes], list[bytes]]:
    """Words that toxic text has in excess, and the ordinary text's frequent words without these, both most used first.
    Of each no more than fit a dictionary."""

    def batches(it):
        for b in it:
            for y, t in zip(b.column("y").to_pylist(), b.column("__text").to_pylist()):
                found = contexts(words(t))
                for a in range(0, len(found), 100_000):
                    w, h = zip(*found[a : a + 100_000])
                    yield pa.RecordBatch.from_arrays([pa.array([y] * len(w), pa.int32()), pa.array(w, pa.binary()), pa.array(h, pa.int64())], ["y", "word", "context"])

    used = sample.transform(map_arrow, batches, "y int, word binary, context long").distinct()
    counts = cut(used.groupBy("word").agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b")))
    na, nb = counts.agg(F.sum("a"), F.sum("b")).first()
    if not na or not nb:
        return [], []
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    p = (a + b) / (na + nb)
    part = lambda x, n: F.when(x > 0, x * F.log(x / (p * n))).otherwise(0.0)
    over = (F.col("a") >= CONTEXTS) & (a * nb >= RATIO * b * na) & (2 * (part(a, na) + part(b, nb)) >= G2)
    marked = counts.where("word <> X''").withColumn("over", over)
    excess = marked.where("over").orderBy(F.desc("a"), "word").limit(FREQUENT // 2).collect()
    usual = marked.where("NOT over AND b > 0").orderBy(F.desc("b"), "word").limit(FREQUENT // 2).collect()
    return [bytes(r.word) for r in excess], [bytes(r.word) for r in usual]


def _no_sign(plain: DataFrame, excess: bytes, frequent: bytes) -> list[bytes]:
    """Words of windows that gain in ordinary text, most frequent first."""

    def batches(it):
        pair = Pair(excess, frequent)
        for b in it:
            counts: Counter = Counter()
            for t in b.column("__text"):
                parts = windows(words(t.as_py()))
                for i in np.flatnonzero(pair.gains(parts) >= 2).tolist():
                    counts.update(x for x in parts[i].split() if len(x) > 3)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    found = plain.transform(map_arrow, batches, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r.word) for r in found.orderBy(F.desc("n"), "word").limit(NO_SIGN // 2).collect()]


def _measured(rows: DataFrame, excess: bytes, ordinary: bytes) -> list:
    """(id, y, features) of each row, in a fixed order."""

    def batches(it):
        pair = Pair(excess, ordinary)
        for b in it:
            x = [features(pair.gains(windows(words(t.as_py())))) for t in b.column("__text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(x, pa.list_(pa.float64()))], ["id", "y", "x"])

    return sorted(rows.transform(map_arrow, batches, "id long, y int, x array<double>").collect(), key=lambda r: (r.id, r.x))


def learn(docs: DataFrame, labels: DataFrame, learnable, max_docs: int = MAX_DOCS, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model of the labelled rows for which `learnable` (a condition on `id`) holds."""
    marked = labels.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    marked = marked.where(learnable).groupBy("id").agg(F.max("y").alias("y"))
    chosen = [marked.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_docs) for y in (0, 1)]
    chosen = F.broadcast(chosen[0].union(chosen[1]))  # at most 2 * max_docs rows
    texts = docs.select(F.col(key).cast("long").alias("__id"), F.col(text).alias("__text"))
    sample = cut(texts.join(chosen, F.col("__id") == F.col("id")).select("id", "y", "__text"))
    n, toxic = sample.agg(F.count("*"), F.sum("y")).first()
    share = (toxic or 0) / n if n else 0.0
    if not 0 < share < 1:
        return Model(share)
    fold = F.pmod(F.crc32(F.concat(F.lit("fold|"), F.col("id").cast("string")).cast("binary")), F.lit(10))
    first, rest = sample.where(fold < 7), sample.where(fold >= 7)
    over, usual = _excess(first)
    excess, frequent = _join(over, FREQUENT), _join(usual, FREQUENT)
    if not excess:
        return Model(share)
    ordinary = _join(_no_sign(first.where("y = 0"), excess, frequent), NO_SIGN) + frequent
    rows = _measured(rest, excess, ordinary)
    y = np.array([r.y for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return Model(share)
    return Model(share, excess, ordinary, *_logistic(np.array([r.x for r in rows]), y))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): the probability that a document is toxic."""

    def batches(it):
        pair = Pair(model.excess, model.ordinary) if len(model.weights) else None
        for b in it:
            rows = [features(pair.gains(windows(words(t.as_py())))) if pair else [] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.probability(rows), pa.float64())], [key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).transform(map_arrow, batches, f"`{key}` {kind}, score double")
