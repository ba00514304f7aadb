"""Quality classification by co-training of two views.

One view sees the text's content (hashed trigrams of character shapes, shares of kinds of
characters, variety of words), the other the page's metadata (language, source, length, layout of
lines). Each is a logistic regression on labelled documents. Over rounds each view labels the
documents without a learnt label that it is surest of and hands them to the other as training rows. How sure a view
is comes from its calibration on labelled documents set aside for that: it hands over a label only where its
calibrated error is at most 1 - SURE, and at most half of what the label's share alone would give, so a
view that tells nothing hands over nothing. In the end both are calibrated once more and combined by a logistic regression of
their log-odds on a further set-aside part, and all documents are scored. A document is rejected if its
score is below THRESHOLD.

Of the labelled rows at most MAX_LABELLED of each class are used, the first by a hash of the id: three
fifths to learn, one fifth to calibrate, one fifth to combine. Candidates for pseudo-labels are all other documents,
in every round; a view gives at most GIFT times the number of rows learnt from a round, in the classes' shares.
All documents are scored, over their whole texts; features are taken once and kept in the shared folder.

Null ids and null labels aren't learnt from; several labels of an id count as good if one is. A null text is an empty
one; null language and source are values of their own; a null length is the text's. Without both classes in each
part every score is the labelled share of good documents (1 without labels), and nothing is rejected.
Repeated rows give repeated results; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow
from .common import cut, new_path

MAX_LABELLED = 3000
ROUNDS, GIFT, SURE, THRESHOLD = 3, 0.25, 0.95, 0.5
HASHED, SOURCES, LANGS = 256, 32, 16
#: Range and number of the soft bins of a layout measure: log2 of length, of lines, of the mean and longest line; spread of lines.
LAYOUT = ((2, 16, 15), (0, 10, 11), (0, 14, 15), (0, 14, 15), (0, 3, 7))
LINE_BINS = 12
WIDTHS = (HASHED + 12, LANGS + SOURCES + sum(n for *_, n in LAYOUT) + LINE_BINS + 1)

# Shapes: lower, upper, other letter, digit, space, line feed, then ASCII symbols as they are.
_SHAPE = np.array([0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 5 if c == 10 else 4 if c in (9, 11, 12, 13, 32) else 6 + c % 32 for c in range(128)] + [2], np.int64)


def content_view(text: str) -> np.ndarray:
    out = np.zeros(HASHED + 12)
    if not text:
        return out
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    shape = _SHAPE[np.minimum(points, 128)]
    n = len(shape)
    if n > 2:
        # runs of one shape count once, or long words would drown all else
        keep = np.append(True, shape[1:] != shape[:-1])
        runs = shape[keep]
        if len(runs) > 2:
            code = (runs[:-2] * 40 + runs[1:-1]) * 40 + runs[2:]
            hashed = (code * 0x9E3779B1 >> 7) % HASHED
            out[:HASHED] = np.sqrt(np.bincount(hashed, minlength=HASHED) / len(code))
    kinds = np.bincount(shape, minlength=38) / n
    words = text.lower().split()
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    distinct = len(set(words)) / max(1, len(words)) ** 0.8
    pairs = len(set(zip(words, words[1:]))) / max(1, len(words) - 1)
    triples = len(set(zip(words, words[1:], words[2:]))) / max(1, len(words) - 2) if len(words) > 2 else 1.0
    out[HASHED:] = [*kinds[:6], kinds[6:].sum(), lengths.mean() / 10, lengths.std() / 10, distinct, pairs, triples]
    return out


def _bins(value: float, low: float, high: float, n: int) -> np.ndarray:
    """Membership in n bins, shared between the two nearest."""
    out = np.zeros(n)
    at = min(max((value - low) / (high - low), 0.0), 1.0) * (n - 1)
    i = int(at)
    out[i] = 1 - (at - i)
    if i + 1 < n:
        out[i + 1] = at - i
    return out


def metadata_view(text: str, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(LANGS + SOURCES)
    out[0 if lang is None else 1 + zlib.crc32(lang.encode()) % (LANGS - 1)] = 1
    out[LANGS + (0 if source is None else 1 + zlib.crc32(source.encode()) % (SOURCES - 1))] = 1
    lines = np.fromiter(map(len, text.split("\n")), np.float64)
    full = lines[lines > 0] if lines.any() else np.zeros(1)
    size = max(0, n_chars if n_chars is not None else len(text))
    measures = (math.log2(1 + size), math.log2(len(lines)), math.log2(1 + full.mean()), math.log2(1 + full.max()), full.std() / (1 + full.mean()))
    by_length = np.bincount(np.minimum(np.log2(1 + lines), LINE_BINS - 1).astype(np.int64), minlength=LINE_BINS) / len(lines)
    return np.concatenate([out, *(_bins(v, *b) for v, b in zip(measures, LAYOUT)), by_length, [(lines == 0).mean()]])


def logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, ridge: float = 10.0, steps: int = 15) -> np.ndarray:
    """Weights (the first for the constant) by Newton steps, each halved until the loss falls."""
    z = np.column_stack([np.ones(len(x)), x])
    penalty = np.full(z.shape[1], ridge)
    penalty[0] = 1e-6

    def loss(w: np.ndarray) -> float:
        o = z @ w
        return float(np.logaddexp(0, o).sum() - y @ o + (penalty * w * w).sum() / 2)

    w = np.zeros(z.shape[1]) if start is None else start.copy()
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
        for _ in range(20):
            then = loss(w - step)
            if then <= now:
                break
            step /= 2
        else:
            break
        w, now = w - step, then
        if np.abs(step).max() < 1e-4:
            break
    return w


def odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(w[0] + x @ w[1:], -15, 15)


def _p(o: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-o))


@dataclass
class Model:
    share: float
    scale: list = field(default_factory=list)  # of each view: mean, deviation
    views: list = field(default_factory=list)  # of each view: weights
    calibration: list = field(default_factory=list)  # of each view: constant, slope
    combined: np.ndarray = field(default_factory=lambda: np.zeros(0))
    handed: list = field(default_factory=list)  # of each round: labels given by each view

    def inputs(self, v: int, x: np.ndarray) -> np.ndarray:
        mean, dev = self.scale[v]
        return np.clip((x - mean) / dev, -10, 10)

    def odds(self, v: int, x: np.ndarray) -> np.ndarray:
        """Calibrated log-odds of one view."""
        c = self.calibration[v]
        return c[0] + c[1] * odds(self.inputs(v, x), self.views[v])

    def scores(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The combined score, and those of the two views."""
        if not len(self.combined):
            same = np.full(len(content), self.share)
            return same, same, same
        o = [self.odds(v, x) for v, x in enumerate((content, metadata))]
        z = self.combined[0] + self.combined[1] * o[0] + self.combined[2] * o[1]
        return _p(np.clip(z, -30, 30)), _p(o[0]), _p(o[1])

    def kept(self, scores: np.ndarray) -> np.ndarray:
        return (scores >= THRESHOLD) | (len(self.combined) == 0)


#: What a view hands over: the rows' two views, and the labels.
Gift = tuple[np.ndarray, np.ndarray, np.ndarray]


def sure_of(share: float) -> tuple[float, float]:
    """Least calibrated probability of each label (0, 1) with which it is handed over."""
    return tuple(1 - min(1 - SURE, (1 - p) / 2) for p in (1 - share, share))


def candidates(model: Model, content: np.ndarray, metadata: np.ndarray):
    """(view, label, row, probability) of the rows of which a view is sure enough."""
    for v, x in enumerate((content, metadata)):
        p = _p(model.odds(v, x))
        for label, least in enumerate(sure_of(model.share)):
            q = p if label else 1 - p
            at = np.flatnonzero(q >= least)
            yield v, label, at, q[at]


def train(labelled: tuple[np.ndarray, np.ndarray], labels: np.ndarray, give: Callable[[Model, tuple[int, int]], list[Gift]]) -> Model:
    """labelled: the (content, metadata) arrays of rows in an order that has nothing to do with them.
    give(model, quotas of the labels): what each view hands over now."""
    n = len(labels)
    share = float(labels.mean()) if n else 1.0
    part = np.arange(n) % 5
    learn, adjust, join = part < 3, part == 3, part == 4
    y = labels.astype(np.float64)
    if min(len(set(y[p].tolist())) for p in (learn, adjust, join)) < 2:
        return Model(share)
    scale = [(x[learn].mean(0), np.where((dev := x[learn].std(0)) < 1e-6, 1.0, dev)) for x in labelled]
    model = Model(share, scale)
    inputs = [model.inputs(v, labelled[v]) for v in (0, 1)]

    def calibrate() -> None:
        model.calibration = []
        for v in (0, 1):
            c = logistic(odds(inputs[v][adjust], model.views[v])[:, None], y[adjust], ridge=0.1)
            model.calibration.append(np.array([c[0], max(c[1], 0.0)]))

    model.views = [logistic(x[learn], y[learn]) for x in inputs]
    calibrate()
    got: list[list[Gift]] = [[], []]  # what each view was given
    quotas = tuple(max(1, round(GIFT * learn.sum() * p)) for p in (1 - share, share))
    for _ in range(ROUNDS):
        gifts = give(model, quotas)
        model.handed.append([len(g[2]) for g in gifts])
        if not sum(model.handed[-1]):
            break
        for v, gift in enumerate(gifts):
            got[1 - v].append(gift)
        for v in (0, 1):
            x = np.concatenate([inputs[v][learn], *(model.inputs(v, g[v]) for g in got[v] if len(g[2]))])
            model.views[v] = logistic(x, np.concatenate([y[learn], *(g[2] for g in got[v])]), model.views[v])
        calibrate()
    both = np.column_stack([model.odds(v, labelled[v][join]) for v in (0, 1)])
    combined = logistic(both, y[join], ridge=0.1)
    if (combined[1:] < 0).any():  # a view that tells nothing has no say, rather than a contrary one
        v = int(np.argmax(combined[1:]))
        one = logistic(both[:, [v]], y[join], ridge=0.1)
        combined = np.array([one[0], *(max(one[1], 0.0) if u == v else 0.0 for u in (0, 1))])
    model.combined = combined
    return model


# --- DataFrames ---


def _inputs(docs: DataFrame, text: str):
    return [F.col(text).alias("__text"), F.col("lang").cast("string").alias("__lang"), F.col("source").cast("string").alias("__source"), F.col("n_chars").cast("long").alias("__n")]


def _views(batch: pa.RecordBatch, at: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Half precision, as they are kept."""
    cols = [batch.column(i).to_pylist() for i in at]
    content = [content_view(t or "") for t in cols[0]]
    metadata = [metadata_view(t or "", *rest) for t, *rest in zip(*cols)]
    return tuple(np.clip(np.array(x).reshape(len(x), w), 0, 1000).astype(np.float16) for x, w in zip((content, metadata), WIDTHS))


def _pack(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())


def _unpack(values, v: int) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, values)), np.float16).reshape(-1, WIDTHS[v]).astype(np.float64)


def featured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, content, metadata): both views of every row, written to the shared folder."""
    kind = docs.schema[key].dataType.simpleString()

    def batches(it):
        for b in it:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(_pack, _views(part, [1, 2, 3, 4]))], ["id", "content", "metadata"])

    path = new_path(docs.sparkSession, "views")
    docs.select(F.col(key).alias("id"), *_inputs(docs, text)).transform(map_arrow, batches, f"id {kind}, content binary, metadata binary").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def learn(features: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, key: str = "doc_id", label: str = "quality") -> Model:
    """A model of labelled documents, given `featured` ones (or documents, of which the views are then taken)."""
    if "content" not in features.columns or "metadata" not in features.columns:
        features = featured(features, key)
    spark = features.sparkSession
    features = features.select(F.col("id").cast("long").alias("id"), "content", "metadata").where("id IS NOT NULL")
    marked = labels.select(F.col(key).cast("long").alias("__id"), F.col(label).cast("int").alias("y")).where("__id IS NOT NULL AND y IS NOT NULL").groupBy("__id").agg(F.max("y").alias("y"))
    known = [marked.where(F.col("y") == y).orderBy(F.xxhash64("__id"), "__id").limit(max_labelled) for y in (0, 1)]
    known = F.broadcast(known[0].union(known[1]))  # at most 2 * max_labelled rows
    # rows that repeat an id are alike, or one of them stands for it
    rows = features.join(known, F.col("id") == F.col("__id")).groupBy("id").agg(F.max("y").alias("y"), F.max(F.struct("content", "metadata")).alias("x")).select("id", "y", "x.*").collect()
    rows.sort(key=lambda r: (zlib.crc32(b"fold|%d" % r.id), r.id))
    taken = {r.id for r in rows}

    def give(model: Model, quotas: tuple[int, int]) -> list[Gift]:
        sent = spark.sparkContext.broadcast((model, quotas, np.array(sorted(taken), np.int64)))

        def batches(it):
            model, quotas, used = sent.value
            best: dict = {}
            for b in it:
                ids = b.column(0).to_numpy()
                free = np.flatnonzero(~np.isin(ids, used))
                if not len(free):
                    continue
                b, ids = b.take(pa.array(free)), ids[free]
                for v, label, at, q in candidates(model, *(_unpack(b.column(1 + v).to_pylist(), v) for v in (0, 1))):
                    if len(at):
                        both = pa.Table.from_batches([*best.get((v, label), []), pa.RecordBatch.from_arrays([pa.array(np.full(len(at), v, np.int32)), pa.array(np.full(len(at), label, np.int32)), pa.array(q), *(c.take(pa.array(at)) for c in b.columns)], ["view", "label", "p", "id", "content", "metadata"])])
                        order = np.lexsort([both["id"].to_numpy(), -both["p"].to_numpy()])[: quotas[label]]
                        best[v, label] = both.take(pa.array(order)).combine_chunks().to_batches()
            for kept in best.values():
                yield from kept

        sure = cut(features.transform(map_arrow, batches, "view int, label int, p double, id long, content binary, metadata binary"))
        gifts = []
        for v in (0, 1):
            # a few hundred rows for a view and label, whatever the number of documents
            first = [sure.where((F.col("view") == v) & (F.col("label") == y)).orderBy(F.desc("p"), "id").limit(quotas[y]).collect() for y in (0, 1)]
            chosen = list({r.id: r for r in first[0] + first[1]}.values())
            taken.update(r.id for r in chosen)
            gifts.append((_unpack([r.content for r in chosen], 0), _unpack([r.metadata for r in chosen], 1), np.array([float(r.label) for r in chosen])))
        return gifts

    return train(tuple(_unpack([r[2 + v] for r in rows], v) for v in (0, 1)), np.array([r.y for r in rows]), give)


SCORES = ["score", "content_score", "metadata_score", "kept"]
SCORE_SCHEMA = "score double, content_score double, metadata_score double, kept boolean"


def _score_arrays(model: Model, views: tuple[np.ndarray, np.ndarray]) -> list[pa.Array]:
    scores = model.scores(*(x.astype(np.float64) for x in views))
    return [*(pa.array(x, pa.float64()) for x in scores), pa.array(model.kept(scores[0]))]


def score_featured(features: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, score, content_score, metadata_score, kept) of every row of `featured` documents."""

    def batches(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), *_score_arrays(model, tuple(_unpack(b.column(1 + v).to_pylist(), v) for v in (0, 1)))], [key, *SCORES])

    kind = features.schema["id"].dataType.simpleString()
    return features.select("id", "content", "metadata").transform(map_arrow, batches, f"`{key}` {kind}, {SCORE_SCHEMA}")


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(key, score, content_score, metadata_score, kept) of every row; with `carry`, those columns
    of docs instead of the key, of the kept rows."""
    keep = [key] if carry is None else carry
    cols = [F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    n = len(keep)
    names = [*(f"c{i}" for i in range(n)), *SCORES]
    # a text that is carried isn't sent twice
    own = keep.index(text) if text in keep else n
    inputs = _inputs(docs, text)[text in keep :]
    at = [own, *range(n + (text not in keep), n + (text not in keep) + 3)]

    def batches(it):
        for b in it:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *_score_arrays(model, _views(part, at))], names)

    schema = ", ".join([*(f"c{i} {k}" for i, k in enumerate(kinds)), SCORE_SCHEMA])
    out = docs.select(*cols, *inputs).transform(map_arrow, batches, schema)
    named = [F.col(f"c{i}").alias(c) for i, c in enumerate(keep)]
    return out.select(*named, *SCORES) if carry is None else out.where("kept").select(*named)
