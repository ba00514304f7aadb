"""Quality rules by tokeniser fertility.

A public vocabulary with byte fallback encodes a text's words; three measures follow: characters
per token, the share of tokens that are single bytes for want of a piece, and the entropy of the
text's tokens in bits. Each language (or, for texts without one, the script of most letters) has a
band for each measure and length: the quartiles over all its texts of the corpus with about as many tokens (a power of two up
to the next), widened by a multiple of their distance. A text outside a band is rejected.

Small groups are held by prior counts, not by a switch: to the counts of a group and length come PRIOR texts distributed as all groups' texts of that
length are, and to these PRIOR texts distributed as all texts. So a band moves from the pooled one to the group's own as its texts grow in number,
without a step, and every text with a token has one.

The quartiles come from counts per group, length and bin, so they are exact for binned measures, the same in every
run, and no group meets in one task before it is a few hundred counts a length.

Beside these a few base measures are taken: words, their characters, symbols, repeated lines, words
in repeated five-word windows.

Null and empty texts have no words, all counts 0 (shares null), and fail the base rule on words. Whole texts are measured. Repeated
rows give repeated results; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import map_arrow
from . import bpe
from .common import cut, lookup_join

VOCABULARY = "piece_bpe_32k.model"
#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED_PERCENT, REPEAT_WINDOW = 10, 20, 5

#: Texts that a pooled distribution counts for.
PRIOR = 50
#: measure -> (width of a bin, quartile distances allowed below, above, least quartile distance).
BANDS = {"chars_per_token": (0.01, 4, 4, 0.03), "byte_share": (0.005, None, 4, 0.01), "entropy": (0.05, 4, 4, 0.2)}


def size():
    """The length that a text is measured among: the binary digits of its number of tokens."""
    return F.when(F.col("n_tokens") > 0, F.length(F.bin("n_tokens")))


def script_of(text: str) -> str:
    """The script of most of the first letters seen over the whole text, by the names of its most
    frequent characters."""
    chars, counts = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
    totals: dict[str, int] = {}
    for c, n in zip(chars.tolist(), counts.tolist()):
        if chr(c).isalpha():
            name = unicodedata.name(chr(c), "OTHER").split()[0].split("-")[0]
            totals[name] = totals.get(name, 0) + n
    return max(totals, key=lambda s: (totals[s], s)) if totals else "NONE"


class Meter:
    """The measures of many texts at once."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.fromiter((model.is_byte(i) for i in range(len(model))), bool, len(model))
        self.cache = bpe.SliceCache(lambda new: bpe.flat_lists(model.encode(new, num_threads=1)))

    def __call__(self, texts: list[str]) -> dict[str, np.ndarray]:
        joined, points, begins = bpe.join_texts(texts)
        docs = len(texts)
        per_doc = lambda flags: np.diff(np.append(0, np.cumsum(flags))[begins])
        white = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
        first = np.zeros(len(points) + 1, bool)
        first[begins] = True
        starts = np.flatnonzero(~white & (np.append(True, white[:-1]) | first[:-1])) if len(points) else np.zeros(0, np.int64)
        ends = np.flatnonzero(~white & (np.append(white[1:], True) | first[1:])) + 1 if len(points) else starts
        spans = bpe.Spans(joined, points, begins, starts, ends)
        doc = np.repeat(np.arange(docs), spans.counts)
        out = {"n_words": spans.counts, "word_chars": per_doc(~white), "n_symbols": per_doc(np.isin(points, [ord(c) for c in SYMBOLS]))}

        # lines with a word, all but the first of equal ones of a text
        breaks = np.flatnonzero(points == 0x0A)
        line_starts = np.unique(np.concatenate([begins[:-1], breaks + 1])).astype(np.int64)
        line_starts = line_starts[line_starts < len(points)]
        line_ends = np.append(line_starts[1:], len(points))
        closed = np.zeros(len(line_starts), bool) if not len(points) else points[line_ends - 1] == 0x0A
        line_ends = line_ends - closed
        words_upto = np.append(0, np.cumsum(~white))
        full = words_upto[line_ends] > words_upto[line_starts]
        line_starts, line_ends = line_starts[full], line_ends[full]
        line_doc = np.searchsorted(begins, line_starts, "right") - 1
        seen: set = set()
        again = np.zeros(docs, np.int64)
        last = -1
        for d, u, v in zip(line_doc.tolist(), line_starts.tolist(), line_ends.tolist()):
            if d != last:
                seen.clear()
                last = d
            line = joined[u:v]
            if line in seen:
                again[d] += 1
            else:
                seen.add(line)
        out["n_dup_lines"] = again

        # words in windows that a text has twice or more; equal rows of the cache are equal words
        rows = self.cache.rows(spans)
        out["n_repeat_words"] = repeated_words(rows, doc, docs)

        ids, n = self.cache.tokens(rows)
        token_doc = np.repeat(doc, n)
        out["n_tokens"] = np.bincount(token_doc, minlength=docs)
        out["n_bytes"] = np.bincount(token_doc[self.is_byte[ids]], minlength=docs)
        pairs, counts = np.unique(token_doc * len(self.is_byte) + ids, return_counts=True)
        of = pairs // len(self.is_byte)
        plogn = np.bincount(of, weights=counts * np.log2(counts), minlength=docs)
        with np.errstate(divide="ignore", invalid="ignore"):
            out["entropy"] = np.where(out["n_tokens"] > 0, np.log2(np.maximum(out["n_tokens"], 1)) - plogn / np.maximum(out["n_tokens"], 1), 0.0)
        return out


#: Factor of the hash of windows; any odd number will do.
_FACTOR = 0x9E3779B97F4A7C15


def repeated_words(word: np.ndarray, doc: np.ndarray, docs: int, k: int = REPEAT_WINDOW) -> np.ndarray:
    """Of each text the words in windows of k that it has twice or more; numbers of words and texts, in order. Windows are
    told apart by a hash, and those of one hash compared word by word: where two differ, all are counted as tuples."""
    m = max(0, len(word) - k + 1)
    at = np.flatnonzero(doc[len(doc) - m :] == doc[:m])
    if not len(at):
        return np.zeros(docs, np.int64)
    h = doc[at].astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    for i in range(k):
        h = (h ^ word[at + i].astype(np.uint64)) * np.uint64(_FACTOR)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    x, y = at[order[1:]][same], at[order[:-1]][same]
    if (doc[x] == doc[y]).all() and all((word[x + i] == word[y + i]).all() for i in range(k)):
        twice = np.append(same, False) | np.append(False, same)
        at = at[order[twice]]
    else:
        windows = [(doc[a], *word[a : a + k].tolist()) for a in at.tolist()]
        counts = Counter(windows)
        at = np.array([a for a, w in zip(at.tolist(), windows) if counts[w] > 1], np.int64)
    edge = np.zeros(len(word) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return np.bincount(doc[np.cumsum(edge)[:-1] > 0], minlength=docs)


_meters: dict[str, Meter] = {}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_bytes")


def measure(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, group, the counts, chars_per_token, byte_share, entropy, base_failed)."""
    path = path or public_tokenizers.path(VOCABULARY)

    def batches(it):
        if path not in _meters:
            _meters[path] = Meter(path)
        for b in it:
            done = 0
            for run in bpe.pieces([t or "" for t in b.column(1).to_pylist()]):
                m = _meters[path](run)
                base = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED_PERCENT * m["n_words"])
                groups = [g if g is not None else f"script {script_of(t)}" for g, t in zip(b.column(2).slice(done, len(run)).to_pylist(), run)]
                none, n = m["n_tokens"] == 0, np.maximum(m["n_tokens"], 1)
                shares = [pa.array(m["word_chars"] / n, pa.float64(), mask=none), pa.array(m["n_bytes"] / n, pa.float64(), mask=none), pa.array(m["entropy"], pa.float64())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(run)), pa.array(groups, pa.string()), *(pa.array(m[c].astype(np.int64)) for c in COUNTS), *shares, pa.array(base)], names)
                done += len(run)

    names = [key, "group", *COUNTS, "chars_per_token", "byte_share", "entropy", "base_failed"]
    kind = docs.schema[key].dataType.simpleString()
    schema = ", ".join([f"`{key}` {kind}, group string", *(f"{c} long" for c in COUNTS), "chars_per_token double, byte_share double, entropy double, base_failed boolean"])
    return docs.select(key, text, F.col(lang).cast("string").alias(lang)).transform(map_arrow, batches, schema)


def bands(measured: DataFrame, rules: dict = BANDS) -> DataFrame:
    """(group, size, for each measure the least and the greatest value allowed, null for no bound), for each group and length there is."""
    bins = [F.struct(F.lit(m).alias("measure"), F.floor(F.col(m) / w).cast("long").alias("bin"), F.lit(w).alias("width")) for m, (w, *_) in rules.items()]
    each = measured.where("n_tokens > 0").select("group", size().alias("size"), F.explode(F.array(*bins)).alias("x"))
    counts = cut(each.groupBy("group", "size", "x.measure", "x.bin", "x.width").count())
    total = lambda *by: F.sum("count").over(Window.partitionBy(*by))
    every = counts.groupBy("measure", "bin", "width").agg(F.sum("count").alias("count"))
    every = every.select("measure", "bin", "width", (F.col("count") * PRIOR / total("measure")).alias("count"))
    own = counts.groupBy("size", "measure", "bin", "width").agg(F.sum("count").cast("double").alias("count"))
    sizes = counts.select("size").distinct()  # a few dozen
    pooled = own.unionByName(every.crossJoin(F.broadcast(sizes))).groupBy("size", "measure", "bin", "width").agg(F.sum("count").alias("count"))
    pooled = cut(pooled.select("size", "measure", "bin", "width", (F.col("count") * PRIOR / total("size", "measure")).alias("count")))
    groups = counts.select("group", "size").distinct()
    mixed = counts.withColumn("count", F.col("count").cast("double")).unionByName(pooled.join(groups, "size")).groupBy("group", "size", "measure", "bin", "width").agg(F.sum("count").alias("count"))
    by = Window.partitionBy("group", "size", "measure")
    upto = F.sum("count").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    # sums of fractions are rounded, so that a quartile doesn't hang on their last digit
    share = F.round(upto / F.sum("count").over(by), 9)
    quarter = lambda q: F.min(F.when(F.col("share") >= q, (F.col("bin") + 0.5) * F.col("width")))
    quartiles = mixed.withColumn("share", share).groupBy("group", "size", "measure").agg(quarter(0.25).alias("q1"), quarter(0.75).alias("q3"))
    known = quartiles.groupBy("group", "size").agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("q1", "q3")))).alias("q"))
    out = []
    for m, (_, below, above, least) in rules.items():
        q1, q3 = F.col("q")[m]["q1"], F.col("q")[m]["q3"]
        wide = F.greatest(q3 - q1, F.lit(least))
        none = F.lit(None).cast("double")
        out.append((q1 - wide * below if below is not None else none).alias(f"{m}_low"))
        out.append((q3 + wide * above if above is not None else none).alias(f"{m}_high"))
    return known.select("group", "size", *out)


def judge(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang", rules: dict = BANDS) -> DataFrame:
    """What `measure` returns, with rejected (outside a band) and kept (neither failed nor rejected)."""
    measured = cut(measure(docs, path, key, text, lang))
    place = lambda n: F.concat_ws(" ", n.cast("string"), "group").alias("__place")
    found = bands(measured, rules)
    found = cut(found.select(place(F.col("size")), *[c for c in found.columns if c not in ("group", "size")]))
    joined = lookup_join(measured.select("*", place(size())), found, "__place", "left")
    out = F.lit(False)
    for m in rules:
        out = out | F.coalesce(F.col(m) < F.col(f"{m}_low"), F.lit(False)) | F.coalesce(F.col(m) > F.col(f"{m}_high"), F.lit(False))
    return joined.withColumn("rejected", out & (F.col("n_tokens") > 0)).withColumn("kept", ~F.col("rejected") & ~F.col("base_failed")).select(*measured.columns, "rejected", "kept")
