"""Phrase collocations by prefix growth over contiguous words.

1. Words are counted for each language; those below the least count end every phrase, as ends of pieces do.
2. Every occurrence of a word is a pointer to what follows it. An extension can need three more words at most, so a pointer travels as these; equal ones
   of a stretch of input travel once, with a count. Pointers are dealt by their prefix (a word of a language) to the task that
   grows it. A prefix of more than LIMIT occurrences is dealt over several tasks by the next word, so that its phrases are whole in one task. Only
   a pair of two such words can have more than LIMIT occurrences itself; it is dealt by the word after it as well, and the counts of these few
   pairs are added up after.
3. A task sorts a prefix's pointers once, so that those of an extension are a range, and grows to the right, depth first: an extension
   that occurs often enough is a phrase, and its range is grown in turn.

Words travel as numbers: places in the list of frequent words while that list is small enough to be sent to all tasks
(VOCABULARY_BYTES), else 64-bit hashes, of a seed under which no two words of the corpus clash, without step 1's filter. The results are the same.

A phrase's score for a cut is floor(2,000,000 * a / (l + r)), in decimals. Every part of a frequent phrase is frequent, so l and r are always at hand.
Null text is empty; a null language is `und`; texts without words count nothing. Long texts are read whole. Repeated rows count as often as they are there, and ties are
ordered by count and phrase. An empty table gives an empty result. Other columns, whatever their names, are ignored."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import map_arrow
from .common import by_group, cut

WORDS, LEAST, KEPT, COVERED = 4, 30, 2000, 80
#: Occurrences of a prefix that one task takes.
LIMIT = 1 << 20
#: Bytes of frequent words up to which their list goes to all tasks.
VOCABULARY_BYTES = 16 << 20
#: Pointers that are sorted at once where the texts are; words counted before they are handed on.
CHUNK, DISTINCT = 1 << 20, 1 << 19
UNKNOWN = "und"

#: A-Z lower-cased, a tab as a blank, and every character that ends a piece as a full stop.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 46 if b in b".,;:!?" or 10 <= b <= 13 else b for b in range(256))


def tokens(texts: list[str]) -> list[bytes]:
    """The words of texts of one language; a full stop where a piece ends."""
    return " . ".join(texts).encode().translate(_FOLD).replace(b".", b" . ").split()


def _by_language(it: Iterator[pa.RecordBatch], chars: int = 1 << 21) -> Iterator[tuple[str, list[str]]]:
    for b in it:
        held: dict[str, list[str]] = {}
        size = 0
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size >= chars:
                yield from held.items()
                held, size = {}, 0
        yield from held.items()


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, f); a row without word has the number of all words."""
    counts: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            c.pop(b".", None)  # ends of pieces
            names, f = [None, *c], [sum(c.values()), *c.values()]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f)), pa.array(names, pa.binary()).cast(pa.string()), pa.array(f, pa.int64())], ["lang", "word", "f"])
        counts.clear()

    for lang, texts in _by_language(it):
        counts.setdefault(lang, Counter()).update(tokens(texts))
        if sum(map(len, counts.values())) > DISTINCT:
            yield from out()
    yield from out()


class Coder:
    """Numbers of words, from 1; 0 for what no phrase goes across."""

    def __init__(self, words: list[str] | None, seed: int = 0) -> None:
        self.words, self.seed = words, seed
        self.kind = "<u4" if words is not None else "<u8"

    def open(self):
        known = {w.encode(): i + 1 for i, w in enumerate(self.words or [])}
        if self.words is not None:
            return lambda ws: np.fromiter((known.get(w, 0) for w in ws), np.uint64, len(ws))
        import xxhash

        known[b"."] = 0

        def codes(ws):
            if len(known) > DISTINCT:
                known.clear()
                known[b"."] = 0
            for w in set(ws) - known.keys():
                known[w] = xxhash.xxh64_intdigest(w, self.seed)
            return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))

        return codes


def pointers(docs: DataFrame, coder: Coder, hot: dict[tuple[str, int], int]) -> DataFrame:
    """(lang, prefix, part, block): what follows the occurrences of a prefix, as rows of three words and a count."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, held, sizes = coder.open(), {}, Counter()
        for lang, texts in _by_language(it):
            c = np.append(code(tokens(texts)), np.zeros(3, np.uint64))
            at = np.flatnonzero((c[:-1] > 0) & (c[1:] > 0))
            third = c[at + 2]
            fourth = np.where(third > 0, c[np.minimum(at + 3, len(c) - 1)], 0)
            held.setdefault(lang, []).append(np.column_stack([c[at], c[at + 1], third, fourth]))
            sizes[lang] += len(at)
            if sizes.total() > CHUNK:
                for x in held.items():
                    yield from block(*x)
                held, sizes = {}, Counter()
        for x in held.items():
            yield from block(*x)

    def block(lang: str, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        w = np.concatenate(parts)
        if not len(w):
            return
        part = np.zeros(len(w), np.int64)
        own = [(c, n) for (of, c), n in hot.items() if of == lang]
        if own:
            codes, many = (np.array(x, np.uint64) for x in zip(*sorted(own)))
            place = np.minimum(np.searchsorted(codes, w[:, 0]), len(codes) - 1)
            is_hot = codes[place] == w[:, 0]
            then = np.where(np.isin(w[:, 1], codes), w[:, 2], np.uint64(0))
            mixed = (w[:, 1] * np.uint64(0x9E3779B97F4A7C15) ^ then) * np.uint64(0xD1342543DE82EF95)
            part[is_hot] = ((mixed >> np.uint64(33)) % many[place])[is_hot].astype(np.int64)
        order = np.lexsort((w[:, 3], w[:, 2], w[:, 1], part, w[:, 0]))
        w, part = w[order], part[order]
        new = np.append(True, (w[1:] != w[:-1]).any(1) | (part[1:] != part[:-1]))
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(w)))
        w, part = w[first], part[first]
        rows = np.column_stack([w[:, 1:], count.astype(np.uint64)]).astype(coder.kind)
        begins = np.flatnonzero(np.append(True, (w[1:, 0] != w[:-1, 0]) | (part[1:] != part[:-1])))
        offsets = pa.py_buffer((np.append(begins, len(w)) * 4 * rows.itemsize).astype(np.int32))
        blobs = pa.Array.from_buffers(pa.binary(), len(begins), [None, offsets, pa.py_buffer(np.ascontiguousarray(rows))])
        prefix = pa.array(w[begins, 0].astype(np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(begins)), prefix, pa.array(part[begins].astype(np.int32)), blobs], ["lang", "prefix", "part", "block"])

    return docs.transform(map_arrow, batches, "lang string, prefix long, part int, block binary")


def grow(rows: np.ndarray, least: int, parted: np.ndarray | None = None) -> Iterator[tuple[tuple[int, ...], int]]:
    """(words after the prefix, occurrences) of all extensions with at least `least`, depth first; of the one-word extensions by words that
    are `parted`, whose other occurrences are elsewhere, whatever their number."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    upto = np.append(0, np.cumsum(rows[:, 3].astype(np.int64)))

    def extend(found: tuple[int, ...], low: int, high: int) -> Iterator[tuple[tuple[int, ...], int]]:
        words = rows[low:high, len(found)]
        first = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
        last = np.append(first[1:], high - low)
        n = upto[low + last] - upto[low + first]
        enough = n >= least
        if not found and parted is not None:
            enough |= np.isin(words[first], parted)
        for i in np.flatnonzero(enough & (words[first] > 0)).tolist():
            longer = (*found, int(words[first[i]]))
            yield longer, int(n[i])
            if len(longer) < WORDS - 1 and n[i] >= least:
                yield from extend(longer, low + int(first[i]), low + int(last[i]))

    yield from extend((), 0, len(rows))


def mine(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of one to WORDS words with f >= least, and (lang, n)."""
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted = docs.transform(map_arrow, _count, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    counted = cut(counted.where(F.col("word").isNull() | (F.col("f") >= least)))
    totals = counted.where("word IS NULL").select("lang", F.col("f").alias("n"))
    words = counted.where("word IS NOT NULL")
    distinct = words.groupBy("word").agg(F.max("f").alias("f"))
    size, most = distinct.agg(F.sum(F.octet_length("word") + 64), F.max("f")).first()
    coder = Coder(sorted(r[0] for r in distinct.select("word").collect())) if (size or 0) <= VOCABULARY_BYTES else _hashed(docs)
    # so many occurrences that at most ten thousand prefixes are hot
    limit = max(LIMIT, (totals.agg(F.sum("n")).first()[0] or 0) // 10_000)
    hot = {}
    if (most or 0) > limit:
        code = coder.open()
        for r in words.where(F.col("f") > limit).collect():
            hot[r["lang"], int(code([r["word"].encode()])[0])] = -(-r["f"] // limit)
    parted: dict[str, np.ndarray] = {of: np.array([c for lang, c in hot if lang == of], np.uint64) for of in {lang for lang, _ in hot}}
    dealt = pointers(docs, coder, hot).repartition("lang", "prefix", "part").sortWithinPartitions("lang", "prefix", "part")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = coder.words
        for table in by_group(it, 3):
            of, prefix = table["lang"][0].as_py(), table["prefix"][0].as_py() % 2**64
            rows = np.frombuffer(b"".join(table["block"].to_pylist()), coder.kind).reshape(-1, 4)
            found = [((prefix, *w), n) for w, n in grow(rows, least, parted[of] if (of, prefix) in hot else None)]
            if found:
                spelt = [" ".join(names[c - 1] for c in w) for w, _ in found] if names is not None else [None] * len(found)
                codes = pa.array([[c - 2**64 if c >> 63 else c for c in w] for w, _ in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([of] * len(found)), codes, pa.array(spelt, pa.string()), pa.array([n for _, n in found], pa.int64())], ["lang", "codes", "phrase", "f"])

    grown = dealt.transform(map_arrow, batches, "lang string, codes array<long>, phrase string, f long")
    phrases = grown.groupBy("lang", "codes").agg(F.first("phrase").alias("phrase"), F.sum("f").alias("f")).where(F.col("f") >= least)
    if coder.words is None:
        phrases = _spelt(phrases, words, coder.seed)
    longer = phrases.select("lang", "phrase", F.size("codes").alias("words"), "f")
    return cut(words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "f").unionByName(longer)), totals


def _hash_words(df: DataFrame, seed: int) -> DataFrame:
    """(word, code) of distinct words."""

    def batches(it):
        import xxhash

        for b in it:
            codes = np.array([xxhash.xxh64_intdigest(w.encode(), seed) for w in b.column(0).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes.view(np.int64))], ["word", "code"])

    return df.select("word").transform(map_arrow, batches, "word string, code long")


def _hashed(docs: DataFrame) -> Coder:
    """A coder under which no two words of docs clash and none is 0."""
    words = cut(docs.transform(map_arrow, _count, "lang string, word string, f long").where("word IS NOT NULL").select("word").distinct())
    seed = 0
    while True:
        codes = _hash_words(words, seed)
        if not codes.groupBy("code").count().where("count > 1 OR code = 0").limit(1).count():
            return Coder(None, seed)
        seed += 1


def _spelt(phrases: DataFrame, words: DataFrame, seed: int) -> DataFrame:
    codes = _hash_words(words.select("word").distinct(), seed)
    parts = phrases.select("lang", "codes", "f", F.posexplode("codes").alias("at", "code")).join(codes, "code")
    ordered = F.array_sort(F.collect_list(F.struct("at", "word")))
    return parts.groupBy("lang", "codes", "f").agg(F.array_join(F.transform(ordered, lambda x: x["word"]), " ").alias("phrase"))


def collocations(docs: DataFrame, least: int = LEAST, kept: int = KEPT, covered: int = COVERED, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `kept` phrases of two words or more. A phrase is dropped if a longer one that holds it
    occurs at least `covered` percent as often."""
    every, totals = mine(docs, least, text, lang)
    of = lambda side: every.select(F.col("lang").alias("lang"), F.col("phrase").alias(side), F.col("f").alias(side[0]))
    long = every.where("words > 1").withColumn("w", F.split("phrase", " "))
    joined = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    ways = long.select("lang", "phrase", "words", "w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    ways = ways.select("lang", "phrase", "words", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    both = ways.join(of("left"), ["lang", "left"]).join(of("right"), ["lang", "right"])
    score = F.expr("CAST((CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0))) DIV CAST(l + r AS DECIMAL(19, 0)) AS BIGINT)")
    scored = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"))
    inner = long.where("words > 2").select("lang", "f", F.explode(F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(w, i, m), ' '))))")).alias("phrase"))
    over = inner.groupBy("lang", "phrase").agg(F.max("f").alias("over"))
    exact = lambda c, by: F.col(c).cast("decimal(19,0)") * F.lit(by)
    free = scored.join(over, ["lang", "phrase"], "left").where(F.col("over").isNull() | (exact("over", 100) < exact("a", covered)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("x.score"), F.desc("a"), "phrase"))
    best = free.withColumn("rank", place).where(F.col("rank") <= kept).join(totals, "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), "n", F.col("x.score").alias("score"))


def _oracle() -> str:
    grams = " UNION ALL ".join(
        f"SELECT lang, {" || ' ' || ".join(['w'] + [f'w{i}' for i in range(1, k)])} AS phrase, {k} AS words, count(*)::BIGINT AS f FROM win" + (f" WHERE w{k - 1} IS NOT NULL" if k > 1 else "") + f" GROUP BY ALL HAVING count(*) >= {LEAST}"
        for k in range(1, WORDS + 1)
    )
    return f"""
WITH p AS (SELECT lang, row_number() OVER () AS piece, t FROM (SELECT coalesce(lang, '{UNKNOWN}') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS t FROM documents)),
tok AS (SELECT lang, piece, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT lang, piece, regexp_extract_all(t, '[^\\x20\\x09]+') AS w FROM p)),
win AS (SELECT lang, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3 FROM tok WINDOW o AS (PARTITION BY piece ORDER BY i)),
total AS (SELECT lang, count(*)::BIGINT AS n FROM tok GROUP BY lang),
g AS MATERIALIZED ({grams}),
c AS (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS w FROM g WHERE words > 1),
cuts AS (SELECT c.*, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM c, range(1, {WORDS}) t(k) WHERE k < words),
s AS (SELECT cuts.lang, cuts.phrase, a, k, gl.f AS l, gr.f AS r, ((2000000::HUGEINT * a) // (gl.f + gr.f))::BIGINT AS score
  FROM cuts JOIN g gl ON gl.lang = cuts.lang AND gl.phrase = x JOIN g gr ON gr.lang = cuts.lang AND gr.phrase = y),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longest FROM c, range(2, {WORDS}) u(m), range(1, {WORDS}) t(i) WHERE m < words AND i + m - 1 <= words GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM best b JOIN total USING (lang) LEFT JOIN inside x ON x.lang = b.lang AND x.phrase = b.phrase
WHERE longest IS NULL OR 100 * longest::HUGEINT < {COVERED} * a::HUGEINT QUALIFY rank <= {KEPT}
"""


ORACLE = _oracle()
