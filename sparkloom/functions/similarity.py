"""Overlap of two texts: longest shared span, ROUGE-L; and the paragraph packer."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET, LONGEST, SHORTEST = 1500, 2200, 200


#: A word of a span: letters, digits, underscores and section signs.
_SPAN_WORD = re.compile(r"[\w§]+")


def _span_words(text: str | None) -> list[str]:
    return _SPAN_WORD.findall((text or "").lower())


class Runs:
    """A suffix automaton of a text's words, through which other texts stream in linear time, however often words repeat."""

    def __init__(self, words: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]  # by state: where a word leads
        self.link, self.size = [-1], [0]  # the state of the longest run with other ends; words of a state's longest run
        last = 0
        for w in words:
            new = self._state({}, 0, self.size[last] + 1)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.size[q] > self.size[p] + 1:  # q also stands for longer runs: its shorter ones get a state of their own
                    short = self._state(dict(self.next[q]), self.link[q], self.size[p] + 1)
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = short
                        p = self.link[p]
                    self.link[q] = q = short
                self.link[new] = q
            last = new

    def _state(self, leads: dict[str, int], link: int, size: int) -> int:
        self.next.append(leads)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def longest(self, words: list[str], most: int) -> int:
        """Words of the longest run shared with the automaton's text, at most so many."""
        best = at = n = 0
        for w in words:
            while at and w not in self.next[at]:
                at = self.link[at]
                n = self.size[at]
            if w in self.next[at]:
                at, n = self.next[at][w], n + 1
                if n > best:
                    best = n
                    if best >= most:
                        return most
        return best


def longest_span(a: str | None, b: str | None, most: int = 400) -> int:
    """Words of the longest run that both texts hold whatever its case, at most so many."""
    return Runs(_span_words(b)).longest(_span_words(a), most)


_WORD = re.compile(r"[\w§]+")


def longest_span(a: str | None, b: str | None, most: int = 400) -> int:
    """Words of the longest run that both texts hold whatever its case, at most so many: suffix lengths in one pass over the
    positions of equal words."""
    x, y = _SPAN_WORD.findall((a or "").lower()), _SPAN_WORD.findall((b or "").lower())
    where: dict[str, list[int]] = {}
    for j, w in enumerate(y):
        where.setdefault(w, []).append(j)
    best, last = 0, {}
    for w in x:
        now = {}
        for j in where.get(w, ()):
            now[j] = n = min(last.get(j - 1, 0) + 1, most)
            best = max(best, n)
        last = now
    return best


_WORD = re.compile(r"[a-z0-9]+")


def rouge_l(answer: str | None, target: str | None) -> float:
    """F1 of the longest common subsequence of lower-cased [a-z0-9]+ tokens, by bit vectors."""
    a, b = _WORD.findall((answer or "").lower()), _WORD.findall((target or "").lower())
    if not a or not b:
        return 0.0
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & at.get(w, 0)
        v = ((v + u) | (v - u)) & full
    n = len(a) - v.bit_count()
    return 2 * n / (len(a) + len(b))


def with_longest_span(pairs: DataFrame, a: str, b: str, name: str = "span", most: int = 400) -> DataFrame:
    """pairs with the words of the longest run that both texts share. In each batch an automaton is made once for each text of b, one at a
    time, and all of its texts of a stream through it."""
    from ..session import ship

    ship(pairs.sparkSession)

    @F.pandas_udf("int")
    def span(x: pd.Series, y: pd.Series) -> pd.Series:
        out = pd.Series(0, index=x.index)
        for text, texts in x.groupby(y.fillna("")):
            runs = Runs(_span_words(text))
            out[texts.index] = [runs.longest(_span_words(t), most) for t in texts]
        return out

    return pairs.withColumn(name, span(a, b))


def with_rouge(pairs: DataFrame, answer: str, target: str, name: str = "rouge_l") -> DataFrame:
    from ..session import ship

    ship(pairs.sparkSession)

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([rouge_l(p, q) for p, q in zip(x, y)])

    return pairs.withColumn(name, score(answer, target))


# Fixed value: where a sentence ends.
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-ZÄÖÜ„(§])")


def split_long(text: str, target: int = TARGET) -> list[str]:
    """A long paragraph as runs of whole sentences of at most target characters, where sentences allow."""
    runs: list[list[str]] = []
    size = 0
    for s in _SENTENCE.split(text):
        if runs and size + 1 + len(s) <= target:
            runs[-1].append(s)
            size += 1 + len(s)
        else:
            runs.append([s])
            size = len(s)
    return [" ".join(run).strip() for run in runs if any(run)]


def with_runs(docs: DataFrame, text: str, name: str, target: int = TARGET) -> DataFrame:
    """docs with the runs of sentences of each text."""
    import pyarrow as pa

    from ..session import row_function

    return docs.withColumn(name, row_function(docs.sparkSession, lambda t: split_long(t or "", target), "array<string>", pa.list_(pa.string()))(text))


def pack(paragraphs: list[tuple[int | None, str]], target: int = TARGET) -> list[tuple[str, int | None, int | None]]:
    """(text, first number, last number) of chunks of whole paragraphs.

    A chunk closes when the next paragraph would take it beyond the target, if it holds half of that; a
    short last chunk joins the one before. Only paragraphs beyond LONGEST are split."""
    chunks: list[list[tuple[int | None, str]]] = []
    size = 0
    for number, text in paragraphs:
        for part in split_long(text, target) if len(text) > LONGEST else [text]:
            if chunks and not (size + len(part) > target and size >= target // 2):
                chunks[-1].append((number, part))
            else:
                chunks.append([(number, part)])
                size = 0
            size += len(part) + 1
    if len(chunks) > 1 and sum(len(t) for _, t in chunks[-1]) < SHORTEST:
        tail = chunks.pop()
        chunks[-1] += tail
    out = []
    for c in chunks:
        numbers = [n for n, _ in c if n is not None]
        out.append(("\n".join(t for _, t in c), numbers[0] if numbers else None, numbers[-1] if numbers else None))
    return out


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(chunk_id, key, chunk_ix, text, rd_first, rd_last, n_chars): the paragraphs of each text, packed. A number at a
    paragraph's head in brackets or before a tab is its marginal number."""
    import pyarrow as pa

    from ..session import row_function

    def one(t):
        return [{"text": c, "rd_first": a, "rd_last": b} for c, a, b in pack(_numbered(t or ""))]

    chunk = pa.struct([("text", pa.string()), ("rd_first", pa.int32()), ("rd_last", pa.int32())])
    packed = row_function(docs.sparkSession, one, "array<struct<text:string,rd_first:int,rd_last:int>>", pa.list_(chunk))
    rows = docs.select(key, F.posexplode(packed(text)).alias("chunk_ix", "c"))
    name = F.concat(F.col(key).cast("string"), F.lit("#"), F.lpad(F.col("chunk_ix").cast("string"), 3, "0"))
    return rows.select(name.alias("chunk_id"), key, "chunk_ix", "c.text", "c.rd_first", "c.rd_last", F.length("c.text").alias("n_chars"))


_NUMBER = re.compile(r"\[(\d+)\]\s*|(\d+)\t")


def _numbered(text: str) -> list[tuple[int | None, str]]:
    out = []
    for p in text.split("\n"):
        if p := p.strip():
            m = _NUMBER.match(p)
            out.append((int(m[1] or m[2]), p[m.end() :]) if m and p[m.end() :] else (None, p))
    return out
