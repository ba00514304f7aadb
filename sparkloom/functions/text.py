"""Text functions as columns: normalising, splitting, cleaning, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The space separators of Unicode, and the characters of no width.
SPACE_SEPARATORS = "               　"
ZERO_WIDTH = "​‌‍⁠﻿"
#: Hyphens and dashes that stand for a plain hyphen.
HYPHENS = "‐‑‒–—−"


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often it occurs, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spacing(text: Column) -> Column:
    """All space separators as plain spaces, characters of no width gone."""
    return F.translate(text, SPACE_SEPARATORS + ZERO_WIDTH, " " * len(SPACE_SEPARATORS))


def typography(text: Column) -> Column:
    return F.translate(spacing(text), HYPHENS, "-" * len(HYPHENS))


def short_name(model: Column) -> Column:
    """The last segment of a path-like name."""
    return F.element_at(F.split(model, "/"), -1)


def model_key(model: Column) -> Column:
    """A name under which spellings of a model meet."""
    out = F.replace(F.lower(short_name(model)), F.lit("_"), F.lit("-"))
    out = F.regexp_replace(out, r"-fp8(-[a-z]+)?$", "")
    return F.replace(out, F.lit("-a3b"), F.lit(""))


def alias(name: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.element_at(table, name), name)


def judge_name(column: Column) -> Column:
    """The judge in a column's name such as `score_Judge (X)`."""
    return F.nullif(F.regexp_extract(column, r"^score_Judge \((.*)\)$", 1), F.lit(""))


def missing_answer(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "") | (F.lower(F.trim(text)) == "nan")


def refusal(text: Column, marks: list[str], length: int = 3000, head: int = 400) -> Column:
    """A short answer with one of the marks in its first characters."""
    start = F.lower(F.substring(text, 1, head))
    found = F.lit(False)
    for m in marks:
        found = found | F.contains(start, F.lit(m))
    return (F.length(text) < length) & found


def structural(title: Column) -> Column:
    """Rows of a corpus that hold no norm: formulas, annexes, contents."""
    return F.coalesce(title.rlike(r"(?i)(eingangsformel|schlussformel|inhaltsübersicht|inhaltsverzeichnis|^anlage|^anhang)"), F.lit(False))


def unwrap(text: Column) -> Column:
    """Hard-wrapped text as paragraphs: a hyphen at a line's end goes before a small letter and stays
    before a capital; single line feeds become spaces, double ones stay."""
    out = F.regexp_replace(text, r"-\n(?=\p{Ll})", "")
    out = F.regexp_replace(out, r"-\n(?=\p{Lu})", "-")
    out = F.regexp_replace(out, r"(?<!\n)\n(?!\n)", " ")
    return F.trim(F.regexp_replace(out, r"[ \t]+", " "))


def clean_lines(text: Column, least: int = 12, most: int = 8) -> Column:
    """Lines without bullets, of some length, the first of equal ones (whatever their case), at most so many."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", "")))
    lines = F.filter(lines, lambda x: F.length(x) >= least)

    def first(ls: Column) -> Column:
        lower = F.transform(ls, lambda x: F.lower(x))
        return let(lower, lambda low: F.slice(F.transform(F.array_distinct(low), lambda k: F.element_at(ls, F.array_position(low, k).cast("int"))), 1, most))

    return let(lines, first)


def search_string(text: Column, words: int = 350) -> Column:
    """Letters, digits, § and spaces, in lower case, of at most so many words."""
    clean = F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, r"(?U)[^\w§ ]+", " ")), r" +", " "))
    return F.array_join(F.slice(F.split(clean, " "), 1, words), " ")


def sub_queries(text: Column, least: int = 12) -> Column:
    """A query's lines longer than so much; the whole if there are none."""
    parts = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > least)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.trim(text)))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=\p{Lu})"), lambda x: F.trim(x)), lambda x: x != "")


def sentence_groups(text: Column, groups: int = 6) -> Column:
    """About so many runs of consecutive sentences."""

    def runs(s: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.size(s) / groups).cast("int"))
        starts = F.when(F.size(s) > 0, F.sequence(F.lit(1), F.size(s), size)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(s, i, size), " "))

    return let(sentences(text), runs)


def paragraphs(text: Column, least: int = 1) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)


def longest_sentences(text: Column, n: int) -> Column:
    """The n longest sentences, longest first, earlier ones first among equals."""
    s = F.transform(sentences(text), lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("s")))
    return F.slice(F.transform(F.array_sort(s), lambda x: x["s"]), 1, n)


def word_chunks(text: Column, words: int = 120, most: int = 12) -> Column:
    """Runs of so many words; if there are too many, so many of them at even distances."""

    def runs(w: Column) -> Column:
        n = F.ceil(F.size(w) / words).cast("int")
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        chosen = F.when(n > most, F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.rint(i * (n - 1) / (most - 1)).cast("int"))).otherwise(starts)
        return F.transform(chosen, lambda i: F.array_join(F.slice(w, i * words + 1, words), " "))

    return let(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""), runs)


def docket(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^0-9a-z]", "")


def clean_html(html: Column) -> Column:
    """Markup gone, the common entities read, white space as single spaces."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def clean_headnote(text: Column) -> Column:
    """Without its number, and without the parentheses it ends in."""
    out = F.regexp_replace(F.trim(text), r"^(?:\d+[.)]|[a-z]\))\s*", "")
    return F.trim(F.regexp_replace(out, r"(\s*\([^()]{2,60}\))+\z", ""))


def embed_text(title: Column, body: Column, most: int = 4000) -> Column:
    return F.concat_ws("\n", title, F.substring(body, 1, most))


def strip_thinking(text: Column) -> Column:
    """Without a <think> part; trimmed only if there was one."""
    has = text.rlike(r"(?is)<think>.*?</think>")
    return F.when(has, F.trim(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))).otherwise(text)


def last_score(text: Column) -> Column:
    """The last [[n]] in a judgement, with a decimal point or comma."""
    found = F.regexp_extract_all(text, F.lit(r"\[\[\s*(\d+(?:[.,]\d+)?)\s*\]\]"), F.lit(1))
    return F.replace(F.try_element_at(found, F.lit(-1)), F.lit(","), F.lit(".")).try_cast("double")


def leading_number(cell: Column) -> Column:
    """The number that a cell such as `12.5$_{±0.3}$` begins with."""
    return F.nullif(F.regexp_extract(cell, r"^\s*\$?(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")


def iso_date(text: Column) -> Column:
    """DD.MM.YYYY as an ISO date; null if it is none."""
    return F.date_format(F.try_to_timestamp(text, F.lit("dd.MM.yyyy")), "yyyy-MM-dd")


def python_dict_json(cell: Column) -> Column:
    """A stringified dict as JSON: None, True and False outside quotes rewritten. Single quotes are for
    the reader to accept."""
    out = F.regexp_replace(cell, r"(?<=[\[{,:\s])None(?=[\]},\s])", "null")
    out = F.regexp_replace(out, r"(?<=[\[{,:\s])True(?=[\]},\s])", "true")
    return F.regexp_replace(out, r"(?<=[\[{,:\s])False(?=[\]},\s])", "false")


def grid_level(score: Column) -> Column:
    return F.least(F.greatest(F.rint(score / 10), F.lit(0.0)), F.lit(10.0))


def jaccard(a: Column, b: Column, both_empty: float | None = 1.0) -> Column:
    """Of two arrays as sets. both_empty: 1 in scoring; in reports pass None, and an empty `b` gives null."""
    value = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    if both_empty is None:
        return F.when(F.size(b) > 0, value)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(both_empty)).otherwise(value)


def precision_recall(a: Column, b: Column) -> tuple[Column, Column]:
    """Of found `a` against wanted `b`; null where nothing is to be found or was."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) > 0, both / F.size(F.array_distinct(a))), F.when(F.size(b) > 0, both / F.size(F.array_distinct(b)))
