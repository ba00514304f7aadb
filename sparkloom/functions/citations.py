"""Statutory citations: a scanner for texts, a parser for norm chains, keys and jurisdictions.

A citation is an anchor (§, §§, Art.), a section, qualifiers and a law book. The scanner goes token by
token and stops at the first token that can be a book, so its cost is linear; at most 25 qualifiers
and 60 characters may stand between section and book."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TOKENS, MAX_CHARS = 25, 60
#: Entries of norm chains that a worker keeps with their keys.
ENTRIES = 1 << 14

#: Suffixes of the Länder that belong to a book's name.
LAND = "Bln NRW NW BW BY BE BB HB HH HE MV NI RP SL SN ST LSA SH TH".split()
#: Capitalised words that mark subdivisions.
MARKERS = "Abs Absatz Nr Nrn Nummer S Satz Sätze Halbsatz Hs Alt Var Fall Rn Rz Anm Ziff Buchst Anlage Art Artikel Unterabs UAbs".split()
#: Words that stand where a book is expected but are none.
NON_BOOKS = set(
    "Abs Absatz Nr Nrn Nummer S Satz Sätze Halbsatz Hs Alt Var Buchst Rn Rz Anm Fall Ziff Anlage "
    "Nach Der Die Das Ein Eine Es Im In Bei Da Denn Dies Diese Dieser Dabei Damit Danach Dann Daher Dazu "
    "Fraglich Somit Also Zudem Zwar Aber Auch Alternativ Vgl Siehe Ergebnis Hier Hierzu Hieraus Folglich Mithin "
    "Wenn Weil Wie Wird Ist Sind Kann Könnte Muss Soll Er Sie Und Oder Sowie Jedoch Allerdings Zunächst "
    "Insoweit Insofern Schließlich Ferner Weiterhin Demnach Vorliegend Sachverhalt Klage Antrag Bescheid Gericht".split()
)
#: Books of state law, and books known to be federal.
STATE_BOOKS = set(
    "bv baybo bayvwvfg bayvwzvg vwzvg pag pog lstvg go baygo lkro bezo agvwgo baywg bayversg bayksg vfghg baydsg bayeug "
    "bayhschg bayhig baynatschg bayimschg baystrwg bayabfg sgk kag bayrs bayvbl aggvg baygastv bayifsmv bayltgescho gltrg "
    "bayfig bayhg bayrig asog sog lbo lbauo bauo polg sogmv nposg lvwg lvwvfg gonrw lstvgnrw ordbg lvwvg".split()
) | {"go nrw"}
FEDERAL_BOOKS = set(
    "gg vwgo vwvfg vwvg baugb baunvo bimschg bgb stgb stpo zpo gvg owig bverfgg beamtstg bbg gewo gastg waffg versammlg stvo "
    "stvg fev ifsg tierschg aufenthg rog uvpg tkg telemediengesetz urhg gmbhg brao bnoto sgb estg ao hgb partg bwahlg aeuv euv grch".split()
)
#: A book's key in the corpus, where it differs from the one cited.
ALIASES = {
    "baugb": "bbaug", "baypag": "pag", "bayverf": "bv", "baygo": "go", "baylstvg": "lstvg", "bayagvwgo": "agvwgo", "bayvfghg": "vfghg",
    "baylkro": "lkro", "bayvwzvg": "vwzvg", "baykommzg": "kommzg", "baykag": "kag", "baybezo": "bezo", "bpolg": "bgsg",
}

# The forms of an anchor, a section, a book and the qualifiers between them.
_ANCHOR = re.compile(r"§§|§|Artikel|Art\.|Art(?=\s)")
_SECTION = re.compile(r"\s*(\d+(?:\s?[a-z](?![a-zäöüß.]))?)")
_BOOK = re.compile(r"\s+([A-ZÄÖÜ][A-Za-z0-9ÄÖÜäöüß-]{1,24}(?:\s+(?:" + "|".join(LAND) + r")\b)?)")
_MARKER = re.compile(r"(?:" + "|".join(sorted(MARKERS, key=len, reverse=True)) + r"|[IVXL]{1,5})\b")
#: What may stand between: inner anchors, numbers, marks, small words, separators.
_TOKEN = re.compile(
    r"\s*(?:(?P<anchor>§§|§|Artikel|Art\.?)|(?P<number>\d+(?:\s?[a-z](?![a-zäöüß.]))?)|(?P<separator>,|;|und\b|bis\b|sowie\b|oder\b)"
    r"|(?P<mark>(?:Absatz|Abs\.?|Sätze|Satz|S\.|Halbsatz|Halbs\.?|Hs\.?|Nummer|Nrn?\.?|Alt\.?|Var\.?|Fall|Buchst\.?|i\.\s?V\.\s?m(?:\.|it)|iVm|bzw\.|lit\.?|ff?\.|[IVXL]{1,5}\b))|(?P<word>[a-z]+\)?))"
)
_ROMAN = re.compile(r"[IVXL]{1,5}")


class Citation(NamedTuple):
    book: str
    section: str
    form: str
    text: str
    start: int


def _squeeze(s: str) -> str:
    return "".join(s.split())


def extract(text: str | None) -> list[Citation]:
    """Citations in order; an enumeration or chain gives one for each section, in order, each once."""
    out: list[Citation] = []
    if not text:
        return out
    at = 0
    while anchor := _ANCHOR.search(text, at):
        at = anchor.end()
        section = _SECTION.match(text, at)
        if not section:
            continue
        found = _to_book(text, section.end())
        if not found:
            continue
        book, end, tokens = found
        head = book.split()[0]
        at = end
        if head in NON_BOOKS or _ROMAN.fullmatch(head):
            continue
        form = "Art" if anchor.group().startswith("Art") else "Par"
        sections = [_squeeze(section[1]), *_further(tokens, anchor.group() == "§§")]
        out += [Citation(book, s, form, text[anchor.start() : end], anchor.start()) for s in dict.fromkeys(sections)]
    return out


def _to_book(text: str, at: int) -> tuple[str, int, list[tuple[str, str]]] | None:
    """The book after a section, where it ends, and the tokens before it."""
    begin, tokens, budget = at, [], MAX_TOKENS
    while at - begin <= MAX_CHARS:
        book = _BOOK.match(text, at)
        if book and not _MARKER.match(text, book.start(1)):
            return " ".join(book[1].split()), book.end(), tokens
        token = _TOKEN.match(text, at)
        if not token or token.end() == at:
            return None
        kind, value = token.lastgroup or "", token.group(token.lastgroup or 0)
        budget -= -(-len(value) // 2) if kind == "word" else 1
        if budget < 0:
            return None
        tokens.append((kind, value))
        at = token.end()
    return None


def _further(tokens: list[tuple[str, str]], listed: bool) -> list[str]:
    """Sections among the qualifiers: after an inner anchor always; in a list (§§) also numbers that stand
    alone between separators."""
    after_list, after_anchor = [], []
    for i, (kind, value) in enumerate(tokens):
        if kind != "number" or not i:
            continue
        if tokens[i - 1][0] == "anchor":
            after_anchor.append(_squeeze(value))
        elif listed and tokens[i - 1][0] == "separator" and (i + 1 == len(tokens) or tokens[i + 1][0] == "separator"):
            after_list.append(_squeeze(value))
    return after_list + after_anchor


def canonicalise(found: list[Citation]) -> list[Citation]:
    """Without books cut at a line's end; a footnote's number goes if the same list has the book without it."""
    names = {c.book.lower() for c in found}
    out = []
    for c in found:
        if c.book.endswith("-"):
            continue
        bare = c.book.rstrip("0123456789")
        out.append(c._replace(book=bare) if bare != c.book and len(bare) > 1 and bare.lower() in names else c)
    return out


def corpus_key(book: str) -> str:
    key = _squeeze(re.sub(r"\s+(?:19|20)\d\d$", "", book.strip())).lower().replace(".", "")
    return ALIASES.get(key, key)


def corpus_key_column(book: Column) -> Column:
    """The same as a column."""
    key = F.replace(F.lower(F.regexp_replace(F.regexp_replace(F.trim(book), r"\s+(?:19|20)\d\d$", ""), r"\s+", "")), F.lit("."), F.lit(""))
    table = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.coalesce(F.element_at(table, key), key)


def chain(entries: list[str]) -> list[tuple[str, str]]:
    """(corpus key, section) of norm chains that name the book first, in order, each once."""
    return list(dict.fromkeys(key for entry in entries for key in _entry(entry)))


@lru_cache(ENTRIES)
def _entry(entry: str) -> tuple[tuple[str, str], ...]:
    """Keys of one entry. Decisions repeat each other's entries, so a worker keeps the last ones."""
    out: dict[tuple[str, str], None] = {}
    for part in entry.split("|"):
        part = part.strip()
        first = re.search(r"(?:§§|§|Artikel|Art\.?)\s*\d", part)
        book = part[: first.start()].strip(" ,;") if first else ""
        if first and book:
            pieces = [p.strip(" ,;") for p in re.split(r"(?=(?:§§|§|Art\.)\s*\d)", part[first.start() :])]
            pieces = [f"{p} {book}" for p in pieces if p]
        else:
            pieces = [part]
        for p in pieces:
            out.update({(corpus_key(c.book), c.section.lower()): None for c in canonicalise(extract(p))})
    return tuple(out)


def jurisdiction(book: Column, in_corpus: Column) -> Column:
    """state, federal or unknown: state books first, then membership in the corpus, then known books."""
    b = F.lower(book)
    return F.when(b.isin(sorted(STATE_BOOKS)) | b.startswith("bay"), "state").when(in_corpus | b.isin(sorted(FEDERAL_BOOKS)), "federal").otherwise("unknown")


SCHEMA = "array<struct<book:string,section:string,form:string,text:string,start:int>>"


def with_citations(docs: DataFrame, text: str = "text", name: str = "citations", clean: bool = True) -> DataFrame:
    """docs with their citations in a further column. Texts without an anchor never reach Python."""
    import pyarrow as pa

    from ..session import row_function

    def one(t):
        return [c._asdict() for c in (canonicalise(extract(t)) if clean else extract(t))]

    citation = pa.struct([(n, pa.int32() if n == "start" else pa.string()) for n in Citation._fields])
    scan = row_function(docs.sparkSession, one, SCHEMA, pa.list_(citation))
    has = F.col(text).contains("§") | F.col(text).contains("Art")
    return docs.withColumn(name, F.when(has, scan(F.when(has, F.col(text)).otherwise(""))).otherwise(F.array().cast(SCHEMA)))


def with_chain(docs: DataFrame, entries: str = "norm_chain", name: str = "norms") -> DataFrame:
    """docs with the norm keys of an array of chain entries."""
    import pyarrow as pa

    from ..session import row_function

    def one(entries):
        return [{"book": b, "section": s} for b, s in chain([x for x in entries or [] if x])]

    norm = pa.struct([("book", pa.string()), ("section", pa.string())])
    parse = row_function(docs.sparkSession, one, "array<struct<book:string,section:string>>", pa.list_(norm))
    return docs.withColumn(name, parse(entries))


def norm_of(row: Column) -> Column:
    """The first section after an anchor; null if there is none."""
    return F.nullif(F.regexp_extract(row, r"(?:§§?|Art\.?|Artikel)\s*(\d+\s?[a-z]?)", 1), F.lit(""))


def context_norms(prompt: Column) -> Column:
    """What a prompt's <norm zitat="…"> elements and [SOURCE n: …] heads name."""
    elements = F.regexp_extract_all(prompt, F.lit(r'<norm zitat="([^"]+)"'), F.lit(1))
    heads = F.regexp_extract_all(prompt, F.lit(r"\[SOURCE \d+: ([^\]]+)\]"), F.lit(1))
    return F.concat(elements, heads)


def provenance(text: Column, editorial_span: Column) -> Column:
    """amtlich, redaktionell or unmarked; a span marked as editorial decides."""
    return (
        F.when(editorial_span, "redaktionell")
        .when(text.rlike(r"(?i)\(\s*redaktioneller? leits[aä]tz|\(red\.? ?ls"), "redaktionell")
        .when(text.rlike(r"(?i)\(\s*amtlicher? leits[aä]tz"), "amtlich")
        .otherwise("unmarked")
    )


def display(book: Column, section: Column, form: Column) -> Column:
    """A citation as it is written: Art. 1 GG, § 42 VwGO."""
    return F.concat(F.when(form == "Art", "Art. ").otherwise("§ "), section, F.lit(" "), book)


def heading(book: Column, section: Column, form: Column, title: Column, where: Column) -> Column:
    """A block's head: citation, title, jurisdiction label."""
    label = F.when(where == "state", "Landesrecht").when(where == "federal", "Bundesrecht").otherwise("")
    return F.trim(F.concat_ws(" – ", display(book, section, form), F.nullif(title, F.lit("")), F.nullif(label, F.lit(""))))
