"""What brings data in from outside: files fetched once, a paged portal, a catalogue service, PDF pages.

A service is a function that the caller passes (`fetch`), so nothing here opens a connection by itself."""

from __future__ import annotations

import hashlib
import json
import re
import time
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import _fs, exists


# --- files ---


def fetch_once(spark: SparkSession, path: str, fetch: Callable[[], bytes], sha256: str | None = None) -> bool:
    """Put what fetch() gives at a path, unless a file is there already; whether it was fetched. A file is there whole or not at
    all, and contents with another checksum than the pinned one are an error and leave nothing."""
    if exists(spark, path):
        return False
    data = fetch()
    if sha256 and hashlib.sha256(data).hexdigest() != sha256:
        raise ValueError(f"{path}: not the pinned contents")
    fs, part = _fs(spark, f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(data))
    out.close()
    if not fs.rename(part, _fs(spark, path)[1]):
        raise OSError(f"{path} was not written")
    return True


# --- a paged portal ---


class Blocked(Exception):
    """The portal refuses: going on would make it worse."""


def crawl(spark: SparkSession, keys: list[str], fetch: Callable[[str, int], tuple[int, str]], parse: Callable[[str], list[str]], path: str, pause: float = 1.0, tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(key, page, hit) of every key's result pages, first page 1, until a page has no new hit.

    One page is asked for at a time, with a pause before each. 403 and 429 end the crawl (Blocked); 5xx is tried again,
    with longer pauses. A key's hits are written when all its pages are read, and a later run goes on with the keys
    that aren't there."""
    schema = "key string, page int, hit string"
    done = {r[0] for r in spark.read.schema(schema).json(path).select("key").distinct().collect()} if exists(spark, path) else set()
    for key in keys:
        if key in done:
            continue
        rows, seen, page = [(key, 0, None)], set(), 1
        while True:
            new = [h for h in dict.fromkeys(parse(_page(fetch, key, page, pause, tries, sleep))) if h not in seen]
            if not new:
                break
            seen.update(new)
            rows += [(key, page, h) for h in new]
            page += 1
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(path)
    return spark.read.schema(schema).json(path).where("hit IS NOT NULL") if exists(spark, path) else spark.createDataFrame([], schema)


def _page(fetch, key: str, page: int, pause: float, tries: int, sleep) -> str:
    for n in range(tries):
        sleep(pause * 2**n)
        status, body = fetch(key, page)
        if status in (403, 429):
            raise Blocked(f"{key}, page {page}: {status}")
        if status < 500:
            return body
    raise OSError(f"{key}, page {page}: {status}")


# --- a catalogue service ---


def read_catalogue(spark: SparkSession, fetch: Callable[[str | None], str], schema: str) -> DataFrame:
    """Rows of a JSON service: each answer holds `data`, and in `next` the name of the answer after it, if there is one."""
    rows, name = [], None
    while True:
        answer = json.loads(fetch(name))
        rows += [json.dumps(x) for x in answer.get("data") or []]
        name = answer.get("next")
        if not name:
            break
    lines = spark.createDataFrame([(x,) for x in rows], "line string")
    return lines.select(F.from_json("line", schema).alias("x")).select("x.*")


# --- PDF ---

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
#: Strings, arrays of strings, numbers and operators of a page's text.
_PIECE = re.compile(rb"\((?:\\.|[^()\\])*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(piece: bytes) -> str:
    if piece[:1] == b"<":
        digits = re.sub(rb"\s", b"", piece[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")
    octal = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1])
    return re.sub(rb"\\([0-7]{1,3}|.)", octal, piece[1:-1], flags=re.S).decode("latin-1")


def _lines(content: bytes) -> list[str]:
    """Shown strings; an operator that moves to another line begins a new one."""
    lines, line, strings, numbers = [], [], [], []
    for piece in _PIECE.findall(content):
        if piece[:1] in (b"(", b"<"):
            strings.append(_string(piece))
        elif piece in (b"[", b"]"):
            continue
        elif re.fullmatch(rb"[-+]?\d*\.?\d+", piece):
            numbers.append(float(piece))
        else:
            moves = piece in (b"T*", b"'", b'"', b"ET") or piece in (b"Td", b"TD") and numbers[-1:] not in ([], [0.0]) or piece == b"Tm"
            if moves and line:
                lines.append("".join(line))
                line = []
            if piece in (b"Tj", b"TJ", b"'", b'"'):
                line += strings
            strings, numbers = [], []
    return [*lines, "".join(line)] if line else lines


def pdf_pages(data: bytes) -> list[list[str]]:
    """Lines of each page of a PDF whose texts are plain or deflated and in one-byte encodings."""
    objects = {int(n): body for n, body in _OBJECT.findall(data)}

    def content(number: int) -> bytes:
        body = objects.get(number, b"")
        found = _STREAM.search(body)
        if not found:
            return b"".join(content(int(r)) for r in _REFERENCE.findall(body))
        return zlib.decompress(found[1]) if b"FlateDecode" in body[: found.start()] else found[1]

    def below(number: int, seen: frozenset) -> Iterator[int]:
        body = objects.get(number, b"")
        if number in seen:
            return
        if re.search(rb"/Type\s*/Pages\b", body):
            kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
            for r in _REFERENCE.findall(kids[1] if kids else b""):
                yield from below(int(r), seen | {number})
        elif re.search(rb"/Type\s*/Page\b", body):
            yield number

    catalog = next((b for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
    root = re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", catalog)
    pages = []
    for n in below(int(root[1]), frozenset()) if root else ():
        names = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", objects[n], re.S)
        pages.append(_lines(b"\n".join(content(int(r)) for r in _REFERENCE.findall(names[1])) if names else b""))
    return pages


def read_pdfs(spark: SparkSession, path: str, pages: Callable[[bytes], list[list[str]]] = pdf_pages, suffix: str = "pdf") -> DataFrame:
    """(filename, pages array<array<string>>, error) of the files under a folder. A file that can't be read has an error and no
    pages. `pages` may be another reader of a file's bytes."""
    from ..session import ship

    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(path)

    def read(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for name, data in zip(f["filename"], f["content"]):
                try:
                    rows.append((name, pages(bytes(data)), None))
                except Exception as e:  # what a broken file raises isn't known here
                    rows.append((name, None, repr(e)))
            yield pd.DataFrame(rows, columns=["filename", "pages", "error"])

    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content").mapInPandas(read, "filename string, pages array<array<string>>, error string")
