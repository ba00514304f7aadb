"""Scans with the missing-value rule at the boundary: NaN is read as null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import counted


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating columns with NaN as null; other columns stay bare, so filters on them reach the scan."""
    floats = {c for c, t in df.dtypes if t in ("double", "float")}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns]) if floats else df


# --- delimited and line formats ---


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with quoted line feeds; the schema is declared, and only the columns asked for are parsed."""
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')
    return nan_to_null(df.select(*columns) if columns else df)


def read_union(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Files with different columns as one table, missing columns null."""
    full = T.StructType.fromDDL(schema)
    out = None
    for p in paths:
        df = spark.read.csv(p, header=True, multiLine=True, escape='"')
        df = df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in full if f.name in df.columns])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return nan_to_null(out)


SEAT = "index long, model string, score double, judgement string, prompt_tokens long, completion_tokens long, seconds double, finish_reason string, error string"


def read_seat(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A seat's JSON lines; torn and blank lines drop out."""
    df = spark.read.schema(SEAT + ", _corrupt_record string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    df = df.where("_corrupt_record IS NULL AND index IS NOT NULL").drop("_corrupt_record")
    return df.select(*columns) if columns else df


# --- statutes and decisions ---


def parse_laws(spark: SparkSession, path: str) -> DataFrame:
    """(text, title, filename, law_book, paragraph) of the norms in XML files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(path)
    return norms_of(files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.decode("content", "UTF-8").alias("xml")))


def norms_of(files: DataFrame) -> DataFrame:
    """(text, title, filename, law_book, paragraph) of files (filename, xml).

    Each file is one document; its norms are rows. Norms without text drop out, missing names are 'unknown',
    the title is `book para: title` without trailing marks."""
    xml = files.select("filename", F.regexp_replace("xml", r"(?s)<\?xml[^>]*\?>|<!DOCTYPE[^>]*>", "").alias("xml"))
    norms = xml.select("filename", F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)(<norm\b.*?</norm>)"), F.lit(1))).alias("n"))
    first = lambda tag: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("n", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]+>", "")), F.lit(""))
    body = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("n", r"(?s)<textdaten>(.*)</textdaten>", 1), "<[^>]+>", " "), r"\s+", " "))
    rows = norms.select("filename", body.alias("text"), first("jurabk").alias("b"), first("enbez").alias("p"), first("titel").alias("t")).where("text <> ''")
    title = F.regexp_replace(F.concat(F.coalesce("b", F.lit("")), F.lit(" "), F.coalesce("p", F.lit("")), F.lit(": "), F.coalesce("t", F.lit(""))), r"^[:\s]+|[:\s]+$", "")
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    return rows.select("text", title.alias("title"), "filename", unknown("b").alias("law_book"), unknown("p").alias("paragraph"))


def first_snapshot(laws: DataFrame) -> DataFrame:
    """The first text of each (law_book, paragraph), by file name."""
    from ..operators.ranking import keep_one

    return keep_one(laws, ["law_book", "paragraph"], F.asc("filename"), F.asc("text"))


DECISION = "id string, court string, date string, file_number string, type string, norms array<string>, paragraphs array<struct<rd:int,text:string>>"


def parse_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Decisions in JSON: ISO date, docket key, text of the paragraphs, norm chain."""
    from ..functions.text import docket, iso_date

    df = spark.read.schema(DECISION).json(path)
    text = F.array_join(F.transform("paragraphs", lambda p: p["text"]), "\n")
    return df.select(F.col("id").alias("doc_id"), "court", iso_date(F.col("date")).alias("date"), "file_number", docket(F.col("file_number")).alias("az_key"), F.col("type").alias("doktyp"), F.coalesce("norms", F.array().cast("array<string>")).alias("norm_chain"), text.alias("text"), "paragraphs")


_HEADS = {"gertyp": "court", "entsch-datum": "date", "aktenzeichen": "file_number"}
_LISTS = {"norm": "norms", "absatz": "paragraphs"}


def decision_fields(xml: str | None) -> dict | None:
    """Fields of one decision's XML, read once: the text of the first element of each head at any depth, and the text nodes of all norms and
    paragraphs in order, as XPath has them."""
    from xml.parsers import expat

    if not xml:
        return None
    out: dict = {name: [] for name in _LISTS.values()}
    within: list[str] = []
    inside: dict[str, int] = {}
    held: list[str] = []

    def ended(*_) -> None:
        if held:
            text = "".join(held)
            held.clear()
            if within[-1] in _LISTS:
                out[_LISTS[within[-1]]].append(text)
            for head in inside:
                out[head] += text

    def start(name: str, _) -> None:
        ended()
        name = name.rpartition(":")[2]
        within.append(name)
        if (head := _HEADS.get(name)) and head not in out:
            out[head], inside[head] = "", len(within)

    def end(name: str) -> None:
        ended()
        if inside and inside.get(head := _HEADS.get(within[-1])) == len(within):
            del inside[head]
        within.pop()

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, held.append
    parser.CommentHandler = parser.ProcessingInstructionHandler = ended
    parser.Parse(xml, True)
    return out


def decision_xml(xml: Column) -> dict[str, Column]:
    """Fields of one decision's XML. An XPath expression would read the document anew for each of them."""
    import pyarrow as pa

    from ..session import row_function

    heads, lists = [(h, pa.string()) for h in _HEADS.values()], [(x, pa.list_(pa.string())) for x in _LISTS.values()]
    kind = ", ".join([f"{h} string" for h, _ in heads] + [f"{x} array<string>" for x, _ in lists])
    d = row_function(SparkSession.active(), decision_fields, kind, pa.struct(heads + lists))(xml)
    return {h: F.nullif(F.trim(d[h]), F.lit("")) for h, _ in heads} | {x: d[x] for x, _ in lists}


def hit_list(html: Column) -> Column:
    """Document numbers on a result page, each once."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"doc\.id=([A-Za-z0-9]+)"), F.lit(1)))


def norm_page(html: Column) -> tuple[Column, Column]:
    """(heading, text) of a page: the first heading or title without the `§ n ` before it."""
    from ..functions.text import clean_html

    head = clean_html(F.coalesce(F.nullif(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), F.lit("")), F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return F.regexp_replace(head, r"^(?:§|Art\.?)\s*\d+\s?[a-z]?\s+", ""), clean_html(F.regexp_replace(html, r"(?is)<head.*?</head>", " "))


def article_range(text: Column) -> Column:
    """The articles that `Art. lo-hi` stands for, if 0 < lo <= hi <= 400."""
    lo = F.regexp_extract(text, r"Art\. (\d+)\s*[-–]\s*(\d+)", 1).try_cast("int")
    hi = F.regexp_extract(text, r"Art\. (\d+)\s*[-–]\s*(\d+)", 2).try_cast("int")
    return F.when((lo > 0) & (lo <= hi) & (hi <= 400), F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def without_headers(pages: Column, deepest: int = 9, least: int = 5) -> Column:
    """Pages (arrays of lines) without a running head: the deepest line 1 .. 9 that is the same on all
    pages and long enough goes, with all above it. Line 0 alone is no head; one page has none."""
    same = lambda i: F.forall(pages, lambda p: F.coalesce((F.size(p) > i) & (F.try_element_at(p, i + 1) == F.try_element_at(F.element_at(pages, 1), i + 1)), F.lit(False)))
    long = lambda i: F.length(F.try_element_at(F.element_at(pages, 1), i + 1)) >= least
    depth = F.lit(0)
    for i in range(deepest, 0, -1):
        at = F.lit(i)
        depth = F.when((depth == 0) & (F.size(pages) > 1) & same(at) & F.coalesce(long(at), F.lit(False)), i + 1).otherwise(depth)
    return F.transform(pages, lambda p: F.slice(p, depth + 1, F.greatest(F.size(p), F.lit(1))))


def read_zips(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, content) of the zip files under a folder. Archives are files of one task each."""
    return zip_members(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def zip_members(files: DataFrame) -> DataFrame:
    """(archive, member, content) of archives (path, content), also of ones whose directory is broken: then the local
    headers are walked."""
    import pandas as pd

    from ..session import ship

    ship(files.sparkSession)

    def members(frames):
        for f in frames:
            rows = [(p, n, c) for p, blob in zip(f["path"], f["content"]) for n, c in unzip(blob)]
            yield pd.DataFrame(rows, columns=["archive", "member", "content"])

    return files.select("path", "content").mapInPandas(members, "archive string, member string, content binary")


def unzip(blob: bytes) -> list[tuple[str, bytes]]:
    import io
    import struct
    import zipfile
    import zlib

    try:
        with zipfile.ZipFile(io.BytesIO(blob)) as z:
            return [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
    except zipfile.BadZipFile:
        pass
    out, at = [], 0
    while (at := blob.find(b"PK\x03\x04", at)) >= 0 and at + 30 <= len(blob):
        method, packed = struct.unpack_from("<H", blob, at + 8)[0], struct.unpack_from("<I", blob, at + 18)[0]
        n, extra = struct.unpack_from("<HH", blob, at + 26)
        name, begin = blob[at + 30 : at + 30 + n].decode("utf-8", "replace"), at + 30 + n + extra
        try:
            if method == 8:
                d = zlib.decompressobj(-15)
                data = d.decompress(blob[begin:]) + d.flush()
                at = len(blob) - len(d.unused_data) if d.unused_data else len(blob)
            else:
                data, at = blob[begin : begin + packed], begin + packed
            out.append((name, data))
        except zlib.error:
            at = begin
    return out


# --- graphs, settings ---


def graph(edges: DataFrame, src: str, dst: str, src_kind: str, dst_kind: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges): vertices (kind, name) with dense numbers within each kind."""
    from ..operators.ranking import with_row_number
    from .sinks import scratch

    names = edges.select(F.lit(src_kind).alias("kind"), F.col(src).cast("string").alias("name")).union(edges.select(F.lit(dst_kind).alias("kind"), F.col(dst).cast("string").alias("name"))).distinct()
    vertices = with_row_number(names, ["kind"], ["name"], "id", scratch(edges.sparkSession, "vertices")).withColumn("id", F.col("id") - 1)
    s, d = (vertices.where(F.col("kind") == k).select(F.col("name").alias(f"{c}_name"), F.col("id").alias(c)) for k, c in ((src_kind, "src"), (dst_kind, "dst")))
    e = edges.join(s, F.col(src).cast("string") == F.col("src_name")).join(d, F.col(dst).cast("string") == F.col("dst_name"))
    return vertices, e.select("src", "dst")


def with_endpoint(models: DataFrame, endpoints: DataFrame, default: str) -> DataFrame:
    """models (model) with their endpoint, or the default."""
    return models.join(counted(endpoints), "model", "left").withColumn("endpoint", F.coalesce("endpoint", F.lit(default)))


def literal_table(spark: SparkSession, source: str, name: str) -> DataFrame:
    """A dict literal assigned to `name` in a source text, as (key, value) rows; the text isn't run."""
    import ast

    for node in ast.walk(ast.parse(source)):
        if isinstance(node, ast.Assign) and any(isinstance(x, ast.Name) and x.id == name for x in node.targets):
            return spark.createDataFrame([(str(k), str(v)) for k, v in ast.literal_eval(node.value).items()], "key string, value string")
    raise KeyError(name)
