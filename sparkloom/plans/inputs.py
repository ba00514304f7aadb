"""Queries over scans, sinks, jobs and streams."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..sources import scans as C
from ..sources import sinks as K
from ..sources import staging as G
from ..streaming import panel_stream as E
from . import jobs as U
from .aggregates import PANEL, panel, r
from .registry import query
from .texts import clean_html_sql

LAW = """<dokumente><norm><metadaten><jurabk>VwGO</jurabk><enbez>§ 42</enbez><titel>Anfechtung</titel></metadaten><textdaten><P>Durch Klage kann begehrt werden.</P></textdaten></norm>
<norm><metadaten><jurabk>VwGO</jurabk></metadaten><textdaten></textdaten></norm><norm><metadaten></metadaten><textdaten><P>Ohne Namen</P></textdaten></norm></dokumente>"""


def _text_files(t, files: dict[str, str | bytes]) -> str:
    """Small files under a fresh shared folder, written by the file system of that folder."""
    base = K.scratch(t.spark, "files")
    jvm = t.spark._jvm
    for name, text in files.items():
        p = jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        out = p.getFileSystem(t.spark._jsc.hadoopConfiguration()).create(p)
        out.write(bytearray(text if isinstance(text, bytes) else text.encode()))
        out.close()
    return base


def law_files(t):
    """(filename, xml): a statute a brand, its parts the norms; parts of size 1 have no text."""
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    key = F.col("p_partkey").cast("string")
    head = tag("metadaten", F.concat(tag("jurabk", F.col("p_brand")), tag("enbez", F.concat(F.lit("§ "), key)), tag("titel", F.col("p_name"))))
    text = F.when(F.col("p_size") > 1, tag("P", F.concat(F.lit("Vom "), F.col("p_type")))).otherwise(F.lit(""))
    norms = t.part.select("p_brand", "p_partkey", tag("norm", F.concat(head, tag("textdaten", text))).alias("n"))
    files = norms.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "n"))), lambda x: x["n"]), "\n").alias("n"))
    return files.select(F.concat("p_brand", F.lit(".xml")).alias("filename"), F.concat(F.lit('<?xml version="1.0"?>'), tag("dokumente", F.col("n"))).alias("xml"))


_NORMS = "SELECT 'Vom ' || p_type AS text, p_brand || ' § ' || p_partkey || ': ' || p_name AS title, p_brand || '.xml' AS filename, p_brand AS law_book, '§ ' || p_partkey AS paragraph FROM part"


@query("s01_law_scan", f"{_NORMS} WHERE p_size > 1")
def s01(t):
    return C.norms_of(law_files(t))


@query("s02_first_snapshot", f"SELECT * REPLACE (CASE WHEN substr(paragraph, 3)::BIGINT % 2 = 0 THEN 'Alt' ELSE text END AS text, CASE WHEN substr(paragraph, 3)::BIGINT % 2 = 0 THEN '0-' ELSE '' END || filename AS filename) FROM ({_NORMS} WHERE p_size > 1)")
def s02(t):
    """An earlier snapshot holds every second norm, with another text."""
    now = C.norms_of(law_files(t))
    old = now.where(F.substring_index("paragraph", " ", -1).cast("long") % 2 == 0).withColumns({"text": F.lit("Alt"), "filename": F.concat(F.lit("0-"), "filename")})
    return C.first_snapshot(old.unionByName(now))


@query(
    "s05_page_headers",
    "WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS x FROM conversations), g AS (SELECT conv_id, count(*) AS n, count(DISTINCT x) AS d, min(length(x)) AS l FROM c GROUP BY 1) "
    "SELECT conv_id, string_agg(CASE WHEN n > 1 AND d = 1 AND l >= 5 THEN '' WHEN n > 1 THEN x ELSE turn || '/Conversation ' || conv_id || '/' || x END, '|' ORDER BY turn, x) AS pages FROM c JOIN g USING (conv_id) GROUP BY conv_id",
)
def s05(t):
    """A conversation's turns as pages under a running head: the turn's number, then the conversation's, then the text."""
    text = F.coalesce("text", F.lit(""))
    page = F.array(F.col("turn").cast("string"), F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")), text)
    books = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", text.alias("x"), page.alias("page")))), lambda x: x["page"]).alias("pages"))
    return books.select("conv_id", F.array_join(F.transform(C.without_headers(F.col("pages")), lambda p: F.array_join(p, "/")), "|").alias("pages"))


@query("s08_hit_list", "SELECT DISTINCT o_custkey, 'D' || o_orderkey AS doknr FROM orders")
def s08(t):
    """A page of hits a customer: each order is linked twice."""
    link = F.concat(F.lit('<a href="?doc.id=D'), F.col("o_orderkey").cast("string"), F.lit('">x</a>'))
    pages = t.orders.groupBy("o_custkey").agg(F.array_join(F.collect_list(F.concat(link, link)), "\n").alias("html"))
    return pages.select("o_custkey", F.explode(C.hit_list(F.col("html"))).alias("doknr"))


@query(
    "s09_decision_xml",
    "SELECT o_orderpriority AS court, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderkey || ' B ' || o_custkey AS file_number, coalesce(string_agg('P § ' || l_partkey, '|' ORDER BY l_linenumber, l_partkey, l_quantity), '') AS norms, "
    "coalesce(string_agg('Menge ' || l_quantity::BIGINT, '|' ORDER BY l_linenumber, l_partkey, l_quantity), '') AS paragraphs FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderpriority, o_orderdate",
)
def s09(t):
    """An order as a decision, its lines as norms and paragraphs."""
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c.cast("string"), F.lit(f"</{name}>"))
    line = F.struct("l_linenumber", "l_partkey", "l_quantity")
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("l"))
    each = F.transform("l", lambda x: F.concat(tag("norm", F.concat(F.lit("P § "), x["l_partkey"].cast("string"))), tag("absatz", F.concat(F.lit("Menge "), x["l_quantity"].cast("long").cast("string")))))
    number = F.concat(F.col("o_orderkey").cast("string"), F.lit(" B "), F.col("o_custkey").cast("string"))
    head = F.concat(tag("gertyp", F.col("o_orderpriority")), tag("entsch-datum", F.date_format("o_orderdate", "yyyy-MM-dd")), tag("aktenzeichen", number))
    d = t.orders.join(lines, "o_orderkey", "left").select(tag("d", F.concat(head, F.coalesce(F.array_join(each, ""), F.lit("")))).alias("xml"))
    return d.select(*[(F.array_join(c, "|") if n in ("norms", "paragraphs") else c).alias(n) for n, c in C.decision_xml(F.col("xml")).items()])


@query(
    "s10_decision_json",
    "SELECT doc_id::VARCHAR AS doc_id, source AS court, printf('2021-%02d-%02d', doc_id % 12 + 1, doc_id % 28 + 1) AS date, 'M ' || doc_id || ' K 20.1' AS file_number, 'm' || doc_id || 'k201' AS az_key, lang AS doktyp, 'VwGO § ' || n_chars AS norm_chain, coalesce(text, '') AS text FROM documents",
)
def s10(t):
    """Every document as a decision in JSON, its lines as paragraphs."""
    key, two = F.col("doc_id").cast("string"), lambda n: F.lpad((F.col("doc_id") % n + 1).cast("string"), 2, "0")
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.struct(F.lit(None).cast("int").alias("rd"), x.alias("text")))
    d = t.documents.select(
        key.alias("id"), F.col("source").alias("court"), F.concat_ws(".", two(28), two(12), F.lit("2021")).alias("date"), F.concat(F.lit("M "), key, F.lit(" K 20.1")).alias("file_number"),
        F.col("lang").alias("type"), F.array(F.concat(F.lit("VwGO § "), F.col("n_chars").cast("string"))).alias("norms"), lines.alias("paragraphs"),
    )
    path = K.scratch(t.spark, "decisions")
    d.write.json(path)
    return C.parse_decisions(t.spark, path).drop("paragraphs").withColumn("norm_chain", F.array_join("norm_chain", "|"))


@query("s07_zip_scan", "SELECT doc_id::VARCHAR || '.zip' AS archive, doc_id::VARCHAR || '.txt' AS member, length(coalesce(text, ''))::INT AS n, md5(coalesce(text, '')) AS digest FROM documents")
def s07(t):
    """Every document in an archive; the directories of every second are cut off."""
    @F.pandas_udf("binary")
    def archive(names: pd.Series, texts: pd.Series, whole: pd.Series) -> pd.Series:
        import io
        import zipfile

        out = []
        for name, text, w in zip(names, texts, whole):
            b = io.BytesIO()
            with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(name, text)
                end = z.fp.tell()
            out.append(b.getvalue() if w else b.getvalue()[:end])
        return pd.Series(out)

    key = F.col("doc_id").cast("string")
    files = t.documents.select(F.concat(key, F.lit(".zip")).alias("path"), archive(F.concat(key, F.lit(".txt")), F.coalesce("text", F.lit("")), F.col("doc_id") % 2 == 0).alias("content"))
    text = F.decode("content", "UTF-8")
    return C.zip_members(files).select("archive", "member", F.length(text).alias("n"), F.md5("content").alias("digest"))


_HEAD = clean_html_sql("coalesce(nullif(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), ''), regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))")
_BODY = clean_html_sql("regexp_replace(html, '(?is)<head.*?</head>', ' ', 'g')")


@query("s12_norm_pages", f"SELECT page_id, regexp_replace({_HEAD}, '^(?:§|Art\\.?)\\s*\\d+\\s?[a-z]?\\s+', '') AS heading, length({_BODY})::INT AS n FROM pages")
def s12(t):
    head, text = C.norm_page(F.col("html"))
    return t.pages.select("page_id", head.alias("heading"), F.length(text).alias("n"))


@query("s13_article_range", "SELECT p_partkey, unnest(range(p_size, p_size + 3)) AS art FROM part WHERE p_size BETWEEN 1 AND 398")
def s13(t):
    text = F.concat(F.lit("Art. "), F.col("p_size").cast("string"), F.lit("-"), (F.col("p_size") + 2).cast("string"))
    return t.part.select("p_partkey", F.explode(C.article_range(text)).alias("art"))


@query("s14_needed", "SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 49 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def s14(t):
    have = t.part.where("p_size < 25").select(F.col("p_partkey").alias("k"))
    return t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("k")).distinct().join(have, "k", "left_anti")


@query("s15_csv_projection", "SELECT s_suppkey, s_acctbal FROM supplier")
def s15(t):
    path = K.scratch(t.spark, "csv")
    t.supplier.write.csv(path, header=True, escape='"')
    return C.read_csv(t.spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", ["s_suppkey", "s_acctbal"])


@query("s16_csv_chunks", "SELECT r_regionkey, r_name FROM region")
def s16(t):
    path = K.scratch(t.spark, "csv")
    t.region.repartition(3).write.csv(path, header=True, escape='"')
    return C.read_csv(t.spark, path, "r_regionkey int, r_name string")


@query("s17_seat_lines", "SELECT o_orderkey AS index, o_totalprice AS score, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END AS error FROM orders WHERE o_orderkey % 7 <> 3")
def s17(t):
    """An order a line; some lines are torn, and each is followed by a blank one."""
    whole = F.to_json(F.struct(F.col("o_orderkey").alias("index"), F.lit("a").alias("model"), F.col("o_totalprice").alias("score"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority")).alias("error")))
    line = F.when(F.col("o_orderkey") % 7 == 3, F.expr("left(line, length(line) - 9)")).otherwise(F.col("line"))
    path = K.scratch(t.spark, "seat")
    t.orders.withColumn("line", whole).select(F.concat(line, F.lit("\n")).alias("value")).write.text(path)
    return C.read_seat(t.spark, path, ["index", "score", "error"])


@query("s18_parquet_scan", "SELECT n_nationkey, n_name FROM nation")
def s18(t):
    return t.nation.select("n_nationkey", "n_name")


@query("s19_vector_scan", "SELECT vec_id, len(embedding)::INT AS dims FROM embeddings")
def s19(t):
    return t.embeddings.select("vec_id", F.size("embedding").alias("dims"))


@query("s20_glob_union", "SELECT n_nationkey AS k, n_name AS name, NULL::INT AS region FROM nation UNION ALL SELECT r_regionkey, NULL, r_regionkey FROM region")
def s20(t):
    a, b = K.scratch(t.spark, "part"), K.scratch(t.spark, "part")
    t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).write.csv(a, header=True)
    t.region.select(F.col("r_regionkey").alias("k"), F.col("r_regionkey").alias("region")).write.csv(b, header=True)
    return C.read_union(t.spark, [a, b], "k int, name string, region int")


@query("s21_graph", "SELECT 'customer' AS kind, count(DISTINCT o_custkey) AS n, max(id) AS top FROM orders JOIN (SELECT o_custkey, dense_rank() OVER (ORDER BY o_custkey::VARCHAR) - 1 AS id FROM orders) USING (o_custkey) UNION ALL SELECT 'order', count(*), count(*) - 1 FROM orders")
def s21(t):
    vertices, _ = C.graph(t.orders, "o_orderkey", "o_custkey", "order", "customer")
    return vertices.groupBy("kind").agg(F.count("*").alias("n"), F.max("id").alias("top"))


@query("s22_literal_table", "SELECT 'a' AS key, '1' AS value UNION ALL SELECT 'b', '2.5'")
def s22(t):
    return C.literal_table(t.spark, "x = 1\nSCORES = {'a': 1, 'b': 2.5}\n", "SCORES")


@query("s24_endpoints", "SELECT n_name AS model, CASE WHEN n_nationkey < 5 THEN 'local' ELSE 'remote' END AS endpoint FROM nation")
def s24(t):
    known = t.nation.where("n_nationkey < 5").select(F.col("n_name").alias("model"), F.lit("local").alias("endpoint"))
    return C.with_endpoint(t.nation.select(F.col("n_name").alias("model")), known, "remote")


# --- staging, with services that are functions ---


def make_pdf(pages: list[list[str]]) -> bytes:
    """A small PDF: a font, a page object and a deflated content for each page."""
    import zlib

    escaped = lambda x: x.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
    body, kids = [], []
    for i, lines in enumerate(pages):
        shown = "BT /F1 12 Tf 72 720 Td " + " 0 -14 Td ".join(f"({escaped(x)}) Tj" for x in lines) + " ET"
        data = zlib.compress(shown.encode("latin-1"))
        kids.append(f"{10 + 2 * i} 0 R")
        body += [f"{10 + 2 * i} 0 obj\n<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * i} 0 R >>\nendobj\n".encode(), f"{11 + 2 * i} 0 obj\n<< /Length {len(data)} /Filter /FlateDecode >>\nstream\n".encode() + data + b"\nendstream\nendobj\n"]
    head = f"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(pages)} >>\nendobj\n"
    return head.encode() + b"".join(body) + b"%%EOF\n"


@query(
    "s04_pdf_lines",
    "SELECT 'n' || n_nationkey || '.pdf' AS filename, unnest([1, 1, 2, 2]) AS page, unnest([1, 2, 1, 2]) AS line, unnest(['Head', n_name || ' (' || n_regionkey || ')', 'Head', 'Page 2 of ' || n_nationkey]) AS text FROM nation",
)
def s04(t):
    rows = t.nation.select("n_nationkey", "n_name", "n_regionkey").collect()
    files = {f"n{k}.pdf": make_pdf([["Head", f"{name} ({region})"], ["Head", f"Page 2 of {k}"]]) for k, name, region in rows}
    found = G.read_pdfs(t.spark, _text_files(t, files)).select("filename", F.posexplode("pages").alias("page", "lines"))
    return found.select("filename", (F.col("page") + 1).alias("page"), F.posexplode("lines").alias("line", "text")).withColumn("line", F.col("line") + 1)


@query("s06_crawl", "SELECT n_nationkey::VARCHAR AS key, page, 'D' || n_nationkey || 'P' || page || 'X' || i AS hit FROM nation, (SELECT unnest([1, 2, 3]) AS page), (SELECT unnest([0, 1]) AS i) WHERE page <= n_nationkey % 4")
def s06(t):
    """A portal whose keys have up to three pages; a page beyond them repeats the last. The first run is refused halfway."""
    keys, path, asked = [str(r[0]) for r in t.nation.select("n_nationkey").orderBy("n_nationkey").collect()], K.scratch(t.spark, "crawl"), []

    def fetch(key: str, page: int) -> tuple[int, str]:
        asked.append(key)
        if len(asked) == 20:
            return 429, ""
        if len(asked) % 7 == 0:
            return 502, ""
        last = int(key) % 4
        return 200, "".join(f'<a href="?doc.id=D{key}P{min(page, last)}X{i}">' for i in range(2)) if last else ""

    import re

    parse = lambda html: re.findall(r"doc\.id=([A-Za-z0-9]+)", html)
    for _ in range(2):
        try:
            found = G.crawl(t.spark, keys, fetch, parse, path, sleep=lambda s: None)
        except G.Blocked:
            continue
    return found


@query("s11_fetch_once", "SELECT 'a.zip' AS archive, 'a.xml' AS member, true AS fetched, false AS again, 1 AS calls")
def s11(t):
    """A pinned archive, fetched once and read."""
    import hashlib
    import io
    import zipfile

    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("a.xml", LAW)
    calls, base = [], K.scratch(t.spark, "fetched")
    fetch = lambda: calls.append(1) or b.getvalue()
    first, again = (G.fetch_once(t.spark, f"{base}/a.zip", fetch, hashlib.sha256(b.getvalue()).hexdigest()) for _ in range(2))
    found = C.read_zips(t.spark, base).select(F.element_at(F.split("archive", "/"), -1).alias("archive"), "member")
    return found.select("*", F.lit(first).alias("fetched"), F.lit(again).alias("again"), F.lit(len(calls)).alias("calls"))


@query("s23_catalogue", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def s23(t):
    rows = [{"id": k, "name": n, "other": 1} for k, n in t.nation.select("n_nationkey", "n_name").collect()]

    def fetch(name: str | None) -> str:
        at = int(name or 0)
        return json.dumps({"data": rows[at : at + 10], "next": str(at + 10) if at + 10 < len(rows) else None})

    return G.read_catalogue(t.spark, fetch, "id int, name string")


# --- sinks ---


@query("k01_parquet", "SELECT c_custkey, c_acctbal FROM customer")
def k01(t):
    path = K.scratch(t.spark, "k")
    t.customer.select("c_custkey", "c_acctbal").write.parquet(path)
    return t.spark.read.parquet(path)


@query("k02_atomic_replace", "SELECT c_custkey FROM customer WHERE c_nationkey = 3")
def k02(t):
    path = K.scratch(t.spark, "k")
    K.replace(t.customer.select("c_custkey"), path)
    K.replace(t.customer.where("c_nationkey = 3").select("c_custkey"), path)
    return t.spark.read.parquet(K.current(t.spark, path))


@query("k03_append_lines", "SELECT c_custkey, c_mktsegment AS model FROM customer")
def k03(t):
    path = K.scratch(t.spark, "k")
    for odd in (0, 1):
        K.append_lines(t.customer.where(F.col("c_custkey") % 2 == odd).select("c_custkey", F.col("c_mktsegment").alias("model")), path)
    return t.spark.read.schema("c_custkey long, model string").json(path)


_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


@query(
    "k04_index_tables",
    f"WITH tok AS (SELECT doc_id AS key, {_TOKENS} AS t FROM documents), tf AS (SELECT key, len(t) AS dl, unnest(t) AS term FROM tok) SELECT term, count(DISTINCT key) AS df, count(*)::BIGINT AS words, sum(DISTINCT key)::BIGINT AS keys, (SELECT count(*) FROM documents) AS docs FROM tf GROUP BY term",
)
def k04(t):
    """The stored postings of every term, and the stored lengths."""
    from ..operators.search import Index

    path = K.scratch(t.spark, "k")
    K.write_index(Index(t.documents, "doc_id", "text"), path)
    postings = t.spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.sum("tf").alias("words"), F.sum("key").alias("keys"))
    stored = t.spark.read.parquet(f"{path}/terms").select("term", "df").join(postings, "term")
    return stored.crossJoin(F.broadcast(t.spark.read.parquet(f"{path}/lengths").agg(F.count("*").alias("docs"))))


@query("k05_widening_append", "SELECT n_nationkey AS k, NULL::VARCHAR AS extra FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def k05(t):
    path = K.scratch(t.spark, "k")
    K.append_widening(t.nation.select(F.col("n_nationkey").alias("k")), path)
    K.append_widening(t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("extra")), path)
    return K.widened(t.spark, path)


@query("k06_side_file", "SELECT doc_id, n_chars FROM documents")
def k06(t):
    path = K.scratch(t.spark, "k")
    K.side_file(t.documents.select("doc_id", "n_chars"), path)
    return t.spark.read.schema("doc_id long, n_chars long").json(path)


@query("k07_export", "SELECT vec_id, label FROM embeddings")
def k07(t):
    path = K.scratch(t.spark, "k")
    K.export(t.embeddings, path)
    return t.spark.read.parquet(path)


@query("k08_verified_merge", "SELECT s_suppkey AS k, s_acctbal AS v FROM supplier UNION ALL SELECT c_custkey, c_acctbal FROM customer")
def k08(t):
    path = K.scratch(t.spark, "k")
    K.merge_verified([t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v")), t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))], path)
    return t.spark.read.schema("k long, v double").json(K.current(t.spark, path))


@query(
    "k09_latex",
    "WITH g AS (SELECT n_name AS name, count(c_custkey) AS n, round(avg(c_acctbal), 1) AS m FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name), l AS (SELECT row_number() OVER (ORDER BY name) + 4 AS line, "
    "replace(name, '_', '\\_') || ' & ' || n || ' & ' || CASE WHEN m IS NULL THEN '--' ELSE printf('%.1f', m) END || ' \\\\' AS text FROM g), c AS (SELECT count(*) AS n FROM g) "
    "SELECT line, text FROM l UNION ALL SELECT * FROM (VALUES (1, '\\begin{tabular}{lrr}'), (2, '\\toprule'), (3, 'Nation & Customers & Balance \\\\'), (4, '\\midrule')) v(line, text) UNION ALL SELECT n + 5, '\\bottomrule' FROM c UNION ALL SELECT n + 6, '\\end{tabular}' FROM c UNION ALL SELECT n + 7, '% by nation' FROM c",
)
def k09(t):
    """A table of rows already aggregated, as LaTeX, line by line."""
    from .render import table

    g = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_name").alias("name")).agg(F.count("c_custkey").alias("n"), F.round(F.avg("c_acctbal"), 1).alias("m")).orderBy("name")
    lines = table([x.asDict() for x in g.collect()], [("name", "Nation"), ("n", "Customers"), ("m", "Balance")], "by nation").split("\n")
    return t.spark.createDataFrame(list(enumerate(lines, 1)), "line int, text string")


# --- jobs ---


_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
_SHARE = "((200 * len(list_distinct(w)) + len(w)) // (2 * len(w)) / 100.0)"


@query("u01_generate", f"WITH w AS (SELECT conv_id, turn, {_WORDS.format('text')} AS w FROM conversations WHERE role = 'user') SELECT conv_id, turn, '<think>' || len(w) || ' words</think> [[' || {_SHARE} || ']]' AS answer, len(w) AS prompt_tokens FROM w")
def u01(t):
    return U.generate(t.conversations.where("role = 'user'"), ["conv_id", "turn"], "text").select("conv_id", "turn", "answer", "prompt_tokens")


@query("u03_cost", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax > 0.05 THEN l_tax ELSE (l_quantity * 2 + l_partkey * 3) / 1e6 END, 9) AS cost FROM lineitem")
def u03(t):
    c = U.cost(F.when(F.col("l_tax") > 0.05, F.col("l_tax")), F.col("l_quantity"), F.col("l_partkey"), F.lit(2), F.lit(3))
    return t.lineitem.select("l_orderkey", "l_linenumber", r(c).alias("cost"))


@query("u03_panel_cost", "SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 AND count(*) FILTER (event_type = 'purchase' AND value < 5) = 0 THEN round(sum(value) FILTER (event_type = 'purchase'), 6) END AS cost FROM events GROUP BY user_id")
def u03b(t):
    return t.events.groupBy("user_id").agg(r(U.panel_cost(F.when(F.col("value") >= 5, F.col("value")), F.col("event_type") == "purchase"), 6).alias("cost"))


_SEATS = "(SELECT unnest(['seat one', 'seat two']) AS seat)"


@query("u06_judge", f"WITH w AS (SELECT conv_id, turn, {_WORDS.format('seat || chr(10) || text')} AS w FROM conversations, {_SEATS} WHERE role = 'assistant' AND trim(text) <> '') SELECT conv_id, turn, min({_SHARE}) AS low, count(*) AS n FROM w GROUP BY conv_id, turn")
def u06(t):
    j = U.judge(t.conversations.where("role = 'assistant'"), ["conv_id", "turn"], "text", ["seat one", "seat two"])
    return j.groupBy("conv_id", "turn").agg(F.min("score").alias("low"), F.count("score").alias("n"))


@query("u08_resume", "SELECT count(*) AS rows, 0 AS left_over FROM conversations WHERE role = 'user'")
def u08(t):
    path, work = K.scratch(t.spark, "job"), t.conversations.where("role = 'user'")
    U.run_resumable(work.where("conv_id % 2 = 0"), ["conv_id", "turn"], "text", path)
    left = U.run_resumable(work, ["conv_id", "turn"], "text", path)
    return t.spark.read.parquet(path).agg(F.count("*").alias("rows")).withColumn("left_over", F.lit(left))


@query("u09_missing_seats", f"WITH {PANEL}, k AS (SELECT DISTINCT gen, case_id FROM panel) SELECT gen, case_id FROM k WHERE (gen, case_id) NOT IN (SELECT (gen, case_id) FROM panel WHERE judge = 'view')")
def u09(t):
    p = panel(t)
    return p.select("gen", "case_id").distinct().join(p.where("judge = 'view'").select("gen", "case_id"), ["gen", "case_id"], "left_anti")


@query("u16_input_guard", "SELECT count(*) AS differing FROM conversations WHERE role = 'user' AND (conv_id % 3 = 0 OR turn % 4 = 2) AND conv_id IS NOT NULL AND turn IS NOT NULL")
def u16(t):
    """Prompts rebuilt from the turns against stored ones, of which some lack a blank at the end and some are missing."""
    built = t.conversations.where("role = 'user'").select("conv_id", "turn", F.concat(F.lit(U.PROMPTS["plain"]), F.coalesce("text", F.lit("")), F.lit(" ")).alias("prompt"))
    path = K.scratch(t.spark, "prompts")
    cut = F.when(F.col("conv_id") % 3 == 0, F.expr("left(prompt, length(prompt) - 1)")).otherwise(F.col("prompt"))
    built.where("turn % 4 <> 2").withColumn("prompt", cut).write.parquet(path)
    return t.spark.createDataFrame([(U.identical_inputs(built, t.spark.read.parquet(path), ["conv_id", "turn"], "prompt"),)], "differing long")


@query("u17_spend", f"WITH {PANEL} SELECT judge, count(*) AS rows, round(count(*) * length(judge) / 10.0, 9)::DOUBLE AS cost FROM panel GROUP BY judge")
def u17(t):
    p = panel(t)
    prices = p.select("judge").distinct().withColumn("price", F.length("judge") / 10.0)
    return U.spend_estimate(p, prices).select("judge", "rows", r("cost").alias("cost"))


@query("u19_unscored", f"WITH {PANEL}, g AS (SELECT gen, case_id, count(*) AS n FROM panel GROUP BY ALL) SELECT gen, case_id, 5 - n AS todo FROM g WHERE n < 5")
def u19(t):
    return panel(t).groupBy("gen", "case_id").agg((5 - F.count("*")).alias("todo")).where("todo > 0")


@query("u04_reassembly", "SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations")
def u04(t):
    """Every turn as the lines of a stream, a word each, with blank and torn lines between and one after the end."""
    words = F.split(F.coalesce("text", F.lit("")), r"(?<= )", -1)
    piece = lambda w: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(w.alias("content")).alias("delta"))).alias("choices"))))
    lines = F.flatten(F.transform(words, lambda w: F.array(piece(w), F.lit(""), F.lit("data: {torn"))))
    return U.with_reassembled(t.conversations.select("conv_id", "turn", F.concat(lines, F.array(F.lit("data: [DONE]"), piece(F.lit("!")))).alias("lines")), "lines", "text").drop("lines")


@query(
    "u07_evaluate",
    f"WITH q AS (SELECT item_id, {_WORDS.format(chr(39) + 'Answer the question. ' + chr(39) + ' || text')} AS w FROM benchmark), a AS (SELECT item_id, len(w) AS n, '<think>' || len(w) || ' words</think> [[' || {_SHARE} || ']]' AS answer FROM q), "
    f"j AS (SELECT item_id, answer, n, seat, {_WORDS.format('seat || chr(10) || answer')} AS w FROM a, (SELECT unnest(['a', 'b']) AS seat)) "
    f"SELECT item_id, answer, any_value(n) AS prompt_tokens, 4 AS completion_tokens, NULL::DOUBLE AS reported_cost, 'stop' AS finish_reason, NULL::VARCHAR AS error, 'stub' AS model, max({_SHARE}) FILTER (seat = 'a') AS a, max({_SHARE}) FILTER (seat = 'b') AS b, min({_SHARE}) AS score FROM j GROUP BY item_id, answer",
)
def u07(t):
    tasks = t.benchmark.select("item_id", "text")
    return U.evaluate(tasks, "item_id", "text", "stub", ["a", "b"])


@query("u10_overwrite_models", "SELECT o_orderstatus AS model, CASE WHEN o_orderstatus = 'F' THEN o_orderkey ELSE o_custkey END AS n FROM orders WHERE o_orderstatus IS NOT NULL")
def u10(t):
    """Order keys by status; then customers' keys of two statuses, of which one was there before."""
    path = K.scratch(t.spark, "models")
    rows = lambda c, *which: t.orders.where(F.col("o_orderstatus").isin(*which)).select(F.col(c).alias("n"), F.col("o_orderstatus").alias("model"))
    U.overwrite_models(rows("o_orderkey", "F", "O"), path)
    U.overwrite_models(rows("o_custkey", "O", "P"), path)
    return t.spark.read.schema("n long, model string").parquet(path)


def _scripted(outcomes: list):
    """A call that gives these outcomes in turn: responses, or exceptions to raise."""
    left = iter(outcomes)

    def call():
        x = next(left)
        if isinstance(x, Exception):
            raise x
        return x

    return call


@query(
    "u02_retry",
    "SELECT * FROM (VALUES ('at once', 'ok', NULL, 0.0), ('bad request', NULL, 'bad request: 400', 0.0), ('third time', 'ok', NULL, 3.0), ('never', NULL, 'finish error', 15.0), ('no tokens', 'ok', NULL, 1.0), ('rate limited', 'ok', NULL, 100.0), ('too long a wait', NULL, 'rate limit', 3600.0)) v(kind, answer, error, slept)",
)
def u02(t):
    """Retries (U2) and waits for a rate limit, which count as no attempt (U13), by scripted services."""
    ok, failed, empty = U.Response("ok", 1, 1), U.Response("x", 1, 1, finish_reason="error"), U.Response("x", 1, 0)
    scripts = {
        "at once": [ok], "bad request": [U.BadRequest("400")], "third time": [OSError("a"), OSError("b"), ok], "never": [failed] * 4, "no tokens": [empty, ok],
        "rate limited": [U.RateLimited(50.0)] * 2 + [ok], "too long a wait": [U.RateLimited(7000.0), U.RateLimited(7000.0)],
    }
    rows = []
    for kind, outcomes in scripts.items():
        slept: list[float] = []
        answer, error = U.Retry().call(_scripted(outcomes), slept.append)
        rows.append((kind, answer.text if answer else None, error, float(sum(slept))))
    return t.spark.createDataFrame(rows, "kind string, answer string, error string, slept double")


@query(
    "u11_prompts",
    "SELECT kind, item_id, md5(instruction || chr(10) || chr(10) || coalesce('[1] ' || lang, '') || chr(10) || chr(10) || text) AS prompt FROM (SELECT b.item_id, b.text, d.lang FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id), (VALUES ('plain', 'Answer the question.'), ('cited', 'Answer and cite the norms you use.'), ('judge', 'Rate the answer from 0 to 1 as [[n]].')) v(kind, instruction)",
)
def u11(t):
    """Every kind of prompt (U5, U11) over every item, with a context where there is one."""
    tasks = t.benchmark.join(t.documents.select(F.col("doc_id").alias("item_id"), "lang"), "item_id", "left")
    context = F.concat(F.lit("[1] "), "lang")
    out = None
    for kind in U.PROMPTS:
        part = tasks.select(F.lit(kind).alias("kind"), "item_id", F.md5(U.prompt_of(kind, context, F.col("text"))).alias("prompt"))
        out = part if out is None else out.union(part)
    return out


@query(
    "u12_successful_only",
    "SELECT count(*) AS work, count(*) FILTER (conv_id % 3 = 0) AS kept, count(*) FILTER (conv_id % 3 <> 0) AS again, 0 AS left_over FROM conversations WHERE role = 'user'",
)
def u12(t):
    """A table in which a third of the rows succeeded, a third failed and a third are blank: only the latter two run again (U12,
    U15)."""
    path, work = K.scratch(t.spark, "job"), t.conversations.where("role = 'user'").select("conv_id", "turn", "text")
    third = F.col("conv_id") % 3
    before = work.select("conv_id", "turn", F.when(third == 0, "kept").when(third == 2, " ").alias("answer"), F.lit(1).cast("long").alias("prompt_tokens"), F.lit(1).cast("long").alias("completion_tokens"), F.lit(None).cast("double").alias("reported_cost"), F.lit("stop").alias("finish_reason"), F.when(third == 1, "failed").alias("error"))
    before.write.parquet(path)
    left = U.run_resumable(work, ["conv_id", "turn"], "text", path)
    good = U.successful(t.spark.read.parquet(path))
    return good.agg(F.count("*").alias("work"), F.count_if(F.col("answer") == "kept").alias("kept"), F.count_if(F.col("answer") != "kept").alias("again")).withColumn("left_over", F.lit(left))


def _stumbling(prompt: str) -> U.Response:
    """A service that never answers prompts whose length is a multiple of seven."""
    if len(prompt) % 7 == 0:
        raise U.BadRequest("400")
    return U.stub(prompt)


@query("u14_rounds", "SELECT count(*) FILTER (length(text) % 7 = 0) AS holes, count(*) FILTER (length(text) % 7 <> 0) AS answered, count(*) + count(*) FILTER (length(text) % 7 = 0) AS calls, count(*) FILTER (length(text) % 7 = 0) <= 5 AS final FROM conversations WHERE role = 'user'")
def u14(t):
    """Two rounds over what is missing; final only with five holes at most."""
    path, work = K.scratch(t.spark, "job"), t.conversations.where("role = 'user'").select("conv_id", "turn", "text")
    holes = U.run_resumable(work, ["conv_id", "turn"], "text", path, _stumbling, rounds=2)
    got = t.spark.read.parquet(path)
    return got.agg(F.lit(holes).cast("long").alias("holes"), F.count_if(F.col("error").isNull()).alias("answered"), F.count("*").alias("calls"), F.lit(holes <= 5).alias("final"))


@query(
    "u18_supervisor",
    "SELECT * FROM (VALUES (1, 'a,b', false, 'running,running,waiting'), (2, 'c', false, 'complete,running,running'), (3, 'b', false, 'complete,running,running'), (4, '', false, 'complete,complete,running'), (5, '', true, 'complete,complete,complete'), (6, 'x', false, 'running'), (7, 'x', false, 'running'), (8, '', false, 'given up')) v(step, launched, merge, states)",
)
def u18(t):
    """Three seats on two slots until all are complete, and one that fails until it is given up."""
    rows = []

    def step(seats, holes, alive, launches=3):
        for s in seats:
            s.holes = holes.get(s.name, s.holes)
        now, merge = U.supervise(seats, alive, 2, launches)
        rows.append((len(rows) + 1, ",".join(now), merge, ",".join(s.state for s in seats)))

    three = [U.Seat("a", 4), U.Seat("b", 4), U.Seat("c", 4)]
    step(three, {}, {})
    step(three, {"a": 0}, {"b": True})
    step(three, {}, {"c": True})  # b's process ended with holes
    step(three, {"b": 0}, {"b": True, "c": True})
    step(three, {"c": 0}, {})
    one = [U.Seat("x", 1)]
    for _ in range(3):
        step(one, {}, {}, 2)
    return t.spark.createDataFrame(rows, "step int, launched string, merge boolean, states string")


# --- streams (an extension) ---


def _stream(t):
    path = K.scratch(t.spark, "events")
    t.events.repartition(4).write.parquet(path)
    return E.read_events(t.spark, path)


@query("stream_windows", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_windows(t):
    out = E.drain(E.windows(_stream(t)), f"w{uuid.uuid4().hex}", "complete", K.scratch(t.spark, "stream"))
    return out.select("start", "event_type", "n", r("total", 6).alias("total"))


@query("stream_first_wins", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def stream_first_wins(t):
    out = E.drain(E.first_wins(_stream(t), "60 days"), f"f{uuid.uuid4().hex}", "append", K.scratch(t.spark, "stream"))
    return out.agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query(
    "stream_sessions",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh, event_id FROM events), "
    "s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k",
)
def stream_sessions(t):
    return E.drain(E.sessions(_stream(t)), f"s{uuid.uuid4().hex}", "complete", K.scratch(t.spark, "stream"))


@query("stream_sliding", "SELECT w AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events, (SELECT unnest([0, 1]) AS b) k, LATERAL (SELECT date_trunc('day', ts) + INTERVAL 12 HOUR * (date_part('hour', ts)::INT // 12 - b) AS w) GROUP BY ALL")
def stream_sliding(t):
    out = E.drain(E.windows(_stream(t), "1 day", "12 hours"), f"l{uuid.uuid4().hex}", "complete", K.scratch(t.spark, "stream"))
    return out.select("start", "event_type", "n", r("total", 6).alias("total"))
