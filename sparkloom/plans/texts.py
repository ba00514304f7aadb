"""Text functions over documents, conversations and pages, and over literals where the tables hold no
case."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import similarity as Y
from ..functions import text as X
from ..operators import ranking as R
from .aggregates import r
from .registry import query

def cited(t):
    """Documents whose texts begin with citations that depend on doc_id: with qualifiers, as a list, with a footnote's number."""
    n = F.col("doc_id")
    no = lambda m, k: F.format_string("%d", n % m + k)
    head = F.concat(
        F.lit("Art. "), no(200, 1), F.lit(" Abs. 1 GG und §§ "), no(90, 300), F.lit(", "), no(90, 400), F.lit("a VwGO; Art. "), no(30, 500),
        F.lit(" i. V. m. Art. "), no(30, 600), F.lit(" BV sowie § "), no(50, 700), F.lit(" S. 1 GG9 und § 1 Kosten- und "),
    )
    return t.documents.where("doc_id IS NOT NULL").select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))


def cited_sql(columns: str) -> str:
    """The citations of these texts in order: (pos, form, section, book as found, book made canonical)."""
    no = lambda m, k: f"(doc_id % {m} + {k})::VARCHAR"
    rows = [(0, "Art", no(200, 1), "GG", "GG"), (1, "Par", no(90, 300), "VwGO", "VwGO"), (2, "Par", no(90, 400) + " || 'a'", "VwGO", "VwGO"), (3, "Art", no(30, 500), "BV", "BV"), (4, "Art", no(30, 600), "BV", "BV"), (5, "Par", no(50, 700), "GG9", "GG"), (6, "Par", "'1'", "Kosten-", None)]
    one = " UNION ALL ".join(f"SELECT doc_id, {pos} AS pos, '{form}' AS form, {section} AS section, '{book}' AS book, {chr(39) + clean + chr(39) if clean else 'NULL'} AS clean FROM documents WHERE doc_id IS NOT NULL" for pos, form, section, book, clean in rows)
    return f"SELECT {columns} FROM ({one})"


@query("f01_citations", cited_sql("doc_id, pos, form, section, book"))
def f01(t):
    found = C.with_citations(cited(t), clean=False)
    return found.select("doc_id", F.posexplode("citations").alias("pos", "c")).select("doc_id", "pos", "c.form", "c.section", "c.book")


@query("f02_canonical", cited_sql("doc_id, string_agg(clean || ' ' || section, ', ' ORDER BY pos) FILTER (clean IS NOT NULL) AS norms") + " GROUP BY doc_id")
def f02(t):
    return C.with_citations(cited(t)).select("doc_id", F.array_join(F.transform("citations", lambda c: F.concat_ws(" ", c["book"], c["section"])), ", ").alias("norms"))


@query("f03_corpus_key", "SELECT p_partkey, replace(lower(regexp_replace(regexp_replace(trim(p_brand || ' 2013'), '\\s+(?:19|20)\\d\\d$', ''), '\\s+', '', 'g')), '.', '') AS k FROM part")
def f03(t):
    return t.part.select("p_partkey", C.corpus_key_column(F.concat("p_brand", F.lit(" 2013"))).alias("k"))


@query(
    "f04_norm_chain",
    "SELECT p_partkey, unnest(list_distinct(['baydg 6', 'baydg ' || p_size, 'baydg ' || (p_size + 100), 'vwgo ' || (p_partkey % 190 + 200), 'vwvfg 35', 'bbaug ' || (p_size + 300)])) AS norm FROM part",
)
def f04(t):
    size = lambda k: F.format_string("%d", F.col("p_size") + k)
    one = F.concat(F.lit("BayDG Art. 6 Abs. 1, Art. "), size(0), F.lit(" Abs. 1, Art. "), size(100))
    two = F.concat(F.lit("VwGO § "), F.format_string("%d", F.col("p_partkey") % 190 + 200), F.lit(" Abs. 6"))
    three = F.concat(F.lit("§ 35 VwVfG | BauGB § "), size(300))
    # an article 6 in the second place would be the first one again
    d = t.part.select("p_partkey", F.array(one, two, three).alias("norm_chain"))
    return C.with_chain(d).select("p_partkey", F.explode("norms").alias("n")).select("p_partkey", F.concat_ws(" ", "n.book", "n.section").alias("norm"))


@query("f05_norm_of", "SELECT o_orderkey, nullif(regexp_extract('§ ' || o_orderkey || ' X', '(?:§§?|Art\\.?|Artikel)\\s*(\\d+\\s?[a-z]?)', 1), '') AS norm FROM orders")
def f05(t):
    return t.orders.select("o_orderkey", C.norm_of(F.concat(F.lit("§ "), F.col("o_orderkey").cast("string"), F.lit(" X"))).alias("norm"))


@query("f06_context_norms", "SELECT c_custkey, ['GG 1', c_name] AS named FROM customer")
def f06(t):
    prompt = F.concat(F.lit('<norm zitat="GG 1">x</norm> [SOURCE 2: '), "c_name", F.lit("] y"))
    return t.customer.select("c_custkey", C.context_norms(prompt).alias("named"))


@query("f07_spacing", "SELECT doc_id, length(replace(text, ' ', ' ')) AS n FROM documents")
def f07(t):
    odd = F.concat(F.replace("text", F.lit(" "), F.lit(" ")), F.lit("​"))
    return t.documents.select("doc_id", F.length(X.spacing(odd)).alias("n"))


@query("f08_typography", "SELECT doc_id, md5(replace(text, '-', '-')) AS h FROM documents")
def f08(t):
    return t.documents.select("doc_id", F.md5(X.typography(F.replace("text", F.lit("-"), F.lit("–")))).alias("h"))


def _single_feeds(x: str) -> str:
    once = lambda y: f"regexp_replace({y}, '(^|[^\\n])\\n([^\\n]|$)', '\\1 \\2', 'g')"
    return once(once(x))


_WRAPPED = "'kreisange-' || chr(10) || 'hörigen Nach-' || chr(10) || 'Bar' || chr(10) || text"
_HYPHENS = f"regexp_replace(regexp_replace({_WRAPPED}, '-\\n(\\p{{Ll}})', '\\1', 'g'), '-\\n(\\p{{Lu}})', '-\\1', 'g')"


@query("f09_unwrap", f"SELECT doc_id, md5(trim(regexp_replace({_single_feeds(_HYPHENS)}, '[ \\t]+', ' ', 'g'))) AS h FROM documents")
def f09(t):
    text = F.concat(F.lit("kreisange-\nhörigen Nach-\nBar\n"), "text")
    return t.documents.select("doc_id", F.md5(X.unwrap(text)).alias("h"))


@query("f10_clean_lines", "SELECT doc_id, len(list_distinct(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^\\s*(?:[-*•]|\\d+[.)])\\s*', ''))), lambda x: length(x) >= 12), lambda x: lower(x)))) > 8 AS full, least(len(list_distinct(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^\\s*(?:[-*•]|\\d+[.)])\\s*', ''))), lambda x: length(x) >= 12), lambda x: lower(x)))), 8)::INT AS n FROM documents")
def f10(t):
    d = t.documents.select("doc_id", X.clean_lines(F.col("text")).alias("a"), X.clean_lines(F.col("text"), most=1000000).alias("b"))
    return d.select("doc_id", (F.size("b") > 8).alias("full"), F.size("a").alias("n"))


@query("f11_search_string", "SELECT doc_id, array_to_string(list_slice(string_split(trim(regexp_replace(lower(regexp_replace(text, '[^\\p{L}\\p{N}_§ ]+', ' ', 'g')), ' +', ' ', 'g')), ' '), 1, 350), ' ') AS q FROM documents")
def f11(t):
    return t.documents.select("doc_id", X.search_string(F.col("text")).alias("q"))


@query("f12_sub_queries", "SELECT doc_id, greatest(len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 12)), 1)::INT AS n FROM documents")
def f12(t):
    return t.documents.select("doc_id", F.size(X.sub_queries(F.col("text"))).alias("n"))


def sentences_sql(start: str = "\\p{Lu}") -> str:
    """The parts of texts at white space after a sentence's end and before a start."""
    return f"string_split(regexp_replace(text, '([.!?])\\s+({start})', '\\1' || chr(1) || '\\2', 'g'), chr(1))"


SENTENCES = f"s AS (SELECT doc_id, list_filter(list_transform({sentences_sql()}, lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)"


@query("f13_sentence_groups", f"WITH {SENTENCES} SELECT doc_id, len(s)::INT AS sentences, ceil(len(s) / greatest(1, ceil(len(s) / 6.0)))::INT AS groups FROM s")
def f13(t):
    return t.documents.select("doc_id", F.size(X.sentences(F.col("text"))).alias("sentences"), F.size(X.sentence_groups(F.col("text"))).alias("groups"))


@query("f14_paragraphs", "SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: trim(x)), lambda x: length(x) >= 1))::INT AS n FROM documents")
def f14(t):
    return t.documents.select("doc_id", F.size(X.paragraphs(F.col("text"))).alias("n"))


@query(
    "f14_longest_sentences",
    f"WITH {SENTENCES}, k AS (SELECT doc_id, unnest(s) AS x, unnest(range(len(s))) AS i FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(x) DESC, i) AS place FROM k), "
    "j AS (SELECT doc_id, string_agg(x, '|' ORDER BY place) AS longest FROM o WHERE place <= 3 GROUP BY doc_id) SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(longest, '') END AS longest FROM documents LEFT JOIN j USING (doc_id)",
)
def f14b(t):
    return t.documents.select("doc_id", F.array_join(X.longest_sentences(F.col("text"), 3), "|").alias("longest"))


@query("f15_word_chunks", "SELECT doc_id, least(ceil(len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) / 120.0), 12)::INT AS n FROM documents")
def f15(t):
    return t.documents.select("doc_id", F.size(X.word_chunks(F.col("text"))).alias("n"))


@query("f17_packer")
def f17(t):
    return Y.chunks(t.documents)


@query("f18_docket", "SELECT page_id, regexp_replace(lower(url), '[^0-9a-z]', '', 'g') AS k FROM pages")
def f18(t):
    return t.pages.select("page_id", X.docket(F.col("url")).alias("k"))


def clean_html_sql(html: str) -> str:
    """As one expression; an element's end must name its start, which is written out for both kinds."""
    out = html
    for kind in ("script", "style"):
        out = f"regexp_replace({out}, '(?is)<{kind}[^>]*>.*?</{kind}>', ' ', 'g')"
    out = f"regexp_replace({out}, '<[^>]+>', ' ', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query("f19_clean_html", f"SELECT page_id, {clean_html_sql('html')} AS text FROM pages")
def f19(t):
    return t.pages.select("page_id", X.clean_html(F.col("html")).alias("text"))


@query("f20_headnote", "SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 2 THEN ' (x) Ende' ELSE '' END AS out FROM part")
def f20(t):
    """Names as headnotes: numbered and with closing parentheses, lettered, with one in between."""
    k = F.col("p_partkey") % 3
    number = F.when(k == 0, F.concat(F.format_string("%d", F.col("p_size")), F.lit(". "))).when(k == 1, F.lit("a) ")).otherwise(F.lit(" "))
    end = F.when(k == 0, F.lit(" (amtlicher Leitsatz) (Rn. 3)")).when(k == 1, F.lit(" (Rn. 12)")).otherwise(F.lit(" (x) Ende"))
    return t.part.select("p_partkey", X.clean_headnote(F.concat(number, "p_name", end)).alias("out"))


@query("f21_embed_text", "SELECT doc_id, md5(source || chr(10) || left(text, 4000)) AS h FROM documents")
def f21(t):
    return t.documents.select("doc_id", F.md5(X.embed_text(F.col("source"), F.col("text"))).alias("h"))


@query("f22_last_score", "SELECT event_id, value AS score FROM events")
def f22(t):
    text = F.concat(F.lit("so [[0.3]] or [["), F.replace(F.col("value").cast("string"), F.lit("."), F.lit(",")), F.lit("]]"))
    return t.events.select("event_id", X.last_score(text).alias("score"))


@query("f23_strip_thinking", "SELECT conv_id, turn, trim(text) AS text FROM conversations")
def f23(t):
    return t.conversations.select("conv_id", "turn", X.strip_thinking(F.concat(F.lit("<Think>a\nb</think> "), "text")).alias("text"))


@query("f26_jaccard", "WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) AS w FROM documents) SELECT a.doc_id, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 9) AS j FROM w a JOIN w b ON b.doc_id = a.doc_id + 1 WHERE len(a.w) + len(b.w) > 0")
def f26(t):
    words = F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda x: x != ""))
    a = t.documents.select("doc_id", words.alias("a"))
    b = t.documents.select((F.col("doc_id") - 1).alias("doc_id"), words.alias("b"))
    return a.join(b, "doc_id").where(F.size("a") + F.size("b") > 0).select("doc_id", r(X.jaccard(F.col("a"), F.col("b"))).alias("j"))


@query(
    "f27_citation_similarity",
    f"WITH a AS ({cited_sql('DISTINCT doc_id, lower(clean) AS book, section')} WHERE clean IS NOT NULL), g AS (SELECT doc_id, book, section FROM (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL), (VALUES ('vwgo', '310'), ('vwgo', '410a'), ('bv', '505')) v(book, section)), "
    "n AS (SELECT doc_id, count(*) AS found FROM a GROUP BY 1), b AS (SELECT g.doc_id, count(a.book) AS common FROM g LEFT JOIN a USING (doc_id, book, section) GROUP BY 1) SELECT doc_id, round(common / (found + 3 - common), 9) AS similarity FROM n JOIN b USING (doc_id)",
)
def f27(t):
    two = cited(t).withColumn("gold", F.lit("§§ 310, 410a VwGO und Art. 505 BV"))
    a = C.with_citations(two.withColumn("text", X.spacing(F.col("text"))), "text", "ca")
    both = C.with_citations(a, "gold", "cb")
    key = lambda c: F.array_distinct(F.transform(c, lambda x: F.concat_ws("|", F.lower(x["book"]), F.lower(x["section"]))))
    return both.select("doc_id", r(X.jaccard(key(F.col("ca")), key(F.col("cb")))).alias("similarity"))


@query("f28_precision_recall", "WITH a AS (SELECT o_custkey AS k, list(DISTINCT o_orderstatus) AS a FROM orders WHERE o_totalprice < 100000 GROUP BY 1), b AS (SELECT o_custkey AS k, list(DISTINCT o_orderstatus) AS b FROM orders WHERE o_totalprice > 80000 GROUP BY 1) SELECT k, round(len(list_intersect(a, b)) / len(a), 9) AS p, round(len(list_intersect(a, b)) / len(b), 9) AS r FROM a JOIN b USING (k)")
def f28(t):
    s = lambda cond, n: t.orders.where(cond).groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderstatus").alias(n))
    p, rec = X.precision_recall(F.col("a"), F.col("b"))
    return s("o_totalprice < 100000", "a").join(s("o_totalprice > 80000", "b"), "k").select("k", r(p).alias("p"), r(rec).alias("r"))


#: Each document's case, and the longest run of words that it shares with its case's text: equal words at places i and j
#: lie on the diagonal i - j, and a run is an unbroken stretch of one.
SPAN_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_§]+')"
CASES = "cases AS (SELECT item_id AS c, text AS b, (SELECT count(*) FROM benchmark) AS n FROM benchmark WHERE item_id IS NOT NULL)"


def spans_sql(pairs: str) -> str:
    """pairs: a SELECT of (id, c), all distinct; makes `spans` (id, c, span)."""
    return (
        f"{CASES}, pairs AS ({pairs}), wa AS (SELECT doc_id AS id, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT doc_id, {SPAN_WORDS.format('text')} AS w FROM documents)), "
        f"wb AS (SELECT c, unnest(w) AS w, unnest(range(len(w))) AS j FROM (SELECT c, {SPAN_WORDS.format('b')} AS w FROM cases)), "
        "hits AS (SELECT p.id, p.c, i, i - j AS d FROM pairs p JOIN wa USING (id) JOIN wb ON wb.c = p.c AND wb.w = wa.w), "
        "isles AS (SELECT id, c, d, i - row_number() OVER (PARTITION BY id, c, d ORDER BY i) AS k FROM hits), runs AS (SELECT id, c, count(*) AS n FROM isles GROUP BY id, c, d, k), "
        "spans AS (SELECT p.id, p.c, least(coalesce(max(n), 0), 400)::INT AS span FROM pairs p LEFT JOIN runs USING (id, c) GROUP BY p.id, p.c)"
    )


def with_cases(t):
    """Documents with the item of their case, by place in turn."""
    n = t.benchmark.count()
    docs = t.documents.where("doc_id IS NOT NULL").select("doc_id", "text", (F.col("doc_id") % max(1, n)).alias("c"))
    return docs, t.benchmark.select(F.col("item_id").alias("c"), F.col("text").alias("b")), n


@query("f29_longest_span", f"WITH {spans_sql('SELECT doc_id AS id, c FROM documents JOIN cases ON c = doc_id % n')} SELECT id AS doc_id, c AS item_id, span FROM spans")
def f29(t):
    """The longest span of each document and its case's item."""
    docs, items, _ = with_cases(t)
    return Y.with_longest_span(docs.join(items, "c"), "text", "b").select("doc_id", F.col("c").alias("item_id"), "span")


@query("f30_rouge_l")
def f30(t):
    c = t.conversations
    a = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    return Y.with_rouge(a.join(b, ["conv_id", "turn"]), "a", "q").select("conv_id", "turn", r("rouge_l").alias("rouge_l"))


@query("f31_token_estimate", "WITH c AS (SELECT sum(n_chars) / sum(n_chars // 4) AS cpt FROM documents) SELECT doc_id, round_even(n_chars / cpt, 0) AS tokens FROM documents, c")
def f31(t):
    c = t.documents.agg((F.sum("n_chars") / F.sum(F.floor(F.col("n_chars") / 4))).alias("cpt"))
    return t.documents.crossJoin(F.broadcast(c)).select("doc_id", F.bround(F.col("n_chars") / F.col("cpt"), 0).alias("tokens"))


@query("f32_dict_cell", "SELECT event_id, value AS cost FROM events")
def f32(t):
    cell = F.concat(F.lit("{'ok': True, 'err': None, 'cost': "), F.col("value").cast("string"), F.lit("}"))
    parsed = F.from_json(X.python_dict_json(cell), "ok boolean, err string, cost double", {"allowSingleQuotes": "true"})
    return t.events.select("event_id", parsed["cost"].alias("cost"))


@query("f33_leading_number", "SELECT s_suppkey, round(s_acctbal, 1) AS v FROM supplier")
def f33(t):
    cell = F.concat(F.round("s_acctbal", 1).cast("decimal(20,1)").cast("string"), F.lit("$_{±0.3}$"))
    return t.supplier.select("s_suppkey", X.leading_number(cell).alias("v"))


@query("f36_iso_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders")
def f36(t):
    return t.orders.select("o_orderkey", X.iso_date(F.date_format("o_orderdate", "dd.MM.yyyy")).alias("d"))


@query("f37_json_or_null", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def f37(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("f38_grid", "SELECT event_id, least(greatest(round_even(value / 10, 0), 0), 10)::DOUBLE AS level FROM events")
def f38(t):
    return t.events.select("event_id", X.grid_level(F.col("value")).alias("level"))


COSTS = "WITH b AS (SELECT l_suppkey, max((l_tax > 0.07)::INT) = 1 AS billed FROM lineitem GROUP BY 1) "


@query("f40_cost_per_row", COSTS + "SELECT l_suppkey, round(sum(CASE WHEN billed AND l_tax > 0 THEN l_extendedprice * l_tax ELSE l_quantity * p_retailprice / 1e6 END), 6) AS cost FROM lineitem JOIN b USING (l_suppkey) JOIN part ON p_partkey = l_partkey GROUP BY 1")
def f40(t):
    from pyspark.sql.window import Window

    li = t.lineitem.withColumn("billed", F.max((F.col("l_tax") > 0.07).cast("int")).over(Window.partitionBy("l_suppkey")) == 1)
    cost = F.when(F.col("billed") & (F.col("l_tax") > 0), F.col("l_extendedprice") * F.col("l_tax")).otherwise(F.col("l_quantity") * F.col("p_retailprice") / 1e6)
    return li.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy("l_suppkey").agg(r(F.sum(cost), 6).alias("cost"))


@query("f40_cost_per_model", "SELECT l_suppkey, round(avg(l_quantity) * avg(p_retailprice) / 1e6, 9) AS cost FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def f40b(t):
    j = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return j.groupBy("l_suppkey").agg(r(F.avg("l_quantity") * F.avg("p_retailprice") / 1e6).alias("cost"))


@query("f25_context", "SELECT source, md5(string_agg('<norm rank=\"' || k || '\">' || left(text, 50) || '</norm>', chr(10) ORDER BY k)) AS h FROM (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 5 GROUP BY source")
def f25(t):
    top = R.top_k(t.documents.select("source", "doc_id", "text"), ["source"], 5, F.asc("doc_id"))
    return context(top).select("source", F.md5("context").alias("h"))


def context(top, style: str = "ranked"):
    """(source, context): rows as XML blocks in order; 'reversed' turns the order, 'plain' leaves ranks out,
    'provenance' names each row's document."""
    rank = F.concat(F.lit('<norm rank="'), F.col("rank").cast("string"), F.lit('">'))
    named = F.concat(F.lit('<norm from="'), F.col("doc_id").cast("string"), F.lit('">'))
    head = {"plain": F.lit("<norm>"), "provenance": named}.get(style, rank)
    place = -F.col("rank") if style == "reversed" else F.col("rank")
    block = F.struct(place.alias("k"), F.concat(head, F.substring("text", 1, 50), F.lit("</norm>")).alias("x"))
    return top.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda b: b["x"]), "\n").alias("context"))


@query("f25_context_styles", "SELECT style, count(*) AS n FROM (SELECT DISTINCT source FROM documents), (SELECT unnest(['plain', 'ranked', 'reversed', 'provenance']) AS style) GROUP BY style")
def f25s(t):
    top = R.top_k(t.documents.select("source", "doc_id", "text"), ["source"], 5, F.asc("doc_id"))
    out = None
    for style in ("plain", "ranked", "reversed", "provenance"):
        part = context(top, style).select(F.lit(style).alias("style"), "source")
        out = part if out is None else out.union(part)
    return out.groupBy("style").agg(F.count("*").alias("n"))


@query(
    "f16_split_long",
    f"WITH RECURSIVE s AS (SELECT doc_id, text, list_transform({sentences_sql('[A-ZÄÖÜ„(§]')}, lambda x: length(x)) AS n FROM documents), "
    "f AS (SELECT doc_id, 1 AS i, n[1] AS size, 1 AS runs, n FROM s WHERE text <> '' UNION ALL SELECT doc_id, i + 1, CASE WHEN size + 1 + n[i + 1] <= 300 THEN size + 1 + n[i + 1] ELSE n[i + 1] END, runs + (size + 1 + n[i + 1] > 300)::INT, n FROM f WHERE i < len(n)) "
    "SELECT doc_id, coalesce(max(runs), 0)::INT AS runs FROM documents LEFT JOIN f USING (doc_id) GROUP BY doc_id",
)
def f16(t):
    return Y.with_runs(t.documents, "text", "runs", 300).select("doc_id", F.size("runs").alias("runs"))


@query("f24_display", "SELECT p_partkey, 'Art. ' || p_size || ' ' || p_brand || ' – ' || p_name || ' – Landesrecht' AS head FROM part")
def f24(t):
    return t.part.select("p_partkey", C.heading(F.col("p_brand"), F.col("p_size").cast("string"), F.lit("Art"), F.col("p_name"), F.lit("state")).alias("head"))


@query("f34_cells", "SELECT l_returnflag, printf('%.1f', round(avg(l_quantity), 1)) AS cell FROM lineitem GROUP BY 1")
def f34(t):
    """Cells are made on the driver from rows already aggregated."""
    from .render import mean_cell

    rows = t.lineitem.groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 1).alias("m")).collect()
    return t.spark.createDataFrame([(x["l_returnflag"], mean_cell(x["m"], None)) for x in rows], "l_returnflag string, cell string")


@query("f35_short_names", "SELECT n_name AS name, n_name AS short FROM nation")
def f35(t):
    from .render import unique_short

    names = unique_short([x[0] for x in t.nation.select("n_name").collect()])
    return t.spark.createDataFrame(list(names.items()), "name string, short string")


@query("f39_colours", "SELECT n_nationkey AS k, round(least(1.0, greatest(0.0, n_nationkey / 24.0)), 9) AS tint FROM nation")
def f39(t):
    from .render import tint

    return t.spark.createDataFrame([(x[0], round(tint(x[0], 0, 24), 9)) for x in t.nation.select("n_nationkey").collect()], "k int, tint double")
