"""Guards and payload handling: validation flags, cleaned values, metadata filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions import guards as g
from corpusflow.operators.payload import matches, model_limit, split_payload
from corpusflow.plans.corpus import MATHY, mathy
from corpusflow.plans.registry import query
from corpusflow.plans.sqlparts import TURNS
from corpusflow.sources.tables import spread, table, user_turns


def _plain(pattern: str) -> str:
    """RE2 spelling of a pattern with Unicode word boundaries (test only)."""
    text = pattern.replace(r"\b(", r"(?:^|[^\p{L}\p{N}_])(").replace(r"\b)", r")").replace(r")\b", r")(?:$|[^\p{L}\p{N}_])")
    text = text.replace(r"\bUNION\b.*\bSELECT\b", r"(?:^|[^\p{L}\p{N}_])UNION[^\p{L}\p{N}_].*[^\p{L}\p{N}_]SELECT(?:$|[^\p{L}\p{N}_])")
    text = text.replace(r"\bOR\b", r"(?:^|[^\p{L}\p{N}_])OR(?:$|[^\p{L}\p{N}_])").replace(r"on\w+", r"on[\p{L}\p{N}_]+")
    return text.replace(r"[/\w]", r"[/\p{L}\p{N}_]").replace("'", "''")


def _any(column: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '(?i){_plain(p)}')" for p in patterns) + ")"


PROBLEM = f"""CASE WHEN len(text) > 2000 THEN 'length' WHEN {_any('upper(text)', g.SQL_PATTERNS)} THEN 'sql'
  WHEN {_any('text', g.XSS_PATTERNS)} THEN 'xss' WHEN {_any('text', g.COMMAND_PATTERNS)} THEN 'command' END"""


@query("document_guard", "B8", f"SELECT doc_id, problem IS NULL AS is_valid, coalesce(problem, '') AS problem FROM (SELECT doc_id, {PROBLEM} AS problem FROM documents)")
def document_guard(spark, root):
    """First broken input rule of every document text."""
    flagged = spread(table(spark, root, "documents")).select("doc_id", g.query_problem(F.col("text")).alias("problem"))
    return flagged.select("doc_id", F.isnull("problem").alias("is_valid"), F.coalesce("problem", F.lit("")).alias("problem"))


@query("page_guard", "B8 H15", f"""SELECT coalesce(problem, 'none') AS problem, count(*) AS pages FROM (
  SELECT {PROBLEM.replace('len(text) > 2000', 'len(text) > 1000000')} AS problem FROM (SELECT html AS text FROM pages)) GROUP BY 1""")
def page_guard(spark, root):
    """How many raw pages break which rule."""
    flagged = spread(table(spark, root, "pages")).select(g.query_problem(F.col("html"), 1_000_000).alias("problem"))
    return flagged.groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("pages"))


@query("query_length_gate", "B9", f"""
SELECT query_id, len(trim(text)) >= 3 AND len(text) <= 512 AS analyzable, len(text) <= 2000 AS rankable,
  count(*) OVER (PARTITION BY conv_id) <= 100 AS batch_ok FROM ({TURNS})""")
def query_length_gate(spark, root):
    """Length rules of analysis and ranking, and the size rule of a ranking batch."""
    turns = user_turns(spark, root)
    sizes = turns.groupBy("conv_id").agg((F.count("*") <= 100).alias("batch_ok"))
    n = F.length("text")
    return turns.join(sizes, "conv_id").select(
        "query_id", ((F.length(F.trim("text")) >= 3) & (n <= 512)).alias("analyzable"), (n <= 2000).alias("rankable"), "batch_ok")


@query("email_check", "B11", r"""
SELECT doc_id, address, regexp_matches(address, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$') AS is_email
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^\s@]+@[^\s@]+')) AS address FROM documents)""")
def email_check(spark, root):
    """Everything around an @ in the documents, tested as an e-mail address."""
    found = spread(table(spark, root, "documents")).select(
        "doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^\s@]+@[^\s@]+"), F.lit(0))).alias("address"))
    return found.withColumn("is_email", g.is_email(F.col("address")))


URL_FORMS = [("plain", None), ("local", "//LOCALHOST:80"), ("private", "//10.1.2.3"), ("lan", "//user@192.168.0.9"), ("meta", "//169.254.169.254")]


@query("url_check", "B12", r"""
SELECT page_id, form, scheme IN ('http', 'https') AND host NOT IN ('localhost', '127.0.0.1', '0.0.0.0', '::1', '169.254.169.254', 'metadata.google.internal')
  AND NOT host LIKE '10.%' AND NOT host LIKE '192.168.%' AS is_safe FROM (
 SELECT page_id, form, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
   lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM (
 SELECT page_id, 'plain' AS form, url AS u FROM pages UNION ALL
 SELECT page_id, 'local', regexp_replace(url, '//[^/]*', '//LOCALHOST:80') FROM pages UNION ALL
 SELECT page_id, 'private', regexp_replace(url, '//[^/]*', '//10.1.2.3') FROM pages UNION ALL
 SELECT page_id, 'lan', regexp_replace(url, '//[^/]*', '//user@192.168.0.9') FROM pages UNION ALL
 SELECT page_id, 'meta', regexp_replace(url, '//[^/]*', '//169.254.169.254') FROM pages UNION ALL
 SELECT page_id, 'ftp', regexp_replace(url, '^[a-z]+:', 'ftp:') FROM pages))""")
def url_check(spark, root):
    """Fetch safety of every page address, as it is and pointed at blocked hosts."""
    pages = table(spark, root, "pages")
    forms = [F.struct(F.lit(name).alias("form"), (F.col("url") if host is None else F.regexp_replace("url", "//[^/]*", host)).alias("u"))
             for name, host in URL_FORMS]
    forms.append(F.struct(F.lit("ftp").alias("form"), F.regexp_replace("url", "^[a-z]+:", "ftp:").alias("u")))
    return pages.select("page_id", F.inline(F.array(*forms))).select("page_id", "form", g.is_safe_url(F.col("u")).alias("is_safe"))


@query("json_depth", "B14", """
SELECT event_id, (event_id % 14 + 1)::BIGINT AS depth, event_id % 14 + 1 <= 10 AS is_valid FROM events""")
def json_depth(spark, root):
    """Nesting depth of event properties wrapped into 0 to 13 arrays."""
    n = F.pmod("event_id", F.lit(14)).cast("int")
    wrapped = F.concat(F.repeat(F.lit("["), n), "props", F.lit(', "}{[\\"["'), F.repeat(F.lit("]"), n))
    return table(spark, root, "events").select("event_id", g.json_depth(wrapped).alias("depth")).withColumn("is_valid", F.col("depth") <= 10)


NAMES = """names AS (SELECT page_id, regexp_replace(url, '^https?://', '') || '.html' AS name FROM pages)"""


@query("collection_names", "B15", rf"""WITH {NAMES}
SELECT page_id, lower(substr(CASE WHEN regexp_matches(b, '^[^a-zA-Z]') THEN 'doc_' || b ELSE b END, 1, 46)) || '_doc' AS collection FROM (
  SELECT page_id, regexp_replace(regexp_replace(name, '\.[^.]+$', ''), '[^a-zA-Z0-9_-]', '_', 'g') AS b FROM names)""")
def collection_names(spark, root):
    """Collection name made from every page address."""
    name = F.concat(F.regexp_replace("url", "^https?://", ""), F.lit(".html"))
    return table(spark, root, "pages").select("page_id", g.collection_name(name).alias("collection"))


@query("collection_resolution", "B16 F16", """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) >= (SELECT count(*) / count(DISTINCT source) FROM documents))
SELECT doc_id, CASE WHEN c.source IS NOT NULL THEN d.source ELSE 'src0' END AS collection, c.source IS NULL AS fell_back
FROM documents d LEFT JOIN c USING (source)""")
def collection_resolution(spark, root):
    """Requested collection, or the default one where the catalog does not have it."""
    docs = table(spark, root, "documents")
    size = docs.agg((F.count("*") / F.count_distinct("source")).alias("s")).scalar()
    catalog = docs.groupBy("source").agg(F.count("*").alias("n")).filter(F.col("n") >= size).select("source", F.lit(True).alias("known"))
    known = F.coalesce("known", F.lit(False))
    return docs.join(catalog, "source", "left").select(
        "doc_id", F.when(known, F.col("source")).otherwise("src0").alias("collection"), (~known).alias("fell_back"))


LATEX = MATHY + r""", latex AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '\Input{x} ' ELSE '' END || text || ' % note' || chr(10) || 'end' AS t FROM mathy)"""
DANGER = r"'(?i)\\(write|input|include|openin|openout|read|csname|expandafter|catcode|def|let|futurelet)'"


def latex(spark, root):
    unsafe = F.when(F.pmod("doc_id", F.lit(11)) == 0, "\\Input{x} ").otherwise("")
    return mathy(spark, root).select("doc_id", F.concat(unsafe, "text", F.lit(" % note\nend")).alias("t"))


@query("latex_guard", "B17", rf"""WITH {LATEX}
SELECT doc_id, coalesce(CASE WHEN len(t) > 10000 THEN 'too_long' WHEN regexp_matches(t, {DANGER}) THEN 'dangerous' END, '') AS problem,
  md5(regexp_replace(regexp_replace(t, '%[^\n]*', '', 'g'), '^\s+|\s+$', '', 'g')) AS cleaned,
  array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\\([a-zA-Z]+)', 1))), ' ') AS commands FROM latex""")
def latex_guard(spark, root):
    """Refused commands, comment-free text and the commands in use."""
    t = F.col("t")
    return latex(spark, root).select(
        "doc_id", F.coalesce(g.latex_problem(t), F.lit("")).alias("problem"),
        F.md5(g.strip_latex_comments(t)).alias("cleaned"), F.array_join(g.latex_commands(t), " ").alias("commands"))


@query("latex_batch", "B18", rf"""WITH {LATEX}, v AS (
SELECT CASE WHEN len(t) > 10000 THEN 'too_long' WHEN regexp_matches(t, {DANGER}) THEN 'dangerous' ELSE 'none' END AS problem FROM latex)
SELECT problem, count(*) AS n, (SELECT count(*) FROM v WHERE problem = 'none') AS valid, (SELECT count(*) FROM v WHERE problem <> 'none') AS invalid FROM v GROUP BY 1""")
def latex_batch(spark, root):
    """Batch totals with errors kept as rows."""
    flagged = latex(spark, root).select(F.coalesce(g.latex_problem(F.col("t")), F.lit("none")).alias("problem"))
    per = flagged.groupBy("problem").agg(F.count("*").alias("n"))
    ok = per.agg(F.coalesce(F.sum(F.when(F.col("problem") == "none", F.col("n"))), F.lit(0))).scalar()
    bad = per.agg(F.coalesce(F.sum(F.when(F.col("problem") != "none", F.col("n"))), F.lit(0))).scalar()
    return per.select("problem", "n", ok.alias("valid"), bad.alias("invalid"))


@query("live_documents", "B19", """
SELECT d.doc_id, n_chars FROM documents d LEFT JOIN labels USING (doc_id) WHERE NOT coalesce(toxic = 1, FALSE)""")
def live_documents(spark, root):
    """Documents without a deletion mark; a toxic label is the mark."""
    gone = table(spark, root, "labels").filter("toxic = 1").select("doc_id")
    return table(spark, root, "documents").join(gone, "doc_id", "left_anti").select("doc_id", "n_chars")


@query("payload_filter", "B4", """
SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'fr') AND source = 'src7'""")
def payload_filter(spark, root):
    """Metadata filter from a dictionary; a list means any of its values."""
    docs = table(spark, root, "documents").select("doc_id", "lang", "source")
    return docs.filter(matches({"lang": ["en", "fr"], "source": "src7"}))


@query("payload_split", "B6", """
SELECT doc_id, md5(text) AS content, 3::BIGINT AS n_meta, 'lang=' || lang || ';n_chars=' || n_chars || ';source=' || source AS metadata FROM documents""")
def payload_split(spark, root):
    """Stored payload divided into its text and everything else."""
    payload = F.create_map(F.lit("text"), "text", F.lit("source"), "source", F.lit("lang"), "lang",
                           F.lit("n_chars"), F.col("n_chars").cast("string"))
    text, rest = split_payload(payload)
    pairs = F.array_sort(F.transform(F.map_entries("rest"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return table(spark, root, "documents").select("doc_id", text.alias("t"), rest.alias("rest")).select(
        "doc_id", F.md5("t").alias("content"), F.size("rest").alias("n_meta"), F.array_join(pairs, ";").alias("metadata"))


@query("context_budget", "B21", """
SELECT query_id, model, tokens, lim, tokens + 1000 > lim AS over FROM (
  SELECT conv_id * 1000 + turn AS query_id, model, len(repeat(text, 20)) // 4 AS tokens,
    CASE WHEN starts_with(model, 'gpt-4') THEN 8192 WHEN starts_with(model, 'gpt-3.5-turbo') THEN 4096 ELSE 4096 END::BIGINT AS lim
  FROM (SELECT *, ['gpt-4', 'gpt-4-32k', 'gpt-3.5-turbo-16k', 'other'][(turn % 4 + 1)::INT] AS model FROM conversations))""")
def context_budget(spark, root):
    """Prompt tokens plus answer room against the model's limit."""
    models = F.array(*[F.lit(m) for m in ("gpt-4", "gpt-4-32k", "gpt-3.5-turbo-16k", "other")])
    rows = table(spark, root, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.get(models, F.pmod("turn", F.lit(4)).cast("int")).alias("model"),
        F.floor(F.length(F.repeat("text", F.lit(20))) / 4).cast("long").alias("tokens"))
    return rows.withColumn("lim", model_limit(F.col("model"))).withColumn("over", F.col("tokens") + 1000 > F.col("lim"))


@query("source_previews", "B7", """
WITH r AS (SELECT page_id, url, html, row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) AS pos FROM pages)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Source ' || pos ELSE 'Page ' || page_id END AS title,
  substr(html, 1, 300) || CASE WHEN len(html) > 300 THEN '...' ELSE '' END AS preview, url AS link FROM r""")
def source_previews(spark, root):
    """Preview rows of answer sources: title fallback, short text, first link found."""
    from corpusflow.operators.payload import preview

    pages = table(spark, root, "pages")
    meta = F.when(F.pmod("page_id", F.lit(3)) != 0, F.create_map(F.lit("title"), F.concat(F.lit("Page "), "page_id"), F.lit("link"), F.col("url"))).otherwise(
        F.create_map(F.lit("source_url"), F.col("url")))
    rows = pages.select("page_id", F.expr("page_id div 10").alias("answer"), "html", meta.alias("metadata"))
    return preview(rows, ["answer"], "page_id", "html", 300).select("page_id", "title", "preview", "link")
