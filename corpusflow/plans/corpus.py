"""Corpus preparation: filters, cleaning, formulas, sentences, chunks, keys and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions import math as fm
from corpusflow.functions.text import squeeze, token_estimate, tokens, words
from corpusflow.operators import chunking
from corpusflow.operators.ranking import running_total, stable
from corpusflow.plans import sqlparts as sql
from corpusflow.plans.registry import query
from corpusflow.sources.tables import spread, table


def articles(spark, root):
    """Documents as articles: the title is made of source and id."""
    return spread(table(spark, root, "documents").select(
        "doc_id", "text", "lang", "source",
        F.concat_ws(" ", "source", F.col("doc_id").cast("string")).alias("title")))


def mathy(spark, root):
    """Every document with formulas and a code block built from its own numbers put in front."""
    text = F.concat(
        F.lit("Let \\frac{"), F.col("n_chars"), F.lit("}{"), F.col("doc_id"), F.lit("} and \\sqrt{"),
        F.pmod("doc_id", F.lit(7)), F.lit("} with $x^"), F.pmod("doc_id", F.lit(5)), F.lit(" = "), F.col("n_chars"),
        F.lit("$ and \\begin{equation}y="), F.col("doc_id"), F.lit("\\end{equation} $$z+"), F.col("doc_id"),
        F.lit("$$\n```python\nprint("), F.col("doc_id"), F.lit(")\n```\n"), F.col("text"))
    return spread(table(spark, root, "documents").select("doc_id", text.alias("text"), "n_chars"))


MATHY = r"""mathy AS (SELECT doc_id, n_chars, 'Let \frac{' || n_chars || '}{' || doc_id || '} and \sqrt{' || doc_id % 7
  || '} with $x^' || doc_id % 5 || ' = ' || n_chars || '$ and \begin{equation}y=' || doc_id || '\end{equation} $$z+'
  || doc_id || '$$' || chr(10) || '```python' || chr(10) || 'print(' || doc_id || ')' || chr(10) || '```' || chr(10) || text AS text
  FROM documents)"""


def _formula_sql(patterns, flags):
    parts = []
    for pattern, groups in patterns:
        text = (flags + pattern).replace("'", "''")
        one = f"regexp_extract_all(text, '{text}', {1 if groups == 2 else groups})"
        if groups == 2:
            one = (f"list_filter(list_transform(list_zip({one}, regexp_extract_all(text, '{text}', 2)), "
                   "lambda p: CASE WHEN coalesce(p[1], '') <> '' THEN p[1] ELSE p[2] END), lambda f: coalesce(f, '') <> '')")
        parts.append(one)
    body = ", ".join(parts)
    return f"list_sort(list_distinct(flatten([{body}])))"


@query("accepted_articles", "A1 B1", """
SELECT doc_id, title, lang, len(text) AS n FROM (SELECT *, source || ' ' || doc_id AS title FROM documents)
WHERE text <> '' AND title <> '' ORDER BY doc_id LIMIT 500""")
def accepted_articles(spark, root, most=500):
    """Corpus scan that stops after ``most`` accepted articles (text and title present)."""
    ok = articles(spark, root).filter("text <> '' and title <> ''")
    return ok.orderBy("doc_id").limit(most).select("doc_id", "title", "lang", F.length("text").alias("n"))


@query("collection_scroll", "A5", """
SELECT kind, id, len(t) AS n_chars, md5(t) AS digest FROM (
 SELECT 'd' AS kind, doc_id AS id, text AS t FROM documents UNION ALL
 SELECT 'p', page_id, html FROM pages UNION ALL SELECT 'c', conv_id * 1000 + turn, text FROM conversations)
WHERE t <> ''""")
def collection_scroll(spark, root):
    """Text of every stored point: the first of text, content, page_content that is not empty."""
    blank = F.lit("")
    points = (
        table(spark, root, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "text", blank.alias("content"), blank.alias("page_content"))
        .unionByName(table(spark, root, "pages").select(F.lit("p").alias("kind"), F.col("page_id").alias("id"), blank.alias("text"), F.col("html").alias("content"), blank.alias("page_content")))
        .unionByName(table(spark, root, "conversations").select(F.lit("c").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), blank.alias("text"), blank.alias("content"), F.col("text").alias("page_content"))))
    first = F.coalesce(*[F.nullif(F.col(c), blank) for c in ("text", "content", "page_content")])
    return points.withColumn("t", first).filter("t is not null").select(
        "kind", "id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


@query("decoded_uploads", "A4", "SELECT doc_id, len(text) AS n, md5(text) AS digest FROM documents")
def decoded_uploads(spark, root):
    """Bytes decoded as UTF-8 and, where that is invalid, as Latin-1."""
    narrow = (F.pmod("doc_id", F.lit(2)) == 1) & F.col("text").rlike(r"^[\x{00}-\x{FF}]*$")
    stored = table(spark, root, "documents").select(
        "doc_id", F.when(narrow, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8")).alias("raw"))
    from corpusflow.sources.files import decode_text

    return stored.select("doc_id", decode_text(F.col("raw")).alias("t")).select(
        "doc_id", F.length("t").alias("n"), F.md5("t").alias("digest"))


@query("file_types", "A3", """
SELECT doc_id, name, CASE WHEN doc_id % 5 = 0 THEN 'txt' WHEN doc_id % 5 = 1 THEN 'md' WHEN doc_id % 5 = 2 THEN 'pdf'
  WHEN doc_id % 5 = 3 THEN 'docx' ELSE 'txt' END AS kind FROM (SELECT doc_id, source || '_' || doc_id ||
  ['.TXT', '.md', '.pdf', '.docx', '.bin'][(doc_id % 5 + 1)::INT] AS name FROM documents)""")
def file_types(spark, root):
    """Parser choice by file name; unknown endings are tried as text."""
    from corpusflow.sources.files import kind_of

    endings = F.array(*[F.lit(e) for e in (".TXT", ".md", ".pdf", ".docx", ".bin")])
    name = F.concat("source", F.lit("_"), F.col("doc_id"), F.get(endings, F.pmod("doc_id", F.lit(5)).cast("int")))
    return table(spark, root, "documents").select("doc_id", name.alias("name")).withColumn("kind", kind_of(F.col("name")))


@query("math_articles", "B2 C2", rf"""
SELECT doc_id, n_formulas FROM (SELECT doc_id, len({_formula_sql(fm.INGEST_PATTERNS, fm.INGEST_FLAGS)}) AS n_formulas FROM documents)
WHERE n_formulas > 0""")
def math_articles(spark, root):
    """Only articles in which a formula is found."""
    found = articles(spark, root).select("doc_id", F.size(fm.ingest_formulas(F.col("text"))).alias("n_formulas"))
    return found.filter("n_formulas > 0")


@query("clean_html", "C1", r"""
SELECT page_id, len(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id,
  trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS t FROM pages)""")
def clean_html(spark, root):
    """Page text without tags (math tags stay), whitespace collapsed."""
    bare = F.regexp_replace("html", r"<(?!math|/math)[^>]+>", "")
    text = F.btrim(F.regexp_replace(bare, r"[\s\p{Z}]+", " "))
    return spread(table(spark, root, "pages")).select("page_id", text.alias("t")).select(
        "page_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


@query("ingest_formulas", "C2", rf"""WITH {MATHY}
SELECT doc_id, len(f) AS n_formulas, md5(array_to_string(f, chr(30))) AS digest FROM (
  SELECT doc_id, {_formula_sql(fm.INGEST_PATTERNS, fm.INGEST_FLAGS)} AS f FROM mathy)""")
def ingest_formulas(spark, root):
    """Distinct formulas of every article by the ingest patterns."""
    found = mathy(spark, root).select("doc_id", fm.ingest_formulas(F.col("text")).alias("f"))
    return found.select("doc_id", F.size("f").alias("n_formulas"), F.md5(F.array_join("f", "\x1e")).alias("digest"))


@query("processor_formulas", "C3", rf"""WITH {MATHY}
SELECT doc_id, len(f) AS n_formulas, len(f) > 0 OR regexp_matches(text, '[{fm.MATH_SYMBOLS}]') AS has_math,
  md5(array_to_string(f, chr(30))) AS digest FROM (
  SELECT doc_id, text, {_formula_sql(fm.PROCESSOR_PATTERNS, '')} AS f FROM mathy)""")
def processor_formulas(spark, root):
    """Distinct formulas of every upload and the math flag."""
    found = mathy(spark, root).select("doc_id", "text", fm.processor_formulas(F.col("text")).alias("f"))
    return found.select("doc_id", F.size("f").alias("n_formulas"), fm.has_math(F.col("text"), F.col("f")).alias("has_math"),
                        F.md5(F.array_join("f", "\x1e")).alias("digest"))


@query("math_markers", "C4", rf"""WITH {MATHY}
SELECT doc_id, len(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text,
  '(?s)\$\$([^$]+)\$\$', '[MATH_START]\1[MATH_END]', 'g'),
  '(?s)\\begin\{{equation\*?\}}(.*?)\\end\{{equation\*?\}}', '[MATH_START]\1[MATH_END]', 'g'),
  '(?s)\\begin\{{align\*?\}}(.*?)\\end\{{align\*?\}}', '[MATH_START]\1[MATH_END]', 'g') AS t FROM mathy)""")
def math_markers(spark, root):
    """Display math wrapped into markers."""
    marked = mathy(spark, root).select("doc_id", fm.mark_math(F.col("text")).alias("t"))
    return marked.select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


@query("code_blocks", "C5", rf"""WITH {MATHY}
SELECT doc_id, len(c) AS n_blocks, len(c) > 0 AS has_code, md5(array_to_string(c, chr(30))) AS digest FROM (
  SELECT doc_id, list_filter(regexp_extract_all(text, '(?s)```(\w*)\n?(.*?)```', 2), lambda b: regexp_matches(b, '\S')) AS c FROM mathy)""")
def code_blocks(spark, root):
    """Fenced code blocks of every document."""
    found = mathy(spark, root).select("doc_id", fm.code_blocks(F.col("text")).alias("c"))
    return found.select("doc_id", F.size("c").alias("n_blocks"), (F.size("c") > 0).alias("has_code"),
                        F.md5(F.array_join("c", "\x1e")).alias("digest"))


@query("token_estimates", "C6", "SELECT doc_id, len(text) // 4 AS est_tokens FROM documents")
def token_estimates(spark, root):
    """Estimated tokens: a quarter of the characters."""
    return table(spark, root, "documents").select("doc_id", token_estimate("text").alias("est_tokens"))


SENTENCES = r"""sent AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text,
  '(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|vs|etc|i\.e|e\.g)\.\s', '\1[DOT] ', 'g'), '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)),
  lambda s: regexp_replace(replace(s, '[DOT]', '.'), '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS s FROM documents)"""


@query("sentences", "C7", f"""WITH {SENTENCES}
SELECT doc_id, unnest(range(len(s))) AS pos, md5(unnest(s)) AS digest FROM sent""")
def sentences(spark, root):
    """One row per sentence with its position."""
    cut = articles(spark, root).select("doc_id", F.posexplode(chunking.sentences(F.col("text"))).alias("pos", "s"))
    return cut.select("doc_id", "pos", F.md5("s").alias("digest"))


@query("paragraphs", "C8", r"""WITH h AS (SELECT doc_id, regexp_replace(text, '([.!?])\n', '\1' || chr(10) || chr(10), 'g') AS text FROM documents)
SELECT doc_id, len(p) AS n_paragraphs, md5(array_to_string(p, chr(30))) AS digest FROM (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\n\s*\n', chr(30), 'g'), chr(30)),
    lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS p FROM h)""")
def paragraphs(spark, root):
    """Paragraphs of every document, lines that end a sentence made paragraph ends."""
    text = F.regexp_replace("text", r"([.!?])\n", "$1\n\n")
    cut = articles(spark, root).select("doc_id", chunking.paragraphs(text).alias("p"))
    return cut.select("doc_id", F.size("p").alias("n_paragraphs"), F.md5(F.array_join("p", "\x1e")).alias("digest"))


def packing_sql(size, overlap):
    """Greedy packing of runs(doc_id, run, us, sep), one recursion step a chunk, as packed(doc_id, chunk_index, chunk)."""
    return rf"""costs AS (SELECT *, list_transform(us, lambda x: len(x) // 4) AS c FROM runs),
sums AS (SELECT *, len(us) AS n, list_transform(range(0, len(us) + 1), lambda i: coalesce(list_sum(c[1:i]), 0)) AS p FROM costs),
walk AS (SELECT doc_id, run, 0::BIGINT AS k, 0::BIGINT AS s, {_close_sql(size, "0", "1")} AS e FROM sums WHERE n > 0
  UNION ALL SELECT doc_id, run, k + 1, ns, {_close_sql(size, "ns", "e0 + 1")} FROM (
    SELECT w.doc_id, w.run, k, w.e AS e0, n, p, list_min(list_filter(range(w.s, w.e + 1), lambda j: p[w.e + 1] - p[j + 1] <= {overlap})) AS ns
    FROM walk w JOIN sums USING (doc_id, run) WHERE w.e < n)),
packed AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run, k) - 1 AS chunk_index, CASE WHEN sep = ' ' THEN array_to_string(us[s + 1:e], ' ') ELSE array_to_string(us[s + 1:e], chr(10) || chr(10)) END AS chunk
  FROM walk JOIN sums USING (doc_id, run))"""


def _close_sql(size, start, first):
    return f"coalesce(list_min(list_filter(range({first}, n), lambda i: p[i + 2] - p[{start} + 1] > {size})), n)"


def sentence_packing_sql(size, overlap):
    return f"""{SENTENCES}, runs AS (SELECT doc_id, 0 AS run, ' ' AS sep, CASE WHEN len(text) / 4 < {size + 1} THEN [text] ELSE s END AS us
  FROM documents JOIN sent USING (doc_id)), {packing_sql(size, overlap)}"""


def paragraph_packing_sql(size, overlap):
    """Paragraphs of documents with their sentence-ending lines made paragraph ends; long ones are runs of sentences."""
    split = SENTENCES.replace("SELECT doc_id, list_filter", "SELECT doc_id, i, list_filter").replace("FROM documents", "FROM big")
    return rf"""h AS (SELECT doc_id, regexp_replace(text, '([.!?])\n', '\1' || chr(10) || chr(10), 'g') AS text FROM documents),
para AS (SELECT doc_id, CASE WHEN len(text) / 4 < {size + 1} THEN [text] ELSE list_filter(list_transform(string_split(regexp_replace(text, '\n\s*\n', chr(30), 'g'), chr(30)),
    lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') END AS ps FROM h),
each_ AS (SELECT doc_id, unnest(range(len(ps))) AS i, unnest(ps) AS text FROM para),
big AS (SELECT * FROM each_ WHERE len(text) // 4 > {size}), {split},
placed AS (SELECT *, len(text) // 4 > {size} AS is_big, max(CASE WHEN len(text) // 4 > {size} THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS last_big FROM each_),
runs AS (SELECT doc_id, 2 * i + 1 AS run, ' ' AS sep, s AS us FROM sent
  UNION ALL SELECT doc_id, coalesce(2 * last_big + 2, 0), chr(10) || chr(10), list(text ORDER BY i) FROM placed WHERE NOT is_big GROUP BY 1, 2), {packing_sql(size, overlap)}"""


def char_walk_sql(size, overlap):
    width, back = 4 * size, 4 * overlap
    end = lambda s: f"""CASE WHEN {s} + {width} >= len(text) THEN len(text)
      WHEN instr(reverse(substr(text, {s} + 1, {width})), ' ') > 0 AND {width} - instr(reverse(substr(text, {s} + 1, {width})), ' ') > {back}
        THEN {s} + {width} - instr(reverse(substr(text, {s} + 1, {width})), ' ') ELSE {s} + {width} END"""
    return f"""w AS (SELECT doc_id, text, 0::BIGINT AS chunk_index, 0::BIGINT AS start_char, ({end("0")})::BIGINT AS end_char FROM documents WHERE text <> ''
  UNION ALL SELECT doc_id, text, chunk_index + 1, end_char - {back}, ({end(f"(end_char - {back})")})::BIGINT FROM w WHERE end_char < len(text))"""


PACKED = "SELECT doc_id, chunk_index, len(chunk) AS n_chars, md5(chunk) AS digest FROM packed"


@query("paragraph_chunks", "C9", f"WITH RECURSIVE {paragraph_packing_sql(256, 25)} {PACKED}")
def paragraph_chunks(spark, root):
    """Greedy paragraph packing, long paragraphs by sentence: 256 tokens, 25 overlap."""
    text = F.regexp_replace("text", r"([.!?])\n", "$1\n\n")
    chunks = chunking.document_chunks(articles(spark, root).select("doc_id", text.alias("text")), 256, 25)
    return chunks.select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


@query("sentence_chunks", "C10", f"WITH RECURSIVE {sentence_packing_sql(1024, 102)} {PACKED}")
def sentence_chunks(spark, root):
    """Greedy sentence packing: 1024 tokens, 102 overlap."""
    chunks = chunking.sentence_chunks(articles(spark, root).select("doc_id", "text"))
    return chunks.select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


@query("char_chunks", "C11", rf"""WITH RECURSIVE {char_walk_sql(256, 25)}
SELECT doc_id, chunk_index, start_char, end_char, md5(regexp_replace(substr(text, start_char + 1, end_char - start_char), '^\s+|\s+$', '', 'g')) AS digest FROM w""")
def char_chunks(spark, root):
    """Character windows with word back-off: 256 tokens, 25 overlap."""
    chunks = chunking.char_chunks(articles(spark, root).select("doc_id", "text"), 256, 25)
    return chunks.select("doc_id", "chunk_index", "start_char", "end_char", F.md5("chunk").alias("digest"))


def windows_sql(size, overlap, least, source="documents", key="doc_id", text="text"):
    return rf"""SELECT {key}, (start // {size - overlap})::BIGINT AS chunk_index, len(piece) AS n_words, array_to_string(piece, ' ') AS chunk
  FROM (SELECT {key}, start, w[start + 1: start + {size}] AS piece FROM (
    SELECT {key}, w, unnest(range(0, len(w), {size - overlap})) AS start FROM (
      SELECT {key}, list_filter(regexp_split_to_array({text}, '\s+'), lambda x: x <> '') AS w FROM {source})))
  WHERE len(piece) >= {size // least}"""


@query("word_windows", "C12 K5", f"""SELECT doc_id, chunk_index, n_words, md5(chunk) AS digest FROM ({windows_sql(128, 12, 2)})""")
def word_windows(spark, root):
    """Windows of 128 words with 12 overlapping."""
    parts = chunking.word_windows(articles(spark, root).select("doc_id", "text"), 128, 12)
    return parts.select("doc_id", "chunk_index", "n_words", F.md5("chunk").alias("digest"))


@query("chunk_function", "K5", f"""SELECT doc_id, chunk_index, n_words, md5(chunk) AS digest FROM ({windows_sql(128, 12, 2)})""")
def chunk_function(spark, root):
    """The same windows by a table function in SQL."""
    chunking.register_chunk(spark)
    return spark.sql("SELECT d.doc_id, c.chunk_index, c.n_words, md5(c.chunk) AS digest FROM {docs} d, LATERAL chunk(d.text, 128, 12) c",
                     docs=articles(spark, root).select("doc_id", "text"))


@query("chunk_size_stats", "C13", " UNION ALL ".join(f"""
SELECT '{name}' AS strategy, round(avg(n_words), 6) AS avg_size, min(n_words) AS min_size, max(n_words) AS max_size,
  round(stddev_samp(n_words), 6) AS std_size FROM ({windows_sql(size, overlap, 2)})"""
    for name, size, overlap in (("w64", 64, 6), ("w128", 128, 12), ("w256", 256, 25))))
def chunk_size_stats(spark, root):
    """Mean, range and deviation of chunk sizes per window size."""
    docs = articles(spark, root).select("doc_id", "text")
    frames = [chunking.word_windows(docs, size, overlap).select(F.lit(name).alias("strategy"), "n_words")
              for name, size, overlap in (("w64", 64, 6), ("w128", 128, 12), ("w256", 256, 25))]
    every = frames[0].unionByName(frames[1]).unionByName(frames[2])
    return every.groupBy("strategy").agg(
        F.round(F.avg("n_words"), 6).alias("avg_size"), F.min("n_words").alias("min_size"),
        F.max("n_words").alias("max_size"), F.round(F.stddev_samp("n_words"), 6).alias("std_size"))


CHUNK_RECORDS = rf"""recs AS (SELECT md5(title || ':' || source || ':' || substr(text, 1, 100)) || '_chunk_' || chunk_index AS chunk_key,
  doc_id, chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks, n_words AS word_count, len(chunk) // 4 AS est_tokens,
  regexp_matches(chunk, '[{fm.MATH_SYMBOLS}]') OR regexp_matches(chunk, '\$([^$\n]+)\$') OR regexp_matches(chunk, '\\(frac|sqrt)') AS has_math
  FROM ({windows_sql(128, 12, 128)}) JOIN (SELECT doc_id, text, source, source || ' ' || doc_id AS title FROM documents) USING (doc_id))"""


def chunk_records(spark, root):
    key = F.md5(F.concat_ws(":", "title", "source", F.substring("text", 1, 100)))
    docs = articles(spark, root).select("doc_id", "text", "source", "lang", key.alias("document_key"), "title")
    parts = chunking.word_windows(docs, 128, 12, min_share=128)
    return parts.select(
        F.concat("document_key", F.lit("_chunk_"), "chunk_index").alias("chunk_key"), "doc_id", "document_key", "title", "source",
        "lang", "chunk_index", "total_chunks", F.col("n_words").alias("word_count"), token_estimate("chunk").alias("est_tokens"),
        fm.has_math(F.col("chunk"), fm.processor_formulas(F.col("chunk"))).alias("has_math"),
        (F.size(fm.code_blocks(F.col("chunk"))) > 0).alias("has_code"), "chunk")


@query("chunk_records", "C14 C16 C17", f"WITH {CHUNK_RECORDS} SELECT * FROM recs")
def chunk_record_query(spark, root):
    """Chunk rows with ids, totals, counts and flags."""
    return chunk_records(spark, root).select(
        "chunk_key", "doc_id", "chunk_index", "total_chunks", "word_count", "est_tokens", "has_math")


@query("document_rollup", "C15 C16", f"""WITH {CHUNK_RECORDS}
SELECT doc_id, count(*) AS n_chunks, sum(word_count)::BIGINT AS total_words, sum(CASE WHEN has_math THEN 1 ELSE 0 END)::BIGINT AS math_chunks
FROM recs GROUP BY doc_id""")
def document_rollup(spark, root):
    """Totals per processed document."""
    return chunk_records(spark, root).groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"), F.sum("word_count").alias("total_words"),
        F.sum(F.col("has_math").cast("long")).alias("math_chunks"))


@query("content_keys", "C17", """
SELECT doc_id, md5(source || ' ' || doc_id || ':' || source || ':' || substr(text, 1, 100)) AS document_key,
  md5(source || ' ' || doc_id || ':' || doc_id) AS article_key, substr(md5(text), 1, 16) AS content_key,
  substr(sha256(text || ':' || '{}'), 1, 16) AS cache_key FROM documents""")
def content_keys(spark, root):
    """Document, article, content and cache keys."""
    a = articles(spark, root)
    return a.select(
        "doc_id", F.md5(F.concat_ws(":", "title", "source", F.substring("text", 1, 100))).alias("document_key"),
        F.md5(F.concat_ws(":", "title", F.col("doc_id").cast("string"))).alias("article_key"),
        F.substring(F.md5("text"), 1, 16).alias("content_key"),
        F.substring(F.sha2(F.concat("text", F.lit(":{}")), 256), 1, 16).alias("cache_key"))


@query("ingest_statistics", "C18 C16", rf"""WITH {MATHY}, f AS (
  SELECT doc_id, {_formula_sql(fm.INGEST_PATTERNS, fm.INGEST_FLAGS)} AS f FROM mathy),
w AS (SELECT doc_id, count(*) AS n FROM ({windows_sql(128, 12, 128, 'mathy')}) GROUP BY 1)
SELECT count(*) AS articles, sum(CASE WHEN len(f) > 0 THEN 1 ELSE 0 END)::BIGINT AS with_math, sum(coalesce(n, 0))::BIGINT AS chunks,
  sum(len(f))::BIGINT AS formulas FROM f LEFT JOIN w USING (doc_id)""")
def ingest_statistics(spark, root):
    """Articles, articles with formulas, chunks and formulas of one ingest, in a single pass."""
    step = 116
    n_words = F.size(words("text"))
    # Windows start every `step` words and all of them are kept.
    kept = F.floor((n_words - 1) / step) + 1
    per_doc = mathy(spark, root).select(
        F.size(fm.ingest_formulas(F.col("text"))).alias("f"), F.when(n_words > 0, kept).otherwise(0).alias("c"))
    return per_doc.agg(F.count("*").alias("articles"), F.sum((F.col("f") > 0).cast("long")).alias("with_math"),
                       F.sum("c").alias("chunks"), F.sum("f").alias("formulas"))


PAGE_TEXT = r"""pt AS (SELECT conv_id AS doc_id, turn AS page_no, regexp_replace(regexp_replace(
  trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+([A-Z])', '\1' || chr(10) || chr(10) || '\2', 'g'),
  '\s*(Chapter \d+|Section \d+|\d+\.\d+)', chr(10) || chr(10) || '\1', 'g') AS t FROM conversations),
po AS (SELECT doc_id, page_no, t, (coalesce(sum(len(t) + 2) OVER (PARTITION BY doc_id ORDER BY page_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start_pos FROM pt WHERE t <> '')"""


def page_texts(spark, root):
    """Page texts rebuilt per (document, page) with running offsets; a conversation is a document, a turn a page."""
    t = F.regexp_replace(squeeze("text"), r"([.!?])\s+([A-Z])", "$1\n\n$2")
    t = F.regexp_replace(t, r"\s*(Chapter \d+|Section \d+|\d+\.\d+)", "\n\n$1")
    pages = table(spark, root, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), t.alias("t")).filter("t <> ''")
    sized = pages.withColumn("_len", F.length("t") + 2).withColumn("_block", F.expr("page_no div 256"))
    placed = running_total(sized, ["doc_id"], "_block", ["page_no"], "_len", "start_pos")
    return placed.select("doc_id", "page_no", "t", "start_pos", (F.col("start_pos") + F.length("t")).alias("end_pos"))


@query("page_offsets", "C19 G12", f"""WITH {PAGE_TEXT}
SELECT doc_id, page_no, start_pos, start_pos + len(t) AS end_pos, md5(t) AS digest FROM po""")
def page_offsets(spark, root):
    """Rebuilt page text and its position in the document."""
    return page_texts(spark, root).select("doc_id", "page_no", "start_pos", "end_pos", F.md5("t").alias("digest"))


@query("word_bags", "C20", rf"""
SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, {sql.WORDS} AS w FROM documents)""")
def word_bags(spark, root):
    """Words and distinct words of every document."""
    bag = articles(spark, root).select("doc_id", tokens("text").alias("w"))
    return bag.select("doc_id", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"))


@query("text_shape", "B10 C6", r"""
SELECT doc_id, len(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(substr(regexp_replace(
  regexp_replace(text, '[\x00-\x09\x0B\x0C\x0E-\x1F]', '', 'g'), '<[^>]+>', '', 'g'), 1, 2000), '^\s+|\s+$', '', 'g') AS t
FROM (SELECT doc_id, replace(text, chr(9), '') || '<b>' || source || '</b>' AS text FROM documents))""")
def text_shape(spark, root):
    """Sanitized text: control characters and tags dropped, cut to 2000 characters, trimmed."""
    from corpusflow.functions.guards import sanitize

    raw = F.concat(F.replace("text", F.lit("\t"), F.lit("")), F.lit("<b>"), F.col("source"), F.lit("</b>"))
    return table(spark, root, "documents").select("doc_id", sanitize(raw, 2000).alias("t")).select(
        "doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


@query("language_volume", "C6", """
SELECT lang, count(*) AS docs, sum(len(text) // 4)::BIGINT AS est_tokens, round(avg(len(text)), 6) AS mean_chars FROM documents GROUP BY lang""")
def language_volume(spark, root):
    """Corpus volume per language."""
    return table(spark, root, "documents").groupBy("lang").agg(
        F.count("*").alias("docs"), F.sum(token_estimate("text")).alias("est_tokens"),
        F.round(F.avg(F.length("text")), 6).alias("mean_chars"))
