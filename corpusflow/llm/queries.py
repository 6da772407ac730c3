"""The registered queries of this package (name -> job) and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import exact, extraction, fingerprints, hardneg, jaccard, licenses, mixing, packing, phrases, quality, setsketch, substrings, toxicity
from corpusflow.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return keep


# DuckDB's lower() changes letters beyond A-Z too, translate() does not
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


WORDS = "regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"


@register()
def op1_license_scan(spark: SparkSession, root: str) -> DataFrame:
    """Licences that the text of every document names."""
    return licenses.scanned(table(spark, root, "documents"))


@register()
def op2_html_extraction(spark: SparkSession, root: str) -> DataFrame:
    """Main text of every page."""
    return extraction.extracted(table(spark, root, "pages"))


@register(f"""
WITH w AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM w, unnest(range(1, len(ws) - 11)) AS u(i)),
f AS (SELECT win, min(doc_id) AS least FROM g GROUP BY 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (win) WHERE least < doc_id),
r AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(array_to_string(list_filter(ws, lambda x, k: NOT list_contains(coalesce(gone, []), k)), ' ')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
""")
def op3_substring_dedup(spark: SparkSession, root: str) -> DataFrame:
    """Every document without the word windows that an earlier one holds."""
    return substrings.deduplicated_substrings(table(spark, root, "documents")).drop("kept")


@register()
def op4_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are."""
    return fingerprints.fingerprints(table(spark, root, "documents"))


@register(f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=LOWERED)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3
        THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) c USING (doc_id)
""")
def op5_ngram_join(spark: SparkSession, root: str) -> DataFrame:
    """Groups of documents whose three-word shingles agree by nine tenths."""
    return jaccard.jaccard_components(table(spark, root, "documents"), shingle=3, numerator=90, denominator=100)


@register()
def op6_quality(spark: SparkSession, root: str) -> DataFrame:
    """Quality score of every document from two co-trained views."""
    return quality.quality(table(spark, root, "documents"), table(spark, root, "labels"))


@register()
def op7_source_mix(spark: SparkSession, root: str) -> DataFrame:
    """Words that a mix of all sources takes of every document."""
    out = mixing.mixed(table(spark, root, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")


@register()
def op8_toxicity(spark: SparkSession, root: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.toxicity(table(spark, root, "documents"), table(spark, root, "labels"))


@register(f"""
WITH d AS (SELECT doc_id, sha256({LOWERED}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
""")
def op9_exact_dedup(spark: SparkSession, root: str) -> DataFrame:
    """The document that stays for every document's text, through a persistent digest index."""
    return exact.deduplicated(table(spark, root, "documents"))


@register()
def op10_sequence_packing(spark: SparkSession, root: str) -> DataFrame:
    """Every piece of every document with the training sequence it goes to."""
    return packing.packed(table(spark, root, "documents"))


@register("""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.anchor_id, p.other AS positive_id, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
""")
def op11_hard_negatives(spark: SparkSession, root: str) -> DataFrame:
    """Hard negatives of every anchor and positive among the embeddings."""
    return hardneg.hard_negatives(table(spark, root, "embeddings"))


@register(f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all({LOWERED}, '[^.,;:!?\\x0A-\\x0D]+')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY 1),
o AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM w, unnest(range(1, 6)) AS u(k), unnest(range(1, len(ws) - k + 2)) AS v(i)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM o GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.k, c.a, cut, x.f AS l, y.f AS r, n, (1000 * c.a * n) // (x.f * y.f) AS score
      FROM c CROSS JOIN unnest(range(1, 5)) AS u(cut) JOIN t USING (lang)
      JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[cut + 1:], ' ') WHERE cut < c.k),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, k, a, phrase, unnest(range(2, k)) AS m, ws FROM c),
g AS (SELECT lang, array_to_string(ws[j:j + m - 1], ' ') AS phrase, max(a) AS most FROM i, unnest(range(1, k - m + 2)) AS v(j) GROUP BY ALL)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM b LEFT JOIN g USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a) WHERE rank <= 2000
""")
def op12_phrase_collocations(spark: SparkSession, root: str) -> DataFrame:
    """Each language's strongest collocations of two to five words."""
    return phrases.collocations(table(spark, root, "documents"))


@register(f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=LOWERED)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5
        THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) c USING (doc_id)
""")
def op13_near_duplicates(spark: SparkSession, root: str) -> DataFrame:
    """Groups of documents whose five-word shingles agree by 85 hundredths, found by banded SetSketch registers."""
    return setsketch.near_duplicates(table(spark, root, "documents"), shingle=5, numerator=85, denominator=100)
