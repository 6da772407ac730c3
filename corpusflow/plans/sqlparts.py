"""Oracle SQL fragments shared by several checks (DuckDB dialect)."""

from __future__ import annotations

WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"

BENCH = "SELECT item_id AS query_id, text FROM benchmark"
TURNS = "SELECT conv_id * 1000 + turn AS query_id, conv_id, turn, text FROM conversations WHERE role = 'user'"


def bm25(queries: str = BENCH, docs: str = "SELECT doc_id, text FROM documents", tag: str = "") -> str:
    """CTE list ending in scores{tag}(query_id, doc_id, score)."""
    return f"""
q{tag} AS ({queries}),
d{tag} AS ({docs}),
dt{tag} AS (SELECT doc_id, unnest({WORDS}) AS term FROM d{tag}),
dl{tag} AS (SELECT doc_id, len({WORDS}) AS doc_len FROM d{tag}),
cs{tag} AS (SELECT count(*) AS n, avg(doc_len) AS avg_len FROM dl{tag}),
tf{tag} AS (SELECT term, doc_id, count(*) AS tf FROM dt{tag} GROUP BY ALL),
df{tag} AS (SELECT term, count(*) AS df FROM tf{tag} GROUP BY term),
qt{tag} AS (SELECT query_id, term, count(*) AS qtf FROM
  (SELECT query_id, unnest({WORDS}) AS term FROM q{tag}) GROUP BY ALL),
scores{tag} AS (
  SELECT query_id, doc_id, score FROM (
    SELECT query_id, tf{tag}.doc_id, round(sum(
      qtf * greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1), 0.25::DOUBLE)
      * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avg_len))), 9) AS score
    FROM qt{tag} JOIN tf{tag} USING (term) JOIN df{tag} USING (term)
    JOIN dl{tag} ON dl{tag}.doc_id = tf{tag}.doc_id, cs{tag}
    GROUP BY ALL) WHERE score > 0)"""


def ranked(source: str, k: int, extra: str = "") -> str:
    """Top-k per query by score, then id."""
    return (f"SELECT * FROM (SELECT query_id, doc_id, score{extra}, row_number() OVER "
            f"(PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {source}) WHERE rank <= {k}")


QRELS = """qrels AS (SELECT item_id AS query_id, doc_id, 1 AS rel
  FROM benchmark, documents WHERE contains(documents.text, benchmark.text))"""


def cosine(left: str, right: str) -> str:
    return (f"list_inner_product({left}::DOUBLE[], {right}::DOUBLE[]) / "
            f"(sqrt(list_inner_product({left}::DOUBLE[], {left}::DOUBLE[])) * "
            f"sqrt(list_inner_product({right}::DOUBLE[], {right}::DOUBLE[])))")


def dense_run(k: int, tag: str = "", vec: str = "embedding") -> str:
    """Every embedding searched against all others."""
    source = f"""(SELECT a.vec_id AS query_id, b.vec_id AS doc_id,
      round({cosine('a.' + vec, 'b.' + vec)}, 9) AS score
      FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)"""
    return ranked(source, k)


LABEL_QRELS = """qrels AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, 1 AS rel
  FROM embeddings a, embeddings b WHERE a.label = b.label AND a.vec_id <> b.vec_id)"""

CUTOFFS = (1, 3, 5, 10, 20, 100)


def metrics(run: str, qrels: str = "qrels", cutoffs=CUTOFFS, per_query: bool = False) -> str:
    """CTE list computing perq(query_id, mrr, k, ndcg, map, recall, precision) from run and qrels."""
    ks = ", ".join(f"({k})" for k in cutoffs)
    return f"""
ks AS (SELECT * FROM (VALUES {ks}) v(k)),
judged AS (SELECT query_id, count(*) AS n_judged FROM {qrels} WHERE rel > 0 GROUP BY 1),
ideal AS (SELECT query_id, k, sum((2.0::DOUBLE ^ rel - 1) / log2(pos + 1)) AS idcg FROM (
    SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC) AS pos
    FROM {qrels} WHERE rel > 0), ks WHERE pos <= k GROUP BY ALL),
hits AS (SELECT query_id, doc_id, rank, coalesce(rel, 0) AS rel,
    sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS so_far
    FROM {run} LEFT JOIN {qrels} USING (query_id, doc_id)),
perk AS (SELECT query_id, k,
    sum(CASE WHEN rel > 0 THEN (2.0::DOUBLE ^ rel - 1) / log2(rank + 1) ELSE 0 END) AS dcg,
    sum(CASE WHEN rel > 0 THEN so_far::DOUBLE / rank ELSE 0 END) AS ap,
    sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) AS hit, count(*) AS seen
    FROM hits, ks WHERE rank <= k GROUP BY ALL),
first_hit AS (SELECT query_id, min(rank) AS r FROM hits WHERE rel > 0 GROUP BY 1),
perq AS (SELECT judged.query_id, ks.k, coalesce(1.0::DOUBLE / r, 0) AS mrr,
    coalesce(dcg / idcg, 0) AS ndcg, coalesce(ap / n_judged, 0) AS map,
    coalesce(hit::DOUBLE / n_judged, 0) AS recall, coalesce(hit::DOUBLE / seen, 0) AS precision
    FROM judged CROSS JOIN ks LEFT JOIN perk ON perk.query_id = judged.query_id AND perk.k = ks.k
    LEFT JOIN ideal ON ideal.query_id = judged.query_id AND ideal.k = ks.k
    LEFT JOIN first_hit ON first_hit.query_id = judged.query_id)"""


LONG = """SELECT metric || '@' || k AS metric, round(avg(value), 9) AS value FROM (
  SELECT k, 'ndcg' AS metric, ndcg AS value FROM perq UNION ALL SELECT k, 'map', map FROM perq
  UNION ALL SELECT k, 'recall', recall FROM perq UNION ALL SELECT k, 'precision', precision FROM perq)
  GROUP BY metric, k UNION ALL SELECT 'mrr', round(avg(mrr), 9) FROM perq WHERE k = 1"""
