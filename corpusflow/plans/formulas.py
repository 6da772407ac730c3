"""Formula questions: analysis, construction of queries and filters, formula-aware re-ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import formulas as fq
from corpusflow.operators import sparse
from corpusflow.operators.ranking import best_hits, stable
from corpusflow.plans import sqlparts as sql
from corpusflow.plans.querytext import _list, has, q
from corpusflow.plans.registry import query
from corpusflow.session import materialize
from corpusflow.sources.tables import spread, table

# Question heads by document id; they carry formulas made of the document's own numbers.
HEADS = ["Solve $x^2 + {} = 0$ ", r"Integrate \[\int {} dt\] ", r"Differentiate $\frac{{d}}{{dy}} y/{}$ ",
         r"Simplify $\sqrt{{a}} \cdot {}$ and $b + {}$ ", r"Prove $\alpha \times \beta$ for {} ", "What is number {}? ",
         r"Compare $\sum k - {}$ with $\lim z$ ", r"\begin{{align}}m = {}\end{{align}} "]


def _head_sql():
    parts = []
    for head in HEADS:
        pieces = head.replace("{{", "\x01").replace("}}", "\x02").split("{}")
        pieces = [q(p.replace("\x01", "{").replace("\x02", "}")) for p in pieces]
        parts.append(" || doc_id || ".join(pieces))
    return f"[{', '.join(parts)}][(doc_id % 8 + 1)::INT]"


MATHQ = f"mathq AS (SELECT doc_id AS query_id, {_head_sql()} || text AS text FROM documents)"


def math_questions(spark, root):
    """Every document as a question with a formula head."""
    parts = []
    for head in HEADS:
        pieces = head.replace("{{", "\x01").replace("}}", "\x02").split("{}")
        columns = [F.lit(pieces[0].replace("\x01", "{").replace("\x02", "}"))]
        for piece in pieces[1:]:
            columns += [F.col("doc_id").cast("string"), F.lit(piece.replace("\x01", "{").replace("\x02", "}"))]
        parts.append(F.concat(*columns))
    head = F.get(F.array(*parts), F.pmod("doc_id", F.lit(len(HEADS))).cast("int"))
    return spread(table(spark, root, "documents").select(F.col("doc_id").alias("query_id"), F.concat(head, "text").alias("text")))


def _formulas_sql(column="text"):
    items = ", ".join(f"regexp_extract_all({column}, {q(p)}, 1)" for p in fq.DELIMITERS)
    return f"flatten([{items}])"


def _class_sql(f="f"):
    rows = []
    for name, patterns in fq.FORMULA_CLASSES.items():
        test = " OR ".join(f"regexp_matches({f}, {q(p)})" for p in patterns)
        rows.append(f"WHEN {test} THEN '{name}'")
    return "CASE " + " ".join(rows) + " ELSE 'general' END"


def _vars_sql(f="f"):
    doubled = f"regexp_replace({f}, '([^a-zA-Z])', '\\1\\1', 'g')"
    single = f"regexp_extract_all({doubled}, '(?:^|[^\\\\a-zA-Z])([a-z])(?:[^a-zA-Z]|$)', 1)"
    return f"list_sort(list_distinct(list_concat({single}, regexp_extract_all({f}, {q(fq.GREEK)}, 1))))"


def _ops_sql(f="f"):
    items = ", ".join(f"CASE WHEN regexp_matches({f}, {q(p)}) THEN {q(n)} END" for p, n in fq.OPERATORS.items())
    return f"list_sort(list_filter([{items}], lambda o: o IS NOT NULL))"


def _without_sql(column="text"):
    out = column
    for p in fq.DELIMITERS:
        out = f"regexp_replace({out}, {q(p)}, ' [FORMULA] ', 'g')"
    return f"trim(replace(trim(regexp_replace({out}, '\\s+', ' ', 'g')), '[FORMULA]', ''))"


def _type_sql():
    rows = [f"WHEN NOT has_latex THEN 'general'",
            f"WHEN {has('low', fq.QUESTION_WORDS['solve'])} THEN CASE WHEN list_contains(kinds, 'equation') THEN 'solve_equation' ELSE 'evaluate' END"]
    rows += [f"WHEN {has('low', fq.QUESTION_WORDS[n])} THEN '{n}'" for n in ("simplify", "integrate", "differentiate", "prove")]
    rows += ["WHEN list_contains(kinds, 'equation') THEN 'solve_equation'", "WHEN list_contains(kinds, 'integral') THEN 'integrate'",
             "WHEN list_contains(kinds, 'derivative') THEN 'differentiate'"]
    return "CASE " + " ".join(rows) + " ELSE 'formula_query' END"


# One row per formula in order of first occurrence, then everything a question needs.
ANALYSIS = rf"""{MATHQ},
ff AS (SELECT query_id, unnest(fs) AS f, unnest(range(len(fs))) AS pos FROM (SELECT query_id, {_formulas_sql()} AS fs FROM mathq)),
fd AS (SELECT query_id, f, min(pos) AS pos FROM ff GROUP BY ALL),
fa AS (SELECT query_id, f, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n, {_class_sql()} AS kind, {_vars_sql()} AS vs, {_ops_sql()} AS os FROM fd),
fl AS (SELECT query_id, list(f ORDER BY n) AS formulas, list(kind ORDER BY n) AS kinds, list_sort(list_distinct(flatten(list(vs)))) AS vars,
  list_sort(list_distinct(flatten(list(os)))) AS ops FROM fa GROUP BY 1),
an0 AS (SELECT query_id, text, coalesce(formulas, []) AS formulas, coalesce(kinds, []) AS kinds, coalesce(vars, []) AS vars, coalesce(ops, []) AS ops,
  formulas IS NOT NULL AS has_latex, CASE WHEN formulas IS NOT NULL THEN {_without_sql()} ELSE text END AS t FROM mathq LEFT JOIN fl USING (query_id)),
an AS (SELECT *, {_type_sql()} AS query_type FROM (SELECT *, lower(t) AS low FROM an0))"""


def analyzed(spark, root):
    return fq.analyze(math_questions(spark, root))


@query("formula_detection", "Q15", f"WITH {ANALYSIS} SELECT query_id, len(formulas) AS n, md5(array_to_string(formulas, chr(30))) AS digest FROM an")
def formula_detection(spark, root):
    """Formulas of every question."""
    found = math_questions(spark, root).select("query_id", fq.detect(F.col("text")).alias("f"))
    return found.select("query_id", F.size("f").alias("n"), F.md5(F.array_join("f", "\x1e")).alias("digest"))


@query("formula_classes", "Q16", f"WITH {ANALYSIS} SELECT kind, count(*) AS formulas, count(DISTINCT query_id) AS questions FROM fa GROUP BY kind")
def formula_classes(spark, root):
    """How many formulas and questions fall into each class."""
    flat = math_questions(spark, root).select("query_id", F.explode(fq.detect(F.col("text"))).alias("f"))
    return flat.groupBy(fq.formula_class(F.col("f")).alias("kind")).agg(
        F.count("*").alias("formulas"), F.count_distinct("query_id").alias("questions"))


@query("formula_symbols", "Q17", f"""WITH {ANALYSIS}
SELECT query_id, n AS pos, kind, array_to_string(vs, ' ') AS variables, array_to_string(os, ' ') AS operators FROM fa""")
def formula_symbols(spark, root):
    """Variables and operators of every formula."""
    flat = math_questions(spark, root).select("query_id", F.posexplode(fq.detect(F.col("text"))).alias("pos", "f"))
    f = F.col("f")
    return flat.select("query_id", (F.col("pos") + 1).alias("pos"), fq.formula_class(f).alias("kind"),
                       F.array_join(fq.variables(f), " ").alias("variables"), F.array_join(fq.operators(f), " ").alias("operators"))


@query("formula_free_text", "Q18", f"WITH {ANALYSIS} SELECT query_id, has_latex, md5(t) AS digest, len(t) AS n_chars FROM an")
def formula_free_text(spark, root):
    """Question text without its formulas."""
    return analyzed(spark, root).select("query_id", "has_latex", F.md5("text_query").alias("digest"), F.length("text_query").alias("n_chars"))


@query("math_question_types", "Q19", f"WITH {ANALYSIS} SELECT query_id, query_type, len(formulas) AS n FROM an")
def math_question_types(spark, root):
    """Kind of every math question."""
    return analyzed(spark, root).select("query_id", "query_type", F.size("formulas").alias("n"))


SEARCH = r"""sq AS (SELECT query_id, list_filter(list_transform(list_concat(list_concat([t],
   CASE WHEN has_latex THEN [t || ' ' || array_to_string(kinds, ' ')] ELSE [] END), list_concat(list_concat(
   CASE WHEN len(vars) > 0 THEN [t || ' variables: ' || v] ELSE [] END,
   CASE query_type WHEN 'solve_equation' THEN ['solving equations ' || t, 'how to solve ' || v || ' equation'] WHEN 'integrate' THEN ['integration ' || t, 'integral calculus ' || v]
     WHEN 'differentiate' THEN ['differentiation ' || t, 'derivative ' || v] WHEN 'simplify' THEN ['simplification ' || t, 'algebraic simplification'] ELSE [] END), formulas)),
   lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS s FROM (SELECT *, array_to_string(vars, ' ') AS v FROM an)),
su AS (SELECT query_id, s, min(i) AS i FROM (SELECT query_id, unnest(s) AS s, unnest(range(len(s))) AS i FROM sq) GROUP BY ALL),
sn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i) AS n FROM su)"""


@query("formula_search_queries", "Q20", f"WITH {ANALYSIS}, {SEARCH} SELECT query_id, n AS pos, md5(s) AS digest FROM sn WHERE n <= 10")
def formula_search_queries(spark, root):
    """Search queries generated for every question, in order."""
    made = analyzed(spark, root).select("query_id", F.posexplode(fq.search_queries()).alias("pos", "s"))
    return made.select("query_id", (F.col("pos") + 1).alias("pos"), F.md5("s").alias("digest"))


CONSTRUCTED = """cq AS (SELECT *, CASE WHEN has_latex THEN CASE query_type WHEN 'general' THEN 'dense_vector' WHEN 'prove' THEN 'hybrid' ELSE 'formula_aware' END
   WHEN contains(low, 'compare') OR contains(low, 'difference') OR contains(low, 'vs') THEN 'hybrid' ELSE 'dense_vector' END AS strategy,
  CASE WHEN has_latex THEN trim(array_to_string(list_filter([nullif(t, ''), CASE WHEN NOT list_contains(kinds, 'general') THEN '(' || array_to_string(list_sort(list_distinct(kinds)), ', ') || ')' END,
    CASE WHEN len(vars) > 0 THEN 'variables: ' || array_to_string(vars[1:3], ', ') END], lambda p: p IS NOT NULL), ' ')) ELSE t END AS primary_query,
  list_filter(kinds, lambda k: k <> 'general') AS kk,
  CASE WHEN has_latex THEN round(least(0.8::DOUBLE, 0.3::DOUBLE + 0.5::DOUBLE * len(formulas)::DOUBLE / greatest(len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')), 1)), 9) END AS formula_weight,
  len(formulas) * 2 + len(vars) + len(ops) AS cx FROM an),
ce AS (SELECT query_id, CASE WHEN NOT has_latex THEN ['What is ' || t || '?', 'Explain ' || t, 'Information about ' || t, t || ' definition and examples'] ELSE
  list_concat(list_concat(CASE WHEN len(kk) > 0 THEN [kk[1] || ' ' || t] ELSE [] END, CASE WHEN query_type IN ('solve_equation', 'evaluate') THEN ['how to solve ' || t, 'step by step solution for ' || t] ELSE [] END),
  list_concat(['theory and explanation of ' || t, 'examples of ' || t], CASE WHEN len(vars) > 0 THEN [t || ' involving ' || array_to_string(vars[1:3], ' ')] ELSE [] END)) END AS e, text FROM cq),
cu AS (SELECT query_id, trim(lower(e)) AS k, min(i) AS i FROM (SELECT query_id, text, unnest(e) AS e, unnest(range(len(e))) AS i FROM ce) WHERE trim(lower(e)) <> lower(text) GROUP BY ALL),
cn AS (SELECT query_id, least(count(*), 5) AS n_expansions FROM cu GROUP BY 1)""".replace("\\\\s", "\\s")


@query("constructed_queries", "Q21", f"""WITH {ANALYSIS}, {CONSTRUCTED}
SELECT query_id, strategy, md5(primary_query) AS primary_digest, n_expansions, coalesce(formula_weight, 0) AS formula_weight FROM cq JOIN cn USING (query_id)""")
def constructed_queries(spark, root):
    """Strategy, primary query, expansions and formula weight of every question."""
    a = analyzed(spark, root)
    return a.select("query_id", fq.strategy().alias("strategy"), F.md5(fq.primary_query()).alias("primary_digest"),
                    F.size(fq.expansion_queries()).alias("n_expansions"), F.coalesce(F.round(fq.formula_weight(), 9), F.lit(0.0)).alias("formula_weight"))


@query("formula_filters", "B5", f"""WITH {ANALYSIS}, {CONSTRUCTED}
SELECT query_id, query_type, CASE WHEN cx <= 3 THEN 'simple' WHEN cx <= 7 THEN 'moderate' ELSE 'complex' END AS complexity, len(kk) AS n_kinds, len(vars) AS n_vars
FROM cq WHERE list_has_any(kinds, ['equation', 'derivative']) AND list_has_any(vars, ['x', 'y', 'm']) AND cx > 3 AND cx <= 7""")
def formula_filters(spark, root):
    """Questions selected by formula class, variables and complexity."""
    a = fq.formula_filter(analyzed(spark, root), kinds=["equation", "derivative"], variables=["x", "y", "m"], level="moderate")
    return a.select("query_id", "query_type", fq.complexity().alias("complexity"), F.size(fq.specific_kinds()).alias("n_kinds"), F.size("vars").alias("n_vars"))


@query("formula_companions", "Q23", f"""WITH {ANALYSIS}
SELECT query_id, n AS pos, 'similar' AS kind, md5(array_to_string(list_concat(list_concat(CASE WHEN kind <> 'general' THEN [kind] ELSE [] END,
  CASE WHEN len(vs) > 0 AND len(os) > 0 THEN [array_to_string(vs, ' ') || ' with ' || array_to_string(os[1:3], ' ')] ELSE [] END), [f]), chr(30))) AS digest FROM fa
UNION ALL SELECT query_id, n, 'explain', md5(array_to_string(list_concat(CASE WHEN kind <> 'general' THEN ['what is ' || kind, 'explain ' || kind] ELSE [] END,
  CASE WHEN len(vs) > 0 THEN ['how to work with ' || array_to_string(vs[1:2], ' ')] ELSE [] END), chr(30))) FROM fa""")
def formula_companions(spark, root):
    """Similar-formula and explanation queries of every formula."""
    flat = math_questions(spark, root).select("query_id", F.posexplode(fq.detect(F.col("text"))).alias("pos", "f"))
    f = F.col("f")
    rows = F.array(F.struct(F.lit("similar").alias("kind"), fq.similar_queries(f).alias("q")), F.struct(F.lit("explain").alias("kind"), fq.explanation_queries(f).alias("q")))
    return flat.select("query_id", (F.col("pos") + 1).alias("pos"), F.inline(rows)).select(
        "query_id", "pos", "kind", F.md5(F.array_join("q", "\x1e")).alias("digest"))


@query("formula_rerank", "E19", f"""WITH {sql.bm25()}, {ANALYSIS}, {CONSTRUCTED},
base AS ({sql.ranked('scores', 50)}),
bq AS (SELECT base.query_id, base.doc_id, score, qa.formulas AS qf, qa.vars AS qv, coalesce(qa.formula_weight, 0) AS w, da.formulas AS df, da.vars AS dv
  FROM base JOIN cq qa ON qa.query_id = base.query_id JOIN cq da ON da.query_id = base.doc_id),
r AS (SELECT query_id, doc_id, round((1 - w) * score + w * (
  CASE WHEN len(qf) > 0 THEN len(list_intersect(qf, df))::DOUBLE / len(qf) ELSE 0 END + CASE WHEN len(qv) > 0 THEN len(list_intersect(qv, dv))::DOUBLE / len(qv) ELSE 0 END) / 2, 9) AS score FROM bq)
{sql.ranked('r', 10)}""")
def formula_rerank(spark, root):
    """BM25 candidates re-ranked by agreement of formulas and variables with the question."""
    docs = table(spark, root, "documents").select("doc_id", "text")
    queries = table(spark, root, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    base = sparse.bm25_topk(queries, docs, 50).drop("rank")
    a = materialize(analyzed(spark, root).select("query_id", "formulas", "vars", stable(fq.formula_weight()).alias("formula_weight")), "formulas")
    doc_side = a.select(F.col("query_id").alias("doc_id"), F.col("formulas").alias("doc_formulas"), F.col("vars").alias("doc_vars"))
    scored = fq.formula_rerank(base.join(a, "query_id").join(doc_side, "doc_id"))
    return best_hits(scored.select("query_id", "doc_id", stable(F.col("score")).alias("score")), 10)
