"""Query-text analytics over all user questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import querytext as qt
from corpusflow.plans.registry import query
from corpusflow.plans.sqlparts import TURNS, WORDS
from corpusflow.sources.tables import spread, table, user_turns

FORMS = [("How do I ", "?"), ("What is ", "?"), ("Why does ", " happen"), ("How does ", " work"), ("What are ", "?"),
         ("which ", " is better"), ("Compare the database or API test of ", " and then define $x$"), ("", "? Where? When? `code`")]


def _list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


ASKED = f"""asked AS (SELECT query_id, conv_id, turn, {_list([f[0] for f in FORMS])}[(query_id % 8 + 1)::INT] || text ||
  {_list([f[1] for f in FORMS])}[(query_id % 8 + 1)::INT] AS text FROM ({TURNS}))"""


def asked(spark, root):
    """All user questions, each put into one of eight question forms."""
    pick = lambda i: F.get(F.array(*[F.lit(f[i]) for f in FORMS]), F.pmod("query_id", F.lit(8)).cast("int"))
    return spread(user_turns(spark, root).withColumn("text", F.concat(pick(0), "text", pick(1))))


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(column, phrases):
    return "(" + " OR ".join(f"contains({column}, {q(p)})" for p in phrases) + ")"


def count(column, phrases):
    return "(" + " + ".join(f"contains({column}, {q(p)})::INT" for p in phrases) + ")"


@query("normalized_queries", "Q1", rf"""WITH {ASKED} SELECT query_id,
  regexp_replace(regexp_replace(trim(lower(text)), '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s\-?!.]', '', 'g') AS normalized FROM asked""")
def normalized_queries(spark, root):
    """Normalized text of every question."""
    return asked(spark, root).select("query_id", qt.normalized(F.col("text")).alias("normalized"))


STOPS = "(" + ", ".join(q(w) for w in qt.STOP_WORDS) + ")"


@query("query_keywords", "Q2 F16", rf"""WITH {ASKED},
t AS (SELECT query_id, unnest(w) AS w, unnest(range(len(w))) AS pos FROM (SELECT query_id, {WORDS} AS w FROM asked)),
f AS (SELECT query_id, w, min(pos) AS pos FROM t WHERE len(w) > 2 AND w NOT IN {STOPS} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM f)
SELECT query_id, string_agg(w, ' ' ORDER BY n) AS keywords FROM r WHERE n <= 10 GROUP BY 1""")
def query_keywords(spark, root):
    """First ten distinct keywords of every question."""
    found = asked(spark, root).select("query_id", qt.keywords(F.col("text")).alias("k"))
    return found.filter(F.size("k") > 0).select("query_id", F.array_join("k", " ").alias("keywords"))


INTENT_ROWS = ", ".join(f"({q(n)}, {i}, {q(k)}, {len(k.split())})" for i, (n, ks) in enumerate(qt.INTENT_KEYWORDS.items()) for k in ks)


@query("query_intents", "Q3 Q4", f"""WITH {ASKED},
k(intent, ord, kw, w) AS (VALUES {INTENT_ROWS}),
s AS (SELECT query_id, intent, ord, sum(CASE WHEN contains(lower(text), kw) THEN w + CASE WHEN starts_with(lower(text), kw) THEN 0.5 ELSE 0 END ELSE 0 END)::DOUBLE AS score
  FROM asked, k GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS n, sum(score) OVER (PARTITION BY query_id) AS total FROM s)
SELECT query_id, max(CASE WHEN n = 1 THEN CASE WHEN total > 0 THEN intent ELSE 'informational' END END) AS intent,
  round(max(CASE WHEN n = 1 THEN CASE WHEN total > 0 THEN least(greatest(score / total, 0.3::DOUBLE), 0.9::DOUBLE) ELSE 0.5 END END), 9) AS confidence,
  max(CASE WHEN total > 0 THEN 'keyword-based' ELSE 'default' END) AS method,
  CASE WHEN max(total) > 0 THEN string_agg(CASE WHEN n <= 3 AND score > 0 THEN intent END, ',' ORDER BY n) ELSE 'informational' END AS predictions
FROM r GROUP BY query_id""")
def query_intents(spark, root):
    """Intent, confidence and top predictions of every question."""
    found = qt.intents(asked(spark, root))
    return found.select("query_id", "intent", F.round("confidence", 9).alias("confidence"), "method",
                        F.array_join(F.transform("predictions", lambda p: p["intent"]), ",").alias("predictions"))


def _word(pattern):
    """RE2 spelling with Unicode word ends."""
    edge = r"(?:^|[^\p{L}\p{N}_])"
    if pattern.startswith(r"\b") and pattern.endswith(r"\b"):
        return edge + pattern[2:-2] + r"(?:$|[^\p{L}\p{N}_])"
    return pattern


def match(column, patterns, flag=""):
    return "(" + " OR ".join(f"regexp_matches({column}, {q(flag + _word(p))})" for p in patterns) + ")"


FEATURES = f"""feat AS (SELECT *, {match('text', qt.LATEX_MARKS)} AS has_latex,
  {match('text', qt.CODE_MARKS, '(?i)')} OR {has('low', qt.CODE_WORDS)} AS has_code, {has('low', qt.COMPARATIVE_WORDS)} AS is_comparative,
  {has('low', qt.MULTI_HOP_WORDS)} OR nq > 1 OR {count('low', qt.CONJUNCTIONS)} >= 2 AS is_multi_hop,
  {has('low', qt.STRUCTURED_WORDS)} AS needs_structured_data, len(text) AS query_length, nq AS num_questions,
  regexp_matches(text, '\\d') AS has_numbers,
  round(least(CASE WHEN len(text) > 100 THEN 0.3 WHEN len(text) > 50 THEN 0.1 ELSE 0 END + CASE WHEN nq > 1 THEN 0.3 ELSE 0 END
   + CASE WHEN {has('low', qt.COMPLEX_WORDS)} THEN 0.2 ELSE 0 END + least({count('low', qt.NESTED_WORDS)} * 0.1, 0.2), 1.0)::DOUBLE, 9) AS complexity
  FROM (SELECT *, lower(text) AS low, len(text) - len(replace(text, '?', '')) AS nq FROM asked))""".replace("\\\\d", "\\d")


@query("query_features", "Q5", f"""WITH {ASKED}, {FEATURES}
SELECT query_id, has_latex, has_code, is_comparative, is_multi_hop, needs_structured_data, query_length, num_questions, has_numbers, complexity FROM feat""")
def query_features(spark, root):
    """Routing features of every question."""
    return qt.features(asked(spark, root)).drop("text", "conv_id", "turn").withColumn("complexity", F.round("complexity", 9))


def _rule_score(patterns, phrases):
    parts = [f"CASE WHEN {match('text', [p], '(?i)')} THEN 0.5 ELSE 0 END" for p in patterns]
    parts += [f"CASE WHEN contains(low, {q(p)}) THEN 0.3 ELSE 0 END" for p in phrases]
    return "least((" + " + ".join(parts or ["0"]) + ")::DOUBLE, 1.0::DOUBLE)"


def _rule_rows():
    rows = []
    for i, (name, (patterns, phrases, _)) in enumerate(qt.ROUTES.items()):
        score = _rule_score(patterns, phrases)
        if name in qt.ROUTE_FLOORS:
            flag, floor = qt.ROUTE_FLOORS[name]
            score = f"CASE WHEN {flag} THEN greatest({score}, {floor}::DOUBLE) ELSE {score} END"
        rows.append(f"SELECT query_id, '{name}' AS route, {i} AS ord, round({score}, 9) AS score FROM feat")
    return " UNION ALL ".join(rows)


RULES = f"""rr AS ({_rule_rows()}),
rn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS n FROM rr),
rb AS (SELECT query_id, CASE WHEN score >= 0.5 THEN route ELSE 'standard_rag' END AS rule_route, CASE WHEN score >= 0.5 THEN score ELSE 0.6::DOUBLE END AS rule_confidence
  FROM rn WHERE n = 1)"""


@query("rule_routing", "Q6", f"""WITH {ASKED}, {FEATURES}, {RULES},
alt AS (SELECT rn.*, row_number() OVER (PARTITION BY query_id ORDER BY rn.score DESC, ord) AS m FROM rn JOIN rb USING (query_id) WHERE route <> rule_route)
SELECT query_id, rule_route AS route, round(rule_confidence, 9) AS confidence, string_agg(route, ',' ORDER BY m) AS alternatives
FROM rb JOIN alt USING (query_id) WHERE m <= 3 GROUP BY ALL""")
def rule_routing(spark, root):
    """Route of every question by patterns, keywords and features."""
    routed = qt.route_by_rules(qt.features(asked(spark, root)))
    return routed.select("query_id", F.col("rule_route").alias("route"), F.round("rule_confidence", 9).alias("confidence"),
                         F.array_join(F.transform("rule_alternatives", lambda r: r["name"]), ",").alias("alternatives"))


BUCKET = "((strpos('0123456789abcdef', substr(md5(w), 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(md5(w), 2, 1)) - 1) % 64"
DESCRIPTIONS = ", ".join(f"('{n}', {i}, {q(d)})" for i, (n, (_, _, d)) in enumerate(qt.ROUTES.items()))
MEANING = f"""rd(route, ord, description) AS (VALUES {DESCRIPTIONS}),
rv AS (SELECT route, ord, b, count(*)::DOUBLE AS c FROM (SELECT route, ord, {BUCKET} AS b FROM (
  SELECT route, ord, unnest({WORDS.replace('text', 'description')}) AS w FROM rd)) GROUP BY ALL),
qv AS (SELECT query_id, b, count(*)::DOUBLE AS c FROM (SELECT query_id, {BUCKET} AS b FROM (SELECT query_id, unnest({WORDS}) AS w FROM asked)) GROUP BY ALL),
rl AS (SELECT route, sqrt(sum(c * c)) AS l FROM rv GROUP BY 1), ql AS (SELECT query_id, sqrt(sum(c * c)) AS l FROM qv GROUP BY 1),
sc AS (SELECT a.query_id, r.route, r.ord, round(coalesce(d / (ql.l * rl.l), 0), 9) AS score FROM asked a CROSS JOIN rd r
  LEFT JOIN (SELECT query_id, route, sum(qv.c * rv.c) AS d FROM qv JOIN rv USING (b) GROUP BY ALL) x ON x.query_id = a.query_id AND x.route = r.route
  LEFT JOIN ql ON ql.query_id = a.query_id JOIN rl ON rl.route = r.route),
sn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS n FROM sc),
sb AS (SELECT query_id, route AS semantic_route, score AS semantic_score FROM sn WHERE n = 1)"""


@query("semantic_routing", "Q7", f"""WITH {ASKED}, {MEANING}
SELECT query_id, max(CASE WHEN n = 1 THEN route END) AS route, max(CASE WHEN n = 1 THEN score END) AS score,
  string_agg(CASE WHEN n BETWEEN 2 AND 4 THEN route END, ',' ORDER BY n) AS alternatives FROM sn GROUP BY 1""")
def semantic_routing(spark, root):
    """Route of every question by cosine with the route descriptions."""
    routed = qt.route_by_meaning(asked(spark, root))
    return routed.select("query_id", F.col("semantic_route").alias("route"), F.col("semantic_score").alias("score"),
                         F.array_join(F.transform("semantic_alternatives", lambda r: r["name"]), ",").alias("alternatives"))


@query("hybrid_routing", "Q8 Q9", f"""WITH {ASKED}, {FEATURES}, {RULES}, {MEANING},
h AS (SELECT query_id, CASE WHEN rule_route = semantic_route OR rule_confidence > semantic_score THEN rule_route ELSE semantic_route END AS route,
 CASE WHEN rule_route = semantic_route THEN least((rule_confidence * 0.6::DOUBLE + semantic_score * 0.4::DOUBLE) * 1.2::DOUBLE, 1.0) ELSE greatest(rule_confidence, semantic_score) END AS confidence
 FROM rb JOIN sb USING (query_id)),
o AS (SELECT query_id, CASE WHEN has_latex THEN 'math_formula' ELSE route END AS route, CASE WHEN has_latex THEN 0.95::DOUBLE ELSE confidence END AS confidence FROM h JOIN feat USING (query_id))
SELECT query_id, route, round(confidence, 9) AS confidence, CASE WHEN route = 'math_formula' THEN '10' ELSE '20' END AS top_k_retrieval,
  CASE route WHEN 'math_formula' THEN 5 WHEN 'comparative' THEN 6 WHEN 'multi_hop' THEN 6 WHEN 'code_search' THEN 5 ELSE 3 END::BIGINT AS n_parameters FROM o""")
def hybrid_routing(spark, root):
    """Combined routing with its parameters; questions with formulas go to the formula route."""
    routed = qt.route_both(qt.route_by_meaning(qt.route_by_rules(qt.features(asked(spark, root)))))
    routed = routed.withColumns({
        "route": F.when(F.col("has_latex"), "math_formula").otherwise(F.col("route")),
        "confidence": F.when(F.col("has_latex"), 0.95).otherwise(F.col("confidence"))})
    params = routed.withColumn("p", qt.route_parameters(F.col("route")))
    return params.select("query_id", "route", F.round("confidence", 9).alias("confidence"),
                         F.col("p")["top_k_retrieval"].alias("top_k_retrieval"), F.size("p").alias("n_parameters"))


def _rewrite_case():
    rows = []
    for pattern, group, forms in qt.REWRITES:
        part = f"regexp_extract(low, {q(pattern)}, {group})"
        items = ", ".join(f"{q(f.split('{}')[0])} || {part} || {q(f.split('{}')[1])}" for f in forms)
        rows.append(f"WHEN regexp_matches(low, {q(pattern)}) THEN list_filter([{items}], lambda r: r <> low)")
    return "CASE " + " ".join(rows) + " ELSE [] END"


REFORM = rf"""low AS (SELECT query_id, text, regexp_replace(lower(text), '^\s+|\s+$', '', 'g') AS low FROM asked),
reform AS (SELECT query_id, {_rewrite_case()} AS r FROM low)"""


@query("reformulations", "Q10", f"WITH {ASKED}, {REFORM} SELECT query_id, len(r) AS n, md5(array_to_string(r, chr(30))) AS digest FROM reform")
def reformulations(spark, root):
    """Question rewrites."""
    made = asked(spark, root).select("query_id", qt.reformulations(F.col("text")).alias("r"))
    return made.select("query_id", F.size("r").alias("n"), F.md5(F.array_join("r", "\x1e")).alias("digest"))


def _related():
    items = ", ".join(f"CASE WHEN contains(lower(text), {q(t)}) THEN [lower(text) || ' {r[0]}', lower(text) || ' {r[1]}'] ELSE [] END"
                      for t, r in qt.RELATED_TERMS.items())
    return f"(flatten([{items}]))[1:2]"


RELATED = f"related AS (SELECT query_id, {_related()} AS r FROM asked)"


@query("related_expansions", "Q11", f"WITH {ASKED}, {RELATED} SELECT query_id, len(r) AS n, array_to_string(r, '|') AS expansions FROM related")
def related_expansions(spark, root):
    """Questions with related terms appended."""
    made = asked(spark, root).select("query_id", qt.related_expansions(F.col("text")).alias("r"))
    return made.select("query_id", F.size("r").alias("n"), F.array_join("r", "|").alias("expansions"))


SYNONYMS = rf"""syn AS (SELECT w[1] AS word, item_id AS ord, w[2] AS synonym FROM (SELECT item_id, {WORDS} AS w FROM benchmark) UNION
  SELECT w[4], item_id, w[5] FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE len(w) >= 5),
rs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY ord, synonym) AS sn FROM syn WHERE word <> synonym) WHERE sn <= 2),
iw AS (SELECT query_id, w, min(pos) AS pos FROM (SELECT query_id, unnest(w) AS w, unnest(range(len(w))) AS pos FROM (SELECT query_id, {WORDS} AS w FROM asked))
  WHERE len(w) > 3 AND w NOT IN {STOPS} GROUP BY ALL),
i3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS p FROM iw) WHERE p <= 3),
ex AS (SELECT i3.query_id, p, sn, lower(text) AS low, regexp_replace(lower(text), '(^|[^\p{{L}}\p{{N}}_])' || w || '($|[^\p{{L}}\p{{N}}_])', '\1' || synonym || '\2') AS e
  FROM i3 JOIN rs ON rs.word = i3.w JOIN asked USING (query_id)),
ed AS (SELECT query_id, e, min(p * 10 + sn) AS o FROM ex WHERE e <> low GROUP BY ALL),
en AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o) AS n FROM ed),
syns AS (SELECT query_id, list(e ORDER BY n) AS s FROM en WHERE n <= 2 GROUP BY 1)"""


def synonyms(spark, root):
    """A dictionary read from the benchmark texts: first and fourth word with the word after."""
    from corpusflow.functions.text import tokens

    bag = table(spark, root, "benchmark").select("item_id", tokens("text").alias("w"))
    pair = lambda i: bag.filter(F.size("w") > i).select(F.get("w", F.lit(i - 1)).alias("word"), F.col("item_id").alias("ord"), F.get("w", F.lit(i)).alias("synonym"))
    return pair(1).union(pair(4)).distinct().filter("word <> synonym")


@query("synonym_expansions", "Q12", f"WITH {ASKED}, {SYNONYMS} SELECT query_id, array_to_string(s, '|') AS expansions FROM syns")
def synonym_expansions(spark, root):
    """Questions with a word replaced by a synonym of a given dictionary."""
    made = qt.synonym_expansions(asked(spark, root), synonyms(spark, root))
    return made.select("query_id", F.array_join("expansions", "|").alias("expansions"))


SUBS = r"""subs AS (SELECT query_id, list_concat(CASE WHEN len(a) > 1 THEN list_filter(a, lambda p: len(p) > 3) ELSE [] END,
  CASE WHEN len(b) > 1 THEN list_filter(b, lambda p: len(p) > 3) ELSE [] END)[1:3] AS p FROM (
 SELECT query_id, list_transform(regexp_split_to_array(text, '(?i)\s+and\s+|\s+or\s+'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')) AS a,
  list_transform(list_filter(list_transform(string_split(text, '?'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> ''), lambda p: p || '?') AS b FROM asked))"""


@query("query_decomposition", "Q13", f"WITH {ASKED}, {SUBS} SELECT query_id, len(p) AS n, md5(array_to_string(p, chr(30))) AS digest FROM subs")
def query_decomposition(spark, root):
    """Sub-questions of compound questions."""
    made = asked(spark, root).select("query_id", qt.sub_queries(F.col("text")).alias("p"))
    return made.select("query_id", F.size("p").alias("n"), F.md5(F.array_join("p", "\x1e")).alias("digest"))


@query("query_expansion", "Q14 F14", f"""WITH {ASKED}, {SYNONYMS}, {RELATED}, {REFORM}, {SUBS},
u AS (SELECT query_id, text, list_concat(list_concat(coalesce(s, []), related.r), list_concat(reform.r, subs.p)) AS e FROM asked
  LEFT JOIN syns USING (query_id) JOIN related USING (query_id) JOIN reform USING (query_id) JOIN subs USING (query_id)),
x AS (SELECT query_id, text, unnest(e) AS e, unnest(range(len(e))) AS i FROM u),
y AS (SELECT query_id, min(i) AS i, lower(e) AS l FROM x WHERE lower(e) <> lower(text) GROUP BY ALL),
z AS (SELECT y.query_id, e, row_number() OVER (PARTITION BY y.query_id ORDER BY y.i) AS n FROM y JOIN x ON x.query_id = y.query_id AND x.i = y.i)
SELECT query_id, count(*) AS n, md5(string_agg(e, chr(30) ORDER BY n)) AS digest FROM z WHERE n <= 3 GROUP BY 1""")
def query_expansion(spark, root):
    """All expansions of a question merged, first three kept."""
    base = asked(spark, root)
    syns = qt.synonym_expansions(base, synonyms(spark, root))
    t = F.col("text")
    merged = base.join(syns, "query_id", "left").select("query_id", qt.merge_expansions(
        t, F.coalesce("expansions", F.array().cast("array<string>")), qt.related_expansions(t), qt.reformulations(t), qt.sub_queries(t)).alias("e"))
    return merged.filter(F.size("e") > 0).select("query_id", F.size("e").alias("n"), F.md5(F.array_join("e", "\x1e")).alias("digest"))


DOMAINS = ["biomedical", "scientific", "financial", "argumentative", "general"]


def hypotheticals(spark, root):
    """Assistant turns as hypothetical answers to the user turn before them."""
    turns = table(spark, root, "conversations")
    user = turns.filter("role = 'user'").select("conv_id", F.col("turn").alias("u"), F.col("text").alias("query_text"))
    reply = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("u"), F.col("text").alias("answer"), "turn")
    domain = F.get(F.array(*[F.lit(d) for d in DOMAINS]), F.pmod("conv_id", F.lit(5)).cast("int"))
    pairs = user.join(reply, ["conv_id", "u"])
    return pairs.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("hypo_id"), "query_text",
                        F.concat("answer", F.lit(" however the study rate"), F.repeat(F.lit(" because"), (F.col("turn") % 4).cast("int"))).alias("answer"),
                        domain.alias("domain"))


def _signs():
    return "CASE domain " + " ".join(f"WHEN '{n}' THEN {count('low', s)}::DOUBLE / {len(s)}" for n, s in qt.DOMAIN_SIGNS.items()) + " END"


QUALITY = rf"""hy AS (SELECT u.conv_id AS query_id, a.turn AS hypo_id, u.text AS query_text, lower(a.text || ' however the study rate' || repeat(' because', (a.turn % 4)::INT)) AS low,
  {_list(DOMAINS)}[(u.conv_id % 5 + 1)::INT] AS domain FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
hw AS (SELECT *, list_filter(regexp_split_to_array(low, '\s+'), lambda w: w <> '') AS bag,
  list_distinct(list_filter(regexp_split_to_array(lower(query_text), '\s+'), lambda w: w <> '')) AS ask, {count('low', qt.GENERIC_PHRASES)} AS generic, {_signs()} AS ratio FROM hy),
hq AS (SELECT query_id, hypo_id, round((CASE WHEN len(bag) < 10 THEN 0.15 WHEN len(bag) < 20 THEN 0.5 ELSE 1 END)::DOUBLE
  * (CASE WHEN len(list_distinct(bag)) < 0.4 * len(bag) THEN 0.24 WHEN len(list_distinct(bag)) < 0.6 * len(bag) THEN 0.6 ELSE 1 END)::DOUBLE
  * (CASE WHEN generic > 5 THEN 0.35 WHEN generic > 3 THEN 0.7 ELSE 1 END)::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * least(ratio * 3, 1.0::DOUBLE))
  * (CASE WHEN len(ask) = 0 THEN 1 WHEN ov > 0.8 THEN 0.5 WHEN ov < 0.1 THEN 0.6 ELSE 1 END)::DOUBLE, 9) AS quality
 FROM (SELECT *, len(list_intersect(ask, list_distinct(bag)))::DOUBLE / len(ask) AS ov FROM hw))"""


def scored_hypotheticals(spark, root):
    pairs = spread(hypotheticals(spark, root))
    return pairs.select("query_id", "hypo_id", F.round(qt.hypothetical_quality(
        F.col("query_text"), F.col("answer"), F.col("domain")), 9).alias("quality"))


@query("hypothetical_quality", "Q24", f"WITH {QUALITY} SELECT * FROM hq")
def hypothetical_quality(spark, root):
    """Quality score of every hypothetical answer."""
    return scored_hypotheticals(spark, root)


@query("hypothetical_selection", "Q25", f"""WITH {QUALITY},
p AS (SELECT *, max(CASE WHEN quality >= 0.7 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS anyp FROM hq)
SELECT * FROM (SELECT query_id, hypo_id, quality, row_number() OVER (PARTITION BY query_id ORDER BY quality DESC, hypo_id) AS rank
  FROM p WHERE quality >= 0.7 OR anyp = 0) WHERE rank <= 3""")
def hypothetical_selection(spark, root):
    """Three best answers per conversation that pass the threshold, or of all if none does."""
    return qt.select_hypotheticals(scored_hypotheticals(spark, root), 3)


@query("latex_presence", "Q26", r"""
SELECT doc_id, regexp_matches(text, '\$.*?\$') OR regexp_matches(text, '\\\[.*?\\\]') OR regexp_matches(text, '\\begin\{equation\}')
  OR regexp_matches(text, '\\frac\{|\\sum|\\int|\\alpha|\\beta|\\gamma') AS has_latex FROM documents""")
def latex_presence(spark, root):
    """Whether a document contains LaTeX."""
    from corpusflow.operators.formulas import DOCUMENT_MARKS
    from corpusflow.functions.text import any_match

    return table(spark, root, "documents").select("doc_id", any_match(F.col("text"), DOCUMENT_MARKS).alias("has_latex"))
