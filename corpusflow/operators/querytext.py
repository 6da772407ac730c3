"""Query-text analytics as projections: every rule table is small and lives in the expression."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusflow.functions.text import any_match, any_of, count_of, tokens, words

# Intent keywords; earlier intents win ties.
INTENT_KEYWORDS = {
    "informational": ["what", "who", "when", "where", "which", "is", "are", "does", "tell me", "information",
                      "about", "explain", "describe"],
    "procedural": ["how", "guide", "tutorial", "steps", "process", "way to", "instructions", "method",
                   "procedure", "demonstrate"],
    "causal": ["why", "reason", "cause", "because", "explanation", "purpose", "motivation", "rationale",
               "why does", "why is"],
    "comparative": ["compare", "difference", "versus", "vs", "better", "best", "contrast", "alternative", "or",
                    "which is", "either"],
    "recommendation": ["recommend", "suggest", "should", "advice", "best", "good", "prefer", "choose",
                       "selection", "opinion", "what would"],
    "navigational": ["find", "locate", "where is", "link to", "navigate", "go to", "access", "reach", "page",
                     "search for specific"],
    "transactional": ["buy", "purchase", "order", "download", "install", "create", "register", "sign up",
                      "submit", "apply"],
    "definitional": ["define", "definition", "meaning", "what is", "what are", "means", "refers to",
                     "terminology", "term"],
}
DEFAULT_INTENT, DEFAULT_CONFIDENCE = "informational", 0.5
CONFIDENCE_RANGE = (0.3, 0.9)

# Query features.
LATEX_MARKS = [r"\$.*?\$", r"\\\[.*?\\\]", r"\\frac", r"\\int", r"\\sum", r"\\alpha|\\beta|\\gamma"]
CODE_MARKS = [r"\bdef\b", r"\bclass\b", r"\bimport\b", r"\bfunction\b", r"=>", r"\{\s*\}", r"```"]
CODE_WORDS = ["code", "implement", "function", "algorithm", "syntax"]
COMPARATIVE_WORDS = ["compare", "difference", "versus", "vs", "better", "contrast", "comparison"]
MULTI_HOP_WORDS = ["and then", "after that", "followed by", "stages", "steps", "process", "how does", "explain how"]
CONJUNCTIONS = [" and ", " or ", " but ", " also "]
STRUCTURED_WORDS = ["filter", "where", "between", "before", "after", "from year", "published in", "author", "type"]
COMPLEX_WORDS = ["moreover", "furthermore", "consequently", "specifically"]
NESTED_WORDS = [" which ", " that ", " where ", " when "]

# Routes in tie order with their patterns, keywords and descriptions.
ROUTES = {
    "math_formula": ([r"\$.*?\$", r"\\frac", r"\\int"],
                     ["solve", "equation", "formula", "calculate", "integral", "derivative"],
                     "Mathematical formulas and equations"),
    "code_search": ([r"\bdef\b", r"\bclass\b", r"```"],
                    ["code", "implement", "function", "algorithm", "syntax"], "Code and programming queries"),
    "comparative": ([r"\bvs\b", r"\bversus\b"], ["compare", "difference", "versus", "vs", "better"],
                    "Comparison and contrast queries"),
    "multi_hop": ([], ["steps", "process", "stages", "how does", "explain"], "Complex multi-step reasoning"),
    "structured_data": ([], ["filter", "where", "from year", "published", "author"],
                        "Structured data queries with filters"),
    "factual_qa": ([], ["what is", "who is", "when did", "define"], "Simple factual questions"),
    "standard_rag": ([], [], "Standard RAG pipeline (default)"),
}
ROUTE_FLOORS = {"math_formula": ("has_latex", 0.9), "code_search": ("has_code", 0.85),
                "comparative": ("is_comparative", 0.8), "multi_hop": ("is_multi_hop", 0.75)}
ROUTE_PARAMETERS = {
    "math_formula": {"parse_latex": "true", "symbolic_solver": "true", "top_k_retrieval": "10"},
    "comparative": {"multi_query": "true", "num_variations": "3", "enable_fusion": "true"},
    "multi_hop": {"decompose_query": "true", "max_hops": "3", "enable_synthesis": "true"},
    "code_search": {"code_embeddings": "true", "syntax_parse": "true"},
}
DEFAULT_PARAMETERS = {"top_k_retrieval": "20", "top_k_final": "10", "enable_reranking": "true"}

# Question forms and the rewrites made from their last group.
REWRITES = [
    (r"how (do|can|should) i (.+)", 2, ["how to {}", "{} tutorial", "{} guide"]),
    (r"what is (.+)", 1, ["{} definition", "{} meaning", "define {}"]),
    (r"why does (.+)", 1, ["{} reason", "{} explanation", "cause of {}"]),
    (r"how does (.+) work", 1, ["{} mechanism", "{} explanation", "{} process"]),
    (r"what are (.+)", 1, ["{} list", "{} examples", "types of {}"]),
    (r"which (.+) is better", 1, ["{} comparison", "best {}", "compare {}"]),
]

# Related technical terms; the first two of a term are used.
RELATED_TERMS = {
    "authentication": ["auth", "login", "security", "credentials"],
    "database": ["db", "storage", "persistence", "data store"],
    "api": ["endpoint", "rest", "graphql", "interface"],
    "framework": ["library", "toolkit", "package"],
    "error": ["exception", "bug", "issue", "problem"],
    "performance": ["optimization", "speed", "efficiency"],
    "deploy": ["deployment", "release", "production"],
    "test": ["testing", "unit test", "integration test"],
}

# Stop words of the keyword rule; a table may be given instead.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or",
              "that", "the", "this", "to", "was", "what", "which", "with"]

MAX_KEYWORDS = 10
MIN_QUERY_CHARS = 3
MAX_EXPANSIONS = 3
EMBED_DIM = 64

# Signs of a good or generic hypothetical answer.
GENERIC_PHRASES = ["important aspects", "relevant details", "key considerations", "various factors",
                   "multiple perspectives", "several aspects", "encompasses", "involves", "includes", "regarding",
                   "with respect to", "in terms of", "can be described", "it is important to note", "worth noting",
                   "should be considered"]
DOMAIN_SIGNS = {
    "biomedical": ["study", "studies", "patient", "patients", "treatment", "clinical", "medical", "disease", "symptom",
                   "symptoms", "drug", "medication", "therapy", "diagnosis", "condition", "%", "mg", "ml", "dose"],
    "scientific": ["research", "study", "experiment", "data", "result", "results", "analysis", "hypothesis", "theory",
                   "observation", "observations", "method", "methods", "process", "mechanism", "evidence", "findings"],
    "financial": ["market", "markets", "investment", "return", "returns", "risk", "portfolio", "price", "prices", "%",
                  "percent", "rate", "rates", "cost", "profit", "loss", "value", "asset", "assets", "stock"],
    "argumentative": ["argue", "argues", "argument", "claim", "claims", "evidence", "however", "although", "despite",
                      "perspective", "viewpoint", "contend", "assert", "maintain", "support", "oppose", "believe"],
    "general": ["example", "such as", "including", "because", "therefore", "however", "although", "additionally",
                "furthermore", "moreover"],
}
QUALITY_THRESHOLD = 0.7


def normalized(text: Column) -> Column:
    """Lower case, trimmed, single blanks, only word characters, blanks and - ? ! . kept."""
    clean = F.regexp_replace(F.lower(text), r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(clean, r"\s+", " "), r"[^\p{L}\p{N}_\s\-?!.]", "")


def keywords(text: Column, stop_words: list[str] = STOP_WORDS, limit: int = MAX_KEYWORDS) -> Column:
    """First distinct words longer than two characters that are no stop words."""
    stops = F.array(*[F.lit(w) for w in stop_words])
    kept = F.filter(tokens(text), lambda w: (F.length(w) > 2) & ~F.array_contains(stops, w))
    return F.slice(F.array_distinct(kept), 1, limit)


def _ranked(entries: list[tuple[str, Column]]) -> Column:
    """Array of (score, name), best first, declaration order among equals."""
    rows = [F.struct((-score).alias("minus"), F.lit(i).alias("ord"), F.lit(name).alias("name"))
            for i, (name, score) in enumerate(entries)]
    return F.transform(F.array_sort(F.array(*rows)),
                       lambda r: F.struct((-r["minus"]).alias("score"), r["name"].alias("name")))


def intent_scores(text: Column) -> Column:
    """Array of (score, name) of all intents, best first."""
    low = F.lower(text)
    entries = []
    for intent, phrases in INTENT_KEYWORDS.items():
        score = F.lit(0.0)
        for phrase in phrases:
            weight = float(len(phrase.split()))
            score = score + F.when(low.startswith(phrase), weight + 0.5).when(low.contains(phrase), weight).otherwise(0.0)
        entries.append((intent, score))
    return _ranked(entries)


def intents(queries: DataFrame, text: str = "text") -> DataFrame:
    """Adds intent, confidence, method and the (at most three) predictions."""
    scored = queries.withColumn("_s", intent_scores(F.col(text)))
    total = F.aggregate("_s", F.lit(0.0), lambda a, s: a + s["score"])
    best = F.get("_s", F.lit(0))
    low, high = CONFIDENCE_RANGE
    scored = scored.withColumn("_total", total)
    found = F.col("_total") > 0
    return scored.select(
        *queries.columns,
        F.when(found, best["name"]).otherwise(DEFAULT_INTENT).alias("intent"),
        F.when(found, F.least(F.greatest(best["score"] / F.col("_total"), F.lit(low)), F.lit(high)))
        .otherwise(DEFAULT_CONFIDENCE).alias("confidence"),
        F.when(found, "keyword-based").otherwise("default").alias("method"),
        F.when(found, F.transform(F.filter(F.slice("_s", 1, 3), lambda s: s["score"] > 0),
                                  lambda s: F.struct(s["name"].alias("intent"), (s["score"] / F.col("_total")).alias("confidence"))))
        .otherwise(F.array(F.struct(F.lit(DEFAULT_INTENT).alias("intent"), F.lit(DEFAULT_CONFIDENCE).alias("confidence"))))
        .alias("predictions"),
    )


def features(queries: DataFrame, text: str = "text") -> DataFrame:
    """Adds the routing features of a query."""
    t, low = F.col(text), F.lower(text)
    questions = F.length(F.regexp_replace(t, r"[^?]", ""))
    hops = any_of(low, MULTI_HOP_WORDS) | (questions > 1) | (count_of(low, CONJUNCTIONS) >= 2)
    complexity = (
        F.when(F.length(t) > 100, 0.3).when(F.length(t) > 50, 0.1).otherwise(0.0)
        + F.when(questions > 1, 0.3).otherwise(0.0)
        + F.when(any_of(low, COMPLEX_WORDS), 0.2).otherwise(0.0)
        + F.least(count_of(low, NESTED_WORDS) * 0.1, F.lit(0.2))
    )
    return queries.withColumns({
        "has_latex": any_match(t, LATEX_MARKS),
        "has_code": any_match(t, CODE_MARKS, True) | any_of(low, CODE_WORDS),
        "is_comparative": any_of(low, COMPARATIVE_WORDS),
        "is_multi_hop": hops,
        "needs_structured_data": any_of(low, STRUCTURED_WORDS),
        "query_length": F.length(t),
        "num_questions": questions,
        "has_numbers": t.rlike(r"\d"),
        "complexity": F.least(complexity, F.lit(1.0)),
    })


def route_by_rules(queries: DataFrame, text: str = "text") -> DataFrame:
    """Adds rule_route, rule_confidence and rule_alternatives (needs the feature columns)."""
    t, low = F.col(text), F.lower(text)
    entries = []
    for route, (patterns, phrases, _) in ROUTES.items():
        score = F.lit(0.0)
        for pattern in patterns:
            score = score + F.when(any_match(t, [pattern], True), 0.5).otherwise(0.0)
        for phrase in phrases:
            score = score + F.when(low.contains(phrase), 0.3).otherwise(0.0)
        score = F.least(score, F.lit(1.0))
        if route in ROUTE_FLOORS:
            flag, floor = ROUTE_FLOORS[route]
            score = F.when(F.col(flag), F.greatest(score, F.lit(floor))).otherwise(score)
        entries.append((route, score))
    ranked = queries.withColumn("_r", _ranked(entries))
    best = F.get("_r", F.lit(0))
    sure = best["score"] >= 0.5
    route = F.when(sure, best["name"]).otherwise("standard_rag")
    ranked = ranked.withColumns({"rule_route": route, "rule_confidence": F.when(sure, best["score"]).otherwise(0.6)})
    return ranked.withColumn(
        "rule_alternatives", F.slice(F.filter("_r", lambda r: r["name"] != F.col("rule_route")), 1, 3)).drop("_r")


def _bucket(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:2], 16) % EMBED_DIM


def word_buckets(text: Column) -> Column:
    """Hash bucket of every word of a text."""
    return F.transform(tokens(text), lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 2), 16, 10).cast("int"), F.lit(EMBED_DIM)))


def route_by_meaning(queries: DataFrame, text: str = "text") -> DataFrame:
    """Adds semantic_route and semantic_score: cosine of hashed word counts with the route descriptions."""
    vector = F.transform(F.sequence(F.lit(0), F.lit(EMBED_DIM - 1)),
                         lambda i: F.size(F.filter("_b", lambda b: b == i)).cast("double"))
    sized = queries.withColumn("_b", word_buckets(F.col(text))).withColumn("_v", vector)
    sized = sized.withColumn("_n", F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x)))
    entries = []
    for route, (_, _, description) in ROUTES.items():
        counts: dict[int, int] = {}
        for word in description.lower().replace("(", " ").replace(")", " ").replace("-", " ").split():
            counts[_bucket(word)] = counts.get(_bucket(word), 0) + 1
        length = sum(c * c for c in counts.values()) ** 0.5
        product = F.lit(0.0)
        for bucket, count in sorted(counts.items()):
            product = product + F.get("_v", F.lit(bucket)) * float(count)
        entries.append((route, F.round(F.when(F.col("_n") > 0, product / (F.col("_n") * length)).otherwise(0.0), 9)))
    ranked = sized.withColumn("_r", _ranked(entries))
    best = F.get("_r", F.lit(0))
    return ranked.withColumns({
        "semantic_route": best["name"], "semantic_score": best["score"], "semantic_alternatives": F.slice("_r", 2, 3),
    }).drop("_b", "_v", "_n", "_r")


def route_both(queries: DataFrame) -> DataFrame:
    """Adds route and confidence: agreement is boosted, otherwise the higher confidence wins."""
    rule, meaning = F.col("rule_confidence"), F.col("semantic_score")
    agree = F.col("rule_route") == F.col("semantic_route")
    return queries.withColumns({
        "route": F.when(agree | (rule > meaning), F.col("rule_route")).otherwise(F.col("semantic_route")),
        "confidence": F.when(agree, F.least((rule * 0.6 + meaning * 0.4) * 1.2, F.lit(1.0)))
        .otherwise(F.greatest(rule, meaning)),
    })


def route_parameters(route: Column) -> Column:
    """Settings of a route as a map."""
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    out = pairs(DEFAULT_PARAMETERS)
    for name, extra in ROUTE_PARAMETERS.items():
        out = F.when(route == name, pairs({**DEFAULT_PARAMETERS, **extra})).otherwise(out)
    return out


def reformulations(text: Column) -> Column:
    """Up to three rewrites by the first question form that occurs."""
    low = F.regexp_replace(F.lower(text), r"^\s+|\s+$", "")
    out = F.array().cast("array<string>")
    for pattern, group, forms in reversed(REWRITES):
        part = F.regexp_extract(low, pattern, group)
        rewrites = F.array(*[F.concat(F.lit(f.split("{}")[0]), part, F.lit(f.split("{}")[1])) for f in forms])
        out = F.when(low.rlike(pattern), F.filter(rewrites, lambda r: r != low)).otherwise(out)
    return out


def related_expansions(text: Column) -> Column:
    """The query with up to two related terms appended, dictionary order."""
    low = F.lower(text)
    hits = [F.when(low.contains(term), F.array(*[F.concat(low, F.lit(" " + r)) for r in related[:2]]))
            .otherwise(F.array().cast("array<string>")) for term, related in RELATED_TERMS.items()]
    return F.slice(F.array_distinct(F.flatten(F.array(*hits))), 1, 2)


def sub_queries(text: Column) -> Column:
    """Parts around and/or, then single questions; parts longer than three characters, first three."""
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    parts = F.split(text, r"(?i)\s+and\s+|\s+or\s+")
    by_word = F.when(F.size(parts) > 1, F.filter(F.transform(parts, trim), lambda p: F.length(p) > MIN_QUERY_CHARS))
    asked = F.transform(F.filter(F.transform(F.split(text, r"\?"), trim), lambda p: p != ""), lambda p: F.concat(p, F.lit("?")))
    by_mark = F.when(F.size(asked) > 1, F.filter(asked, lambda p: F.length(p) > MIN_QUERY_CHARS))
    none = F.array().cast("array<string>")
    return F.slice(F.concat(F.coalesce(by_word, none), F.coalesce(by_mark, none)), 1, 3)


def synonym_expansions(queries: DataFrame, synonyms: DataFrame, limit: int = 2, per_word: int = 2,
                       words_used: int = 3, text: str = "text") -> DataFrame:
    """(query_id, expansions): the first whole-word occurrence of a word replaced by a synonym.

    ``synonyms`` is (word, ord, synonym). Only the first three important words
    (longer than three characters, no stop words) of a query are looked up.
    """
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])
    important = F.slice(F.array_distinct(F.filter(tokens(text), lambda w: (F.length(w) > 3) & ~F.array_contains(stops, w))), 1, words_used)
    asked = queries.select("query_id", F.lower(text).alias("_low"), F.posexplode(important).alias("pos", "word"))
    ranked = synonyms.withColumn("_n", F.row_number().over(W.partitionBy("word").orderBy("ord", "synonym"))).filter(F.col("_n") <= per_word)
    at = F.expr(r"regexp_instr(_low, concat('(?U)\\b', word, '\\b'))")
    swapped = F.expr("concat(substring(_low, 1, _at - 1), synonym, substring(_low, _at + length(word)))")
    made = asked.join(ranked, "word").withColumn("_at", at).select(
        "query_id", "_low", F.col("pos"), F.col("_n"), F.when(F.col("_at") > 0, swapped).otherwise(F.col("_low")).alias("e"))
    made = made.filter("e <> _low")
    # At most words_used * per_word rows belong to one query.
    return made.groupBy("query_id").agg(F.slice(F.array_distinct(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "_n", "e"))), lambda r: r["e"])), 1, limit).alias("expansions"))


def merge_expansions(text: Column, *lists: Column, limit: int = MAX_EXPANSIONS) -> Column:
    """All lists in order without repeats (case aside) and without the query itself."""
    every = F.concat(*lists)
    lows = F.transform(every, F.lower)
    firsts = F.filter(every, lambda e, i: (F.lower(e) != F.lower(text)) & (F.array_position(lows, F.lower(e)) == i + 1))
    return F.slice(firsts, 1, limit)


def hypothetical_quality(query: Column, answer: Column, domain: Column) -> Column:
    """Quality of a hypothetical answer, 0 to 1, as a product of heuristics."""
    low = F.lower(answer)
    bag = words(low)
    count = F.size(bag)
    unique = F.size(F.array_distinct(bag)) / count
    score = F.when(count < 10, 0.5 * 0.3).when(count < 20, 0.5).otherwise(1.0)
    score = score * F.when((count > 0) & (unique < 0.4), 0.6 * 0.4).when((count > 0) & (unique < 0.6), 0.6).otherwise(1.0)
    generic = count_of(low, GENERIC_PHRASES)
    score = score * F.when(generic > 5, 0.7 * 0.5).when(generic > 3, 0.7).otherwise(1.0)
    share = lambda signs: count_of(low, signs) / len(signs)
    ratio = share(DOMAIN_SIGNS["general"])
    for name, signs in DOMAIN_SIGNS.items():
        if name != "general":
            ratio = F.when(domain == name, share(signs)).otherwise(ratio)
    score = score * (0.5 + 0.5 * F.least(ratio * 3, F.lit(1.0)))
    asked = F.array_distinct(words(F.lower(query)))
    overlap = F.size(F.array_intersect(asked, bag)) / F.size(asked)
    return score * F.when(F.size(asked) == 0, 1.0).when(overlap > 0.8, 0.5).when(overlap < 0.1, 0.6).otherwise(1.0)


def select_hypotheticals(scored: DataFrame, n: int, threshold: float = QUALITY_THRESHOLD) -> DataFrame:
    """Best n answers per query among those that pass the threshold, or among all if none passes."""
    passed = (F.col("quality") >= threshold)
    any_passed = scored.groupBy("query_id").agg(F.max(passed).alias("_any"))
    kept = scored.join(any_passed, "query_id").filter(passed | ~F.col("_any")).drop("_any")
    window = W.partitionBy("query_id").orderBy(F.col("quality").desc(), "hypo_id")
    return kept.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)
