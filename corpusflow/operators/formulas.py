"""Formula queries: detection, classification, search queries, filters, hints and re-ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import any_match, any_of, words

# Marks of LaTeX in documents.
DOCUMENT_MARKS = [r"\$.*?\$", r"\\\[.*?\\\]", r"\\begin\{equation\}", r"\\frac\{", r"\\sum", r"\\int",
                  r"\\alpha|\\beta|\\gamma"]

# Formula delimiters, in order.
DELIMITERS = [r"\$([^\$]+)\$", r"(?s)\\\[(.+?)\\\]", r"(?s)\\begin\{equation\}(.+?)\\end\{equation\}",
              r"(?s)\\begin\{align\}(.+?)\\end\{align\}"]

# Formula classes in the order they are tried.
FORMULA_CLASSES = {
    "equation": [r"=", r"\\eq"],
    "integral": [r"\\int", r"\\iint", r"\\iiint"],
    "derivative": [r"\\frac\{d", r"\\partial", r"'"],
    "summation": [r"\\sum"],
    "limit": [r"\\lim"],
    "matrix": [r"\\begin\{matrix\}", r"\\begin\{pmatrix\}", r"\\begin\{bmatrix\}"],
    "vector": [r"\\vec", r"\\mathbf"],
    "trigonometric": [r"\\sin", r"\\cos", r"\\tan", r"\\arcsin", r"\\arccos", r"\\arctan"],
    "logarithmic": [r"\\log", r"\\ln", r"\\lg"],
}

# Variables, Greek letters and operator names.
VARIABLE = r"(?<![\\a-zA-Z])[a-z](?![a-zA-Z])"
GREEK = r"\\(alpha|beta|gamma|delta|epsilon|theta|lambda|mu|sigma|omega)"
OPERATORS = {
    r"\+": "+", "-": "-", r"\*": "*", "/": "/", "=": "=", r"\\cdot": "·", r"\\times": "×", r"\\div": "÷",
    r"\\frac": "fraction", r"\\sqrt": "sqrt", r"\\sum": "sum", r"\\int": "integral", r"\\partial": "partial",
    r"\\lim": "limit",
}

# Words that tell the kind of a math question, in the order they are tried.
QUESTION_WORDS = {
    "solve": ["solve", "find solution", "calculate", "compute"],
    "simplify": ["simplify", "reduce", "expand"],
    "integrate": ["integrate", "integration", "antiderivative"],
    "differentiate": ["differentiate", "derivative", "derive"],
    "prove": ["prove", "show that", "demonstrate"],
}
STRATEGIES = {"general": "dense_vector", "prove": "hybrid"}
MAX_SEARCH_QUERIES = 10
MAX_EXPANSIONS = 5

_NONE = "array<string>"


def _none() -> Column:
    return F.array().cast(_NONE)


def detect(text: Column) -> Column:
    """Formulas of a text, in delimiter order, without repeats."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in DELIMITERS])))


def formula_class(formula: Column) -> Column:
    out = F.lit("general")
    for name, patterns in reversed(list(FORMULA_CLASSES.items())):
        out = F.when(any_match(formula, patterns), name).otherwise(out)
    return out


def variables(formula: Column) -> Column:
    found = F.concat(F.regexp_extract_all(formula, F.lit(VARIABLE), F.lit(0)), F.regexp_extract_all(formula, F.lit(GREEK), F.lit(1)))
    return F.array_sort(F.array_distinct(found))


def operators(formula: Column) -> Column:
    names = [F.when(formula.rlike(p), n) for p, n in OPERATORS.items()]
    return F.array_sort(F.array_compact(F.array(*names)))


def without_formulas(text: Column) -> Column:
    """Text with formulas cut out. A dropped formula leaves its surrounding blanks in place."""
    for pattern in DELIMITERS:
        text = F.regexp_replace(text, pattern, " [FORMULA] ")
    text = F.btrim(F.regexp_replace(text, r"\s+", " "))
    return F.btrim(F.replace(text, F.lit("[FORMULA]"), F.lit("")))


def analyze(queries: DataFrame, text: str = "text") -> DataFrame:
    """Adds formulas, kinds, vars, ops, text_query, has_latex and query_type."""
    base = queries.withColumn("formulas", detect(F.col(text)))
    base = base.withColumns({
        "kinds": F.transform("formulas", formula_class),
        "vars": F.array_sort(F.array_distinct(F.flatten(F.transform("formulas", variables)))),
        "ops": F.array_sort(F.array_distinct(F.flatten(F.transform("formulas", operators)))),
        "has_latex": F.size("formulas") > 0,
        "text_query": F.when(F.size("formulas") > 0, without_formulas(F.col(text))).otherwise(F.col(text)),
    })
    return base.withColumn("query_type", _question_type())


def _question_type() -> Column:
    low = F.lower("text_query")
    has_kind = lambda kind: F.array_contains("kinds", kind)
    kind = F.when(~F.col("has_latex"), "general")
    kind = kind.when(any_of(low, QUESTION_WORDS["solve"]), F.when(has_kind("equation"), "solve_equation").otherwise("evaluate"))
    for name in ("simplify", "integrate", "differentiate", "prove"):
        kind = kind.when(any_of(low, QUESTION_WORDS[name]), name)
    return (kind.when(has_kind("equation"), "solve_equation").when(has_kind("integral"), "integrate")
            .when(has_kind("derivative"), "differentiate").otherwise("formula_query"))


def search_queries() -> Column:
    """Up to ten distinct search queries of an analyzed row."""
    t, kind = F.col("text_query"), F.col("query_type")
    joined = F.array_join("vars", " ")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    made = F.concat(
        F.array(t),
        F.when(F.col("has_latex"), F.array(say(t, " ", F.array_join("kinds", " ")))).otherwise(_none()),
        F.when(F.size("vars") > 0, F.array(say(t, " variables: ", joined))).otherwise(_none()),
        F.when(kind == "solve_equation", F.array(say("solving equations ", t), say("how to solve ", joined, " equation")))
        .when(kind == "integrate", F.array(say("integration ", t), say("integral calculus ", joined)))
        .when(kind == "differentiate", F.array(say("differentiation ", t), say("derivative ", joined)))
        .when(kind == "simplify", F.array(say("simplification ", t), F.lit("algebraic simplification")))
        .otherwise(_none()),
        F.col("formulas"),
    )
    trimmed = F.transform(made, lambda q: F.regexp_replace(q, r"^\s+|\s+$", ""))
    return F.slice(F.array_distinct(F.filter(trimmed, lambda q: q != "")), 1, MAX_SEARCH_QUERIES)


def specific_kinds() -> Column:
    return F.filter("kinds", lambda k: k != "general")


def strategy() -> Column:
    kind = F.col("query_type")
    with_formula = F.when(kind == "general", "dense_vector").when(kind == "prove", "hybrid").otherwise("formula_aware")
    plain = F.when(any_of(F.lower("text_query"), ["compare", "difference", "vs"]), "hybrid").otherwise("dense_vector")
    return F.when(F.col("has_latex"), with_formula).otherwise(plain)


def primary_query() -> Column:
    t = F.col("text_query")
    kinds = F.array_sort(F.array_distinct("kinds"))
    parts = F.array_compact(F.array(
        F.nullif(t, F.lit("")),
        F.when(~F.array_contains(kinds, "general"), F.concat(F.lit("("), F.array_join(kinds, ", "), F.lit(")"))),
        F.when(F.size("vars") > 0, F.concat(F.lit("variables: "), F.array_join(F.slice("vars", 1, 3), ", "))),
    ))
    return F.when(F.col("has_latex"), F.btrim(F.array_join(parts, " "))).otherwise(t)


def expansion_queries(original: str = "text") -> Column:
    """Up to five further queries, none equal to the question."""
    t, kind = F.col("text_query"), F.col("query_type")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    plain = F.array(say("What is ", t, "?"), say("Explain ", t), say("Information about ", t), say(t, " definition and examples"))
    kinds = specific_kinds()
    formula = F.concat(
        F.when(F.size(kinds) > 0, F.array(say(F.get(kinds, F.lit(0)), " ", t))).otherwise(_none()),
        F.when(kind.isin("solve_equation", "evaluate"), F.array(say("how to solve ", t), say("step by step solution for ", t))).otherwise(_none()),
        F.array(say("theory and explanation of ", t), say("examples of ", t)),
        F.when(F.size("vars") > 0, F.array(say(t, " involving ", F.array_join(F.slice("vars", 1, 3), " ")))).otherwise(_none()),
    )
    made = F.when(F.col("has_latex"), formula).otherwise(plain)
    lows = F.transform(made, lambda q: F.btrim(F.lower(q)))
    kept = F.filter(made, lambda q, i: (F.array_position(lows, F.btrim(F.lower(q))) == i + 1) & (F.btrim(F.lower(q)) != F.lower(original)))
    return F.slice(kept, 1, MAX_EXPANSIONS)


def complexity() -> Column:
    score = F.size("formulas") * 2 + F.size("vars") + F.size("ops")
    level = F.when(score <= 3, "simple").when(score <= 7, "moderate").otherwise("complex")
    return F.when(F.col("has_latex") & (score > 0), level)


def formula_weight() -> Column:
    ratio = F.size("formulas") / F.greatest(F.size(words("text_query")), F.lit(1))
    return F.when(F.col("has_latex"), F.least(F.lit(0.8), 0.3 + ratio * 0.5))


def formula_filter(docs: DataFrame, kinds=None, variables=None, operators=None, query_type=None, level=None) -> DataFrame:
    """Analyzed documents that share a formula class, variable or operator, and match type and complexity."""
    test = F.lit(True)
    for column, wanted in (("kinds", kinds), ("vars", variables), ("ops", operators)):
        if wanted:
            test = test & F.arrays_overlap(column, F.array(*[F.lit(w) for w in wanted]))
    if query_type:
        test = test & (F.col("query_type") == query_type)
    if level:
        test = test & (complexity() == level)
    return docs.filter(test)


def similar_queries(formula: Column) -> Column:
    """Queries that look for formulas like this one."""
    kind, vs, ops = formula_class(formula), variables(formula), operators(formula)
    return F.concat(
        F.when(kind != "general", F.array(kind)).otherwise(_none()),
        F.when((F.size(vs) > 0) & (F.size(ops) > 0), F.array(F.concat(
            F.array_join(vs, " "), F.lit(" with "), F.array_join(F.slice(ops, 1, 3), " ")))).otherwise(_none()),
        F.array(formula))


def explanation_queries(formula: Column) -> Column:
    """Queries that look for explanations of this formula."""
    kind, vs = formula_class(formula), variables(formula)
    return F.concat(
        F.when(kind != "general", F.array(F.concat(F.lit("what is "), kind), F.concat(F.lit("explain "), kind))).otherwise(_none()),
        F.when(F.size(vs) > 0, F.array(F.concat(F.lit("how to work with "), F.array_join(F.slice(vs, 1, 2), " ")))).otherwise(_none()))


def formula_rerank(hits: DataFrame) -> DataFrame:
    """Base scores blended with formula agreement by each query's formula weight.

    ``hits`` carries score, the query's formulas, vars and formula_weight and the
    document's doc_formulas and doc_vars.
    """
    share = lambda want, have: F.when(F.size(want) > 0, F.size(F.array_intersect(want, have)) / F.size(want)).otherwise(0.0)
    agreement = (share("formulas", "doc_formulas") + share("vars", "doc_vars")) / 2
    w = F.coalesce("formula_weight", F.lit(0.0))
    return hits.withColumn("score", (1 - w) * F.col("score") + w * agreement)
