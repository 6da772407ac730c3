"""Formula and code extraction from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formula patterns of the article ingest, with the group that is kept.
INGEST_PATTERNS = [
    (r"\$\$([^$]+)\$\$", 1),
    (r"\$([^$]+)\$", 1),
    (r"\\begin\{equation\}(.*?)\\end\{equation\}", 1),
    (r"\\begin\{align\}(.*?)\\end\{align\}", 1),
    (r"\\begin\{math\}(.*?)\\end\{math\}", 1),
    (r"<math[^>]*>(.*?)</math>", 1),
    (r"\\frac\{[^}]+\}\{[^}]+\}", 0),
    (r"\\sum_\{[^}]*\}", 0),
    (r"\\int_\{[^}]*\}", 0),
    (r"\\sqrt\{[^}]+\}", 0),
    (r"\\[a-zA-Z]+\{[^}]*\}", 0),
]
INGEST_FLAGS = "(?is)"

# Formula patterns of the upload processor with their inline flags;
# two groups mean "the first one that is not empty".
PROCESSOR_PATTERNS = [
    (r"(?s)\$\$([^$]+)\$\$", 1),
    (r"\$([^$\n]+)\$", 1),
    (r"(?s)\\begin\{equation\*?\}(.*?)\\end\{equation\*?\}", 1),
    (r"(?s)\\begin\{align\*?\}(.*?)\\end\{align\*?\}", 1),
    (r"(?s)\\begin\{math\}(.*?)\\end\{math\}", 1),
    (r"(?is)<math[^>]*>(.*?)</math>", 1),
    (r"\\frac\{([^}]+)\}\{([^}]+)\}", 2),
    (r"\\sqrt(?:\[([^\]]+)\])?\{([^}]+)\}", 2),
    (r"\\sum(?:_\{([^}]*)\})?(?:\^\{([^}]*)\})?", 2),
    (r"\\int(?:_\{([^}]*)\})?(?:\^\{([^}]*)\})?", 2),
    (r"(?s)\\begin\{[pbvBV]?matrix\}(.*?)\\end\{[pbvBV]?matrix\}", 1),
]

# Symbols that mark a text as mathematical.
MATH_SYMBOLS = "∫∑∏√∞≠≤≥±×÷∂∇∈∉⊂⊃∪∩∧∨αβγδεθλμπσφω→←↔⇒⇐⇔"

# Fixed value: fenced code block, body in group 2.
FENCED_CODE = r"(?s)```(\w*)\n?(.*?)```"


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def ingest_formulas(text: Column) -> Column:
    """Distinct formulas, sorted."""
    found = [_found(text, INGEST_FLAGS + p, g) for p, g in INGEST_PATTERNS]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*found))))


def processor_formulas(text: Column) -> Column:
    """Distinct formulas of the upload processor, sorted."""
    found = []
    for pattern, groups in PROCESSOR_PATTERNS:
        first = _found(text, pattern, 1)
        if groups == 2:
            first = F.filter(
                F.zip_with(first, _found(text, pattern, 2), lambda a, b: F.when(a != "", a).otherwise(b)),
                lambda f: f != "",
            )
        found.append(first)
    return F.array_sort(F.array_distinct(F.flatten(F.array(*found))))


def has_math(text: Column, formulas: Column) -> Column:
    return (F.size(formulas) > 0) | text.rlike(f"[{MATH_SYMBOLS}]")


def mark_math(text: Column) -> Column:
    """Display math, equation and align bodies between [MATH_START] and [MATH_END]."""
    for pattern, _ in (PROCESSOR_PATTERNS[0], PROCESSOR_PATTERNS[2], PROCESSOR_PATTERNS[3]):
        text = F.regexp_replace(text, pattern, "[MATH_START]$1[MATH_END]")
    return text


def code_blocks(text: Column) -> Column:
    """Bodies of fenced blocks that are not blank."""
    return F.filter(_found(text, FENCED_CODE, 2), lambda body: body.rlike(r"\S"))
