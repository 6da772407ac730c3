"""Input guards as column expressions: flags and cleaned values, never exceptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.text import any_match

# Patterns that mark a query as suspicious, matched without case.
SQL_PATTERNS = [
    r"(\b(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|EXEC|EXECUTE)\b)",
    r"(--|;|\/\*|\*\/)",
    r"(\bUNION\b.*\bSELECT\b)",
    r"(\bOR\b.*=.*)",
    r"(xp_cmdshell|sp_executesql)",
]
XSS_PATTERNS = [
    r"<script[^>]*>.*?</script>",
    r"javascript:",
    r"on\w+\s*=",
    r"<iframe",
    r"<embed",
    r"<object",
]
COMMAND_PATTERNS = [
    r"[;&|`]",
    r"\$\([^)]+\)",
    r"`[^`]+`",
    r"\b(cat|ls|pwd|chmod|rm|mv|cp|curl|wget|nc|bash|sh)\s+[/\w]",
]
MAX_QUERY_CHARS = 2000

# Fixed value: e-mail format.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"

# Hosts and address ranges that may not be fetched.
BLOCKED_HOSTS = ["localhost", "127.0.0.1", "0.0.0.0", "::1", "169.254.169.254", "metadata.google.internal"]
PRIVATE_PREFIXES = ["10.", "192.168."]
URL_SCHEMES = ["http", "https"]

# LaTeX commands that are refused.
DANGEROUS_COMMANDS = [
    r"\\write", r"\\input", r"\\include", r"\\openin", r"\\openout", r"\\read", r"\\csname",
    r"\\expandafter", r"\\catcode", r"\\def", r"\\let", r"\\futurelet",
]
MAX_LATEX_CHARS = 10000


def query_problem(text: Column, max_chars: int = MAX_QUERY_CHARS) -> Column:
    """Name of the first rule a query breaks, null if it breaks none."""
    return (
        F.when(F.length(text) > max_chars, "length")
        .when(any_match(F.upper(text), SQL_PATTERNS, True), "sql")
        .when(any_match(text, XSS_PATTERNS, True), "xss")
        .when(any_match(text, COMMAND_PATTERNS, True), "command")
    )


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sanitize(text: Column, max_chars: int | None = None, allow_html: bool = False) -> Column:
    """Drop control characters (newline, return and tab stay) and tags, cut, trim."""
    text = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    if not allow_html:
        text = F.regexp_replace(text, r"<[^>]+>", "")
    if max_chars:
        text = F.substring(text, 1, max_chars)
    return strip(text)


def is_email(text: Column) -> Column:
    return text.rlike(EMAIL)


def is_safe_url(url: Column) -> Column:
    """Allowed scheme and no loopback, metadata or private host."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    host = F.regexp_replace(host, r"[\[\]]", "")
    private = F.lit(False)
    for prefix in PRIVATE_PREFIXES:
        private = private | host.startswith(prefix)
    return scheme.isin(URL_SCHEMES) & ~host.isin(BLOCKED_HOSTS) & ~private


def json_depth(text: Column) -> Column:
    """Deepest nesting of objects and arrays; strings do not count."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', "")
    brackets = F.regexp_extract_all(bare, F.lit(r"[\[\]{}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(acc, bracket):
        now = acc["now"] + F.when(bracket.isin("{", "["), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(acc["top"], now).alias("top"))

    return F.aggregate(brackets, start, step, lambda acc: acc["top"])


def collection_name(name: Column) -> Column:
    """Storage name of an upload: no ending, safe characters, letter first, 46 characters, lower case."""
    base = F.regexp_replace(name, r"\.[^.]+$", "")
    base = F.regexp_replace(base, r"[^a-zA-Z0-9_-]", "_")
    base = F.when(base.rlike(r"^[^a-zA-Z]"), F.concat(F.lit("doc_"), base)).otherwise(base)
    return F.concat(F.lower(F.substring(base, 1, 46)), F.lit("_doc"))


def latex_problem(text: Column) -> Column:
    """dangerous, too_long or null."""
    return F.when(F.length(text) > MAX_LATEX_CHARS, "too_long").when(
        any_match(text, DANGEROUS_COMMANDS, True), "dangerous")


def strip_latex_comments(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?m)%[^\n]*$", ""))


def latex_commands(text: Column) -> Column:
    """Distinct command names, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\\([a-zA-Z]+)"), F.lit(1))))
