"""Text functions as column expressions: identifiers, redaction, paths, URLs, subjects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Splits of identifiers, in order.
IDENTIFIER_SPLITS = (
    (r"([A-Z]+)([A-Z][a-z])", "$1 $2"),
    (r"([a-z0-9])([A-Z])", "$1 $2"),
    (r"([A-Za-z])([0-9])", "$1 $2"),
    (r"([0-9])([A-Za-z])", "$1 $2"),
    (r"[^A-Za-z0-9]+", " "),
)
# Credentials and what stands in for them, in order.
SECRETS = (
    (r"(?i)(\b(?:aws_access_key_id|aws_secret_access_key|api[_-]?key|secret|password|token)\b\s*[:=]\s*)(['\"]?)[^\s'\";,]+", "$1$2[REDACTED]"),
    (r"\bgh[pousr]_[A-Za-z0-9_]{20,}\b", "[REDACTED_GITHUB_TOKEN]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED_AWS_ACCESS_KEY]"),
    (r"(?s)-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----.*?-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
)
# Languages by extension.
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go", ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "cpp", ".cs": "csharp", ".rb": "ruby", ".php": "php", ".sql": "sql"}
SUPPORTED = (*LANGUAGES, ".hpp", ".md", ".json", ".yaml", ".yml", ".toml")
# Words of a bug fix, methods of an endpoint.
BUGFIX = r"(?i)\b(?:fix(?:es|ed|ing)?|bugfix(?:es)?|hotfix(?:es)?|bugs?|regressions?)\b"
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH")


def normalize_identifier(c: Column) -> Column:
    for pattern, to in IDENTIFIER_SPLITS:
        c = F.regexp_replace(c, F.lit(pattern), F.lit(to))
    return F.trim(F.lower(c))


def identifier_tokens(c: Column) -> Column:
    """Tokens of a normalised text; an empty array for null or nothing."""
    n = normalize_identifier(F.coalesce(c, F.lit("")))
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " "))


def redact(c: Column) -> Column:
    for pattern, to in SECRETS:
        c = F.regexp_replace(c, F.lit(pattern), F.lit(to))
    return c


def redact_bytes(c: Column) -> Column:
    """Redacted UTF-8; other bytes as they are."""
    return F.when(F.is_valid_utf8(c.cast("string")), redact(c.cast("string")).cast("binary")).otherwise(c)


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot; none for names that only start with one."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.element_at(known, extension(path)), F.lit("unknown"))


def content_hash(c: Column) -> Column:
    return F.sha2(redact_bytes(c.cast("binary")), 256)


def is_bugfix(subject: Column) -> Column:
    return F.coalesce(subject.rlike(BUGFIX), F.lit(False))


def endpoint_method(name: Column) -> Column:
    first = F.upper(F.split_part(name, F.lit(" "), F.lit(1)))
    return F.when(first.isin(*METHODS), first).otherwise(F.lit("UNKNOWN"))


def analysis_key(url: Column, patch: Column) -> Column:
    return F.coalesce(url, F.concat(F.lit("patch:"), F.sha2(patch, 256)))


def relative_path(c: Column) -> Column:
    """A relative POSIX path without traversal, empty parts or back slashes."""
    return F.coalesce((c != "") & ~c.rlike(r"(^/|\\|\x00|(^|/)(\.{0,2})(/|$))"), F.lit(False))


# Scheme and host in any case; owners of letters, digits and hyphens; repositories that aren't . or .. or .git.
HOSTED = r"\A(?i:https://github\.com)/[A-Za-z0-9][A-Za-z0-9-]*/(?!(?:\.{1,2}|\.git)(?:/|\z))[A-Za-z0-9_.-]+"


def _hosted(c: Column, rest: str) -> Column:
    """White space around doesn't count."""
    bare = F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")
    return F.coalesce(bare.rlike(HOSTED + rest), F.lit(False))


def repository_url(c: Column) -> Column:
    return _hosted(c, r"/?\z")


def pull_request_url(c: Column) -> Column:
    return _hosted(c, r"/pull/[1-9][0-9]*/?\z")


def spotlight(c: Column, mark: str = "> ") -> Column:
    """Each line behind a mark, so that quoted text can't pass for instructions."""
    return F.array_join(F.transform(F.split(c, "\n"), lambda line: F.concat(F.lit(mark), line)), "\n")


def prompt(question: Column, rendered: Column, cites: Column, most: int = 120_000) -> Column:
    """Struct of question (JSON text), context (rendered evidence behind marks), allowed (ids that an answer may cite, or `none`) and fits (the context is within `most` characters)."""
    context = spotlight(rendered, "QUOTED | ")
    allowed = F.when(F.size(cites) > 0, F.array_join(F.transform(cites, lambda x: F.concat(F.lit("["), x, F.lit("]"))), ", ")).otherwise(F.lit("none"))
    return F.struct(F.to_json(F.struct(question.alias("question"))).alias("question"), context.alias("context"), allowed.alias("allowed"), (F.length(context) <= most).alias("fits"))
