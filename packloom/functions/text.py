"""Scalar functions on texts and paths, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
SECRET = r"""(?iud)(api[_-]?key|secret|password|token|sk-ant-api|ghp_).*?['\x22][A-Za-z0-9\-_\.]{16,}['\x22]"""
REDACTED = "[REDACTED_SECRET]"
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx", "rs": "rust", "go": "go", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "java": "java", "cs": "csharp", "rb": "ruby", "php": "php"}
BYTES_PER_TOKEN = 4


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """After the last dot of a name; none for a name whose only dot leads it."""
    return F.regexp_extract(file_name(path), r"(?s)^.+\.([^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?s)^(.+)\.[^.]*$", "$1")


def language(ext: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.create_map(*pairs)[ext]


def redact_secrets(text: Column) -> Column:
    """SECRET replaced. The letters that a match can begin with are tested first, which is faster and changes nothing."""
    return F.regexp_replace(text, F.lit("(?=[aAsSpPtTgG\u017f])" + SECRET), F.lit(REDACTED))


def strip_html_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def minify(text: Column) -> Column:
    """Lines without white space at their ends, and without those that are then empty."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"(?U)\s+\z", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def count_tokens(text: Column) -> Column:
    return F.floor(F.octet_length(text) / BYTES_PER_TOKEN).cast("long")


def clean_import(text: Column) -> Column:
    return F.regexp_replace(text, "^['\"`<>]+|['\"`<>]+$", "")


def render_block(path: Column, ext: Column, body: Column) -> Column:
    return F.concat(F.lit("### File: `"), path, F.lit("`\n```"), ext, F.lit("\n"), body, F.lit("\n```\n\n"))


def normalize_glob(pattern: Column) -> Column:
    p = F.trim(pattern)
    return F.when(p.startswith("/"), F.regexp_replace(p, "^/+", "")).when(p.startswith("**") | p.contains("/"), p).otherwise(F.concat(F.lit("**/"), p))


def is_binary(content: Column) -> Column:
    """A NUL among the first 1,024 bytes."""
    return F.call_function("position", F.lit(b"\x00"), F.substring(content, 1, 1024)) > 0


def alias_target(spec: Column, pattern: Column, target: Column) -> Column:
    """What an alias pattern (exact, or with one star) makes of an import, or null."""
    stars = F.length(pattern) - F.length(F.replace(pattern, F.lit("*"), F.lit("")))
    head, tail = F.split_part(pattern, F.lit("*"), F.lit(1)), F.split_part(pattern, F.lit("*"), F.lit(2))
    middle = F.substring(spec, F.length(head) + 1, F.length(spec) - F.length(head) - F.length(tail))
    wild = (stars == 1) & F.startswith(spec, head) & F.endswith(spec, tail) & (F.length(spec) >= F.length(head) + F.length(tail))
    return F.when((stars == 0) & (spec == pattern), target).when(wild, F.replace(target, F.lit("*"), middle))


def fold_path(path: Column) -> Column:
    """The path without empty, "." and ".." components."""
    keep = lambda acc, x: F.when((x == "") | (x == "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), keep), "/")
