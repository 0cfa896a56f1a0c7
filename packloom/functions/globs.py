"""Ignore patterns as regular expressions, made on the driver."""

from __future__ import annotations

import re


def normalize(pattern: str) -> str:
    p = pattern.strip()
    if p.startswith("/"):
        return p.lstrip("/")
    return p if p.startswith("**") or "/" in p else f"**/{p}"


def to_regex(glob: str, star_crosses: bool = True) -> str | None:
    """An anchored pattern that Java and Python read alike; None for a bad glob. star_crosses: a single star matches "/" too."""
    one, out, i, depth = "." if star_crosses else "[^/]", ["(?s)^"], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                return None
            body = glob[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}":
            if not depth:
                return None
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(f"{one}*" if c == "*" else one if c == "?" else re.escape(c))
        i += 1
    return None if depth else "".join(out) + "$"


def ignore_regexes(patterns: list[str]) -> list[str]:
    return [r for p in patterns if (r := to_regex(normalize(p)))]
