"""Comments, strings and imports of source texts, found by one scan for each family of languages."""

from __future__ import annotations

import json

import regex

_DQ, _SQ = r'"(?:[^"\\\n]++|\\.)*+"', r"'(?:[^'\\\n]++|\\.)*+'"
_TRIPLE = r'"""(?:[^"\\]++|\\.|"(?!""))*+"""'
_LINE, _SPLICED, _BLOCK = r"//[^\n]*", r"//(?:\\\n|[^\n])*+", r"/\*.*?(?:\*/|(?!.))"
#: Strings and comments in what Java's and Python's patterns have in common, so that Spark can strip these comments itself.
PLAIN = {
    "python": ([rf"[rRbBuUfF]{{0,2}}{_TRIPLE}", rf"[rRbBuUfF]{{0,2}}{_TRIPLE}".replace('"', "'"), _DQ, _SQ], [r"\#[^\n]*"]),
    "c": ([_DQ, _SQ], [_SPLICED, _BLOCK]),
    "go": ([r"`[^`]*`", _DQ, _SQ], [_LINE, _BLOCK]),
    "java": ([_TRIPLE, _DQ, _SQ], [_LINE, _BLOCK]),
    "csharp": ([r'(?:@\$?|\$@)"(?:""|[^"]++)*+"', rf"\$?{_DQ}", _SQ], [_LINE, _BLOCK]),
}


def _scanner(strings: list[str], comments: list[str]) -> regex.Pattern:
    return regex.compile(f"(?P<s>{'|'.join(strings)})|(?P<c>{'|'.join(comments)})", regex.S | regex.M)


def java_pattern(lang: str) -> str:
    """For regexp_replace with "$1": strings are kept, comments are not."""
    strings, comments = PLAIN[lang]
    return f"(?sm)({'|'.join(strings)})|{'|'.join(comments)}"


_JS = _scanner([r"`(?:\\.|[^`\\])*+`", _DQ, _SQ, r"(?<=[(,=:\[!&|?{};]\s*|return\s*)/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"], [_LINE, _BLOCK, r"\A#![^\n]*"])
_SCANNERS = {
    **{lang: _scanner(*parts) for lang, parts in PLAIN.items()},
    "javascript": _JS, "typescript": _JS, "tsx": _JS, "cpp": _scanner([r'R"(?P<t>[^(\s]*)\(.*?\)(?P=t)"', _DQ, _SQ], [_SPLICED, _BLOCK]),
    "rust": _scanner([r'b?r(?P<h>\#*)".*?"(?P=h)', r'b?"(?:\\.|[^"\\])*+"', r"b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'"], [_LINE, r"(?P<b>/\*(?:[^*/]++|\*(?!/)|/(?!\*)|(?&b))*+\*/)"]),
    "ruby": _scanner([r"<<[~-]?(?P<q>['\"]?)(?P<w>[A-Z_]\w*)(?P=q)[^\n]*\n.*?^[ \t]*(?P=w)\b", r'"(?:\\.|[^"\\])*+"', r"'(?:\\.|[^'\\])*+'"], [r"^=begin\b.*?^=end\b[^\n]*", r"\#(?!\{)[^\n]*"]),
    "php": _scanner([r'"(?:\\.|[^"\\])*+"', r"'(?:\\.|[^'\\])*+'"], [r"//(?:(?!\?>)[^\n])*", r"\#(?!\[)(?:(?!\?>)[^\n])*", _BLOCK]),
}
_PHP = regex.compile(r"<\?(?:php|=)?(.*?)(?:\?>|\Z)", regex.S)


def _tokens(text: str, lang: str):
    """Matches of strings (group s) and comments (group c); in PHP only inside its tags."""
    scanner = _SCANNERS[lang]
    if lang != "php":
        yield from scanner.finditer(text)
        return
    for part in _PHP.finditer(text):
        yield from scanner.finditer(text, part.start(1), part.end(1))


def comment_spans(text: str, lang: str) -> list[tuple[int, int]]:
    return [m.span() for m in _tokens(text, lang) if m.group("c") is not None] if lang in _SCANNERS else []


def strip_comments(text: str, lang: str | None) -> str:
    """The text without its comments; unchanged for an unknown language. Docstrings are strings."""
    out, at = [], 0
    for a, b in comment_spans(text, lang or ""):
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


_MARK = r"\x00(\d+)\x00"
_NAME = r"[^\W\d]\w*"
_PY_IMPORT = regex.compile(rf"(?:^|[;:])[ \t]*(?:import[ \t]+(?P<names>[^\n;]+)|from[ \t]*(?P<module>\.*[ \t]*(?:{_NAME}(?:\.{_NAME})*)?)[ \t]*import[ \t]*(?P<what>\([^)]*\)|[^\n;]+))", regex.M)
_JS_IMPORT = regex.compile(rf"(?<![.\w])import(?=[\s{{*\x00])(?:[^;()\x00]*?(?<=\bfrom|import)\s*{_MARK}|\s+(?P<name>{_NAME})\s*=\s*require\s*\([^)]*\))")
_INCLUDE = regex.compile(rf"^[ \t]*#[ \t]*include\b(?P<rest>[^\n]*)", regex.M)
_DECLARED = {"go": regex.compile(r"^[ \t]*import\b\s*(?:\([^)]*\)|[^\n;]*)", regex.M), "java": regex.compile(r"^[ \t]*import\b[^;]*;?", regex.M), "csharp": regex.compile(r"^[ \t]*(?:global\s+)?using\s+(?!var\b)(?![^;=]*\()[^;(]*;", regex.M)}
_PHP_INCLUDE = regex.compile(rf"(?<![\w$>])(?:include|require)(?:_once)?\b[^;\x00]*{_MARK}", regex.I)
_CALL = regex.compile(r"(?<![.\w])(?:require|import|require_relative)\s*\(")
_RUBY_CALL = regex.compile(rf"(?<![.\w])(?:require|require_relative)[ \t]*\(?[ \t]*{_MARK}")
_CALLS_IN = {"python", "javascript", "typescript", "tsx", "c", "cpp", "go", "rust"}


def clean(text: str) -> str:
    return text.strip("'\"`<>")


def imports(text: str, lang: str | None) -> list[str]:
    """What a source text imports, in the order of the text; nothing for an unknown language.

    Known gaps are kept: Rust's use and mod, re-exports, PHP's use, template strings; of a grouped Go import the first.
    """
    if lang not in _SCANNERS:
        return []
    strings, code, at = [], [], 0
    for m in _tokens(text, lang):
        code.append(text[at : m.start()])
        if m.group("c") is not None:
            code.append(" ")
        elif lang in ("javascript", "typescript", "tsx") and m.group()[0] in "`/":
            code.append("``")
        else:
            code.append(f"\x00{len(strings)}\x00")
            strings.append(m.group())
        at = m.end()
    code = "".join([*code, text[at:]])
    found: list[tuple[int, int, str]] = []
    add = lambda at, spec: found.append((at, len(found), spec))
    string = lambda i: clean(strings[int(i)].lstrip("rbuRBUfF$@") if lang in ("python", "csharp") else strings[int(i)])
    taken: list[tuple[int, int]] = []
    if lang == "python":
        joined = regex.sub(r"\\\n", "  ", code)
        for m in _PY_IMPORT.finditer(joined):
            names = lambda part: [n for item in part.strip("()").split(",") for n in regex.split(r"\s+as\s+", item.strip()) if n]
            if m.group("names"):
                for n in names(m.group("names")):
                    add(m.start(), n.strip())
            else:
                module = "".join(m.group("module").split())
                if module.strip("."):
                    add(m.start(), module)
                else:
                    for n in names(m.group("what")):
                        if n.strip() != "*" and module:
                            add(m.start(), module + n.strip())
        code = joined
    elif lang in ("javascript", "typescript", "tsx"):
        for m in _JS_IMPORT.finditer(code):
            taken.append(m.span())
            add(m.start(), m.group("name") or string(m.group(1)))
    elif lang in ("c", "cpp"):
        for m in _INCLUDE.finditer(code):
            s = regex.search(_MARK, m.group("rest"))
            if s and not {"<", ">"} <= set(m.group("rest") + strings[int(s.group(1))]):
                add(m.start(), string(s.group(1)))
    elif lang in _DECLARED:
        for m in _DECLARED[lang].finditer(code):
            taken.append(m.span())
            if s := regex.search(_MARK, m.group()):
                add(m.start(), strings[int(s.group(1))][1:-1])
            else:
                words = m.group().strip().removeprefix("import").removeprefix("using").strip().rstrip(";").split()
                if words:
                    add(m.start(), words[0].rstrip(";"))
    elif lang == "php":
        for m in _PHP_INCLUDE.finditer(code):
            add(m.start(), string(m.group(1)))
    if lang == "ruby":
        for m in _RUBY_CALL.finditer(code):
            add(m.start(), string(m.group(1)))
    elif lang in _CALLS_IN:
        for m in _CALL.finditer(code):
            if any(a <= m.start() < b for a, b in taken):
                continue
            depth, i = 1, m.end()
            while i < len(code) and depth:
                depth += (code[i] == "(") - (code[i] == ")")
                i += 1
            if s := regex.search(_MARK, code[m.end() : i]):
                add(m.start(), string(s.group(1)))
    return [spec for _, _, spec in sorted(found)]


def alias_patterns(text: str) -> list[list[str]] | None:
    """Pattern, first target and baseUrl of each alias of a tsconfig or jsconfig; None if it can't be parsed or has other types."""

    def constant(name: str):
        raise ValueError(name)

    try:
        found = json.loads(text, parse_constant=constant)
        options = found.get("compilerOptions") or {} if isinstance(found, dict) and isinstance(found.get("compilerOptions"), dict | None) else None
        base, paths = options.get("baseUrl"), options.get("paths")
        if not isinstance(base, str | None) or not isinstance(paths, dict | None) or not all(isinstance(v, list) and all(isinstance(x, str) for x in v) for v in (paths or {}).values()):
            return None
        out = [[k, v[0], base or "."] for k, v in (paths or {}).items() if v]
        "".join(x for p in out for x in p).encode()
        return out
    except (ValueError, AttributeError, RecursionError):
        return None
