"""The operators on the tables, as queries over virtual files made of documents, with the same in SQL."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packloom.functions import text as X
from packloom.functions import udfs
from packloom.operators import packing, resolving, selection, snapshots, tracing
from packloom.sources import tree

LIMIT = 8192
BUDGET = 200_000
EXTS = ("py", "rs", "js", "min.js", "svg", "lock", "txt", "go")
PATTERNS = ("src1/**", "*.txt", "src[23]/**/f?.py")

# --- virtual files


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, EXTS)), (F.col("doc_id") % len(EXTS) + 1).cast("int"))
    return d.select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/f"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), F.octet_length("text").cast("long").alias("size"), "text")


V = f"""v as (select doc_id, source, lang, source || '/' || lang || '/f' || doc_id || '.' || ([{', '.join(repr(e) for e in EXTS)}])[doc_id % {len(EXTS)} + 1] as path, strlen(text) as size, text from documents),
f as (select *, string_split(path, '/')[-1] as name, case when regexp_matches(string_split(path, '/')[-1], '^.+\\.[^.]*$') then regexp_extract(string_split(path, '/')[-1], '^.+\\.([^.]*)$', 1) else '' end as ext,
 regexp_replace(string_split(path, '/')[-1], '^(.+)\\.[^.]*$', '\\1') as stem from v)"""
SKIP = f"case when size > {LIMIT} then 'size' when name like '%.lock' or name like '%-lock.json' or ext in ('svg', 'png', 'jpg', 'woff2') or stem like '%.min' then 'name' when {{ignored}} then 'ignored' end"
IGNORED = "(regexp_matches(path, '^src1/.*$') or regexp_matches(name, '^src1/.*$') or regexp_matches(path, '^(?:.*/)?.*\\.txt$') or regexp_matches(path, '^src[23]/(?:.*/)?f.\\.py$'))"
REASON = SKIP.format(ignored=IGNORED)
LANG = "case when ext = 'py' then 'python' when ext in ('js', 'jsx') then 'javascript' when ext = 'ts' then 'typescript' when ext = 'tsx' then 'tsx' when ext = 'rs' then 'rust' when ext = 'go' then 'go' when ext in ('c', 'h') then 'c' when ext in ('cpp', 'cc', 'cxx', 'hpp') then 'cpp' when ext = 'java' then 'java' when ext = 'cs' then 'csharp' when ext = 'rb' then 'ruby' when ext = 'php' then 'php' end"
REDACT = r"""regexp_replace({}, '(?i)(api[_-]?key|secret|password|token|sk-ant-api|ghp_).*?[''\x22][A-Za-z0-9\-_\.]{{16,}}[''\x22]', '[REDACTED_SECRET]', 'g')"""
SPACE = r"[\t\n\v\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$"
MINIFY = "array_to_string(list_filter(list_transform(string_split(@text, chr(10)), lambda x: regexp_replace(x, '" + SPACE + "', '')), lambda x: x <> ''), chr(10))"
KEYED = """text || chr(10) || 'API_KEY = "' || md5(text) || '"'"""
SPACED = "replace(text, '. ', '.' || chr(9) || ' ' || chr(10) || chr(10) || chr(160) || chr(10))"
QUERIES, ORACLES = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _parts(spark, sf_dir):
    return selection.with_parts(files(spark, sf_dir))


# --- scalar functions and filters


@query(f"with {V} select doc_id, name, ext, stem from f")
def path_parts(spark, sf_dir):
    return _parts(spark, sf_dir).select("doc_id", "name", "ext", "stem")


@query(f"with {V} select doc_id, ext, {LANG} as language from f")
def lang_of_ext(spark, sf_dir):
    return _parts(spark, sf_dir).select("doc_id", "ext", X.language(F.col("ext")).alias("language"))


@query(f"with {V} select doc_id from f where size <= {LIMIT}")
def filter_size(spark, sf_dir):
    return files(spark, sf_dir).where(F.col("size") <= LIMIT).select("doc_id")


@query(f"with {V} select doc_id from f where not (name like '%.lock' or name like '%-lock.json' or ext in ('svg', 'png', 'jpg', 'woff2') or stem like '%.min')")
def filter_name(spark, sf_dir):
    return _parts(spark, sf_dir).where(~selection.named_out()).select("doc_id")


@query(f"with {V}, g as (select doc_id, case doc_id % 3 when 0 then 'target/' || path when 1 then 'a/.git/' || path else 'targets/' || path end as path from f) select doc_id, path from g where not list_has_any(string_split(path, '/'), ['.git', 'target'])")
def filter_components(spark, sf_dir):
    d = files(spark, sf_dir)
    head = F.when(F.col("doc_id") % 3 == 0, "target/").when(F.col("doc_id") % 3 == 1, "a/.git/").otherwise("targets/")
    return d.select("doc_id", F.concat(head, "path").alias("path")).where(~selection.in_excluded_component(F.col("path")))


@query(f"with {V} select doc_id, {IGNORED} as ignored from f")
def filter_ignore_glob(spark, sf_dir):
    return _parts(spark, sf_dir).select("doc_id", selection.ignored(list(PATTERNS)).alias("ignored"))


OVERRIDES = ("/src1", "en/*.py", "src[23]/**/f?.rs", "*.lock")


@query(f"with {V} select doc_id from f where not (regexp_matches(path, '^src1(/|$)') or regexp_matches(path, '^en/[^/]*[.]py$') or regexp_matches(path, '^src[23]/(.*/)?f[^/][.]rs$') or regexp_matches(path, '^(.*/)?[^/]*[.]lock$'))")
def filter_overrides(spark, sf_dir):
    """Patterns that prune a walk: a star stops at "/", and what lies below an excluded folder goes."""
    return files(spark, sf_dir).where(~selection.overridden(list(OVERRIDES))).select("doc_id")


_GLOBS = ("*.csv", "**/*.json", "/foo.tmp", "dir/*.log", "//x", "  *.a ")


@query("select p as pattern, case when starts_with(trim(p), '/') then ltrim(trim(p), '/') when starts_with(trim(p), '**') or contains(trim(p), '/') then trim(p) else '**/' || trim(p) end as normalized from (values ('*.csv'), ('**/*.json'), ('/foo.tmp'), ('dir/*.log'), ('//x'), ('  *.a ')) t(p)")
def glob_normalize(spark, sf_dir):
    return spark.createDataFrame([(g,) for g in _GLOBS], "pattern string").withColumn("normalized", X.normalize_glob(F.col("pattern")))


_NUL = "case doc_id % 10 when 0 then chr(0) || 'x' when 1 then repeat('x', 1023) || chr(0) when 2 then repeat('x', 1024) || chr(0) else 'plain' end"


@query(f"select doc_id, contains(substring({_NUL}, 1, 1024), chr(0)) as is_binary from documents")
def filter_binary(spark, sf_dir):
    content = F.expr("concat(case doc_id % 10 when 0 then concat(x'00', cast('x' as binary)) when 1 then concat(cast(repeat('x', 1023) as binary), x'00') when 2 then concat(cast(repeat('x', 1024) as binary), x'00') else cast('plain' as binary) end, cast(text as binary))")
    return _table(spark, sf_dir, "documents").select("doc_id", X.is_binary(content).alias("is_binary"))


@query("select doc_id, md5(text) as digest from documents where doc_id % 4 <> 0")
def utf8_filter(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").withColumn("content", F.when(F.col("doc_id") % 4 == 0, F.concat(F.col("text").cast("binary"), F.lit(b"\xff"))).otherwise(F.col("text").cast("binary")))
    return selection.readable(d.drop("text")).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"with {V} select doc_id, {REASON} as skip_reason from f")
def select_partition(spark, sf_dir):
    return selection.partition(files(spark, sf_dir), LIMIT, list(PATTERNS)).select("doc_id", "skip_reason")


@query(f"with {V} select path, count(*) over () as selected from f where {REASON} is null")
def dry_run(spark, sf_dir):
    kept = selection.partition(files(spark, sf_dir), LIMIT, list(PATTERNS)).where("skip_reason is null")
    return kept.select("path").crossJoin(kept.agg(F.count(F.lit(1)).alias("selected")))


@query(f"select doc_id, md5({REDACT.format(KEYED)}) as digest from documents")
def redact_secrets(spark, sf_dir):
    keyed = F.concat("text", F.lit('\nAPI_KEY = "'), F.md5(F.col("text").cast("binary")), F.lit('"'))
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(X.redact_secrets(keyed).cast("binary")).alias("digest"))


def _spaced():
    return F.replace(F.col("text"), F.lit(". "), F.lit(".\t \n\n \n"))


@query(f"select doc_id, md5({MINIFY.replace("@text", SPACED)}) as digest from documents")
def minify_code(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(X.minify(_spaced()).cast("binary")).alias("digest"))


@query("select doc_id, strlen(text) // 4 as tokens from documents")
def count_tokens(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", X.count_tokens(F.col("text")).alias("tokens"))


_QUOTES = "select doc_id, (['''', '\"', '`', '<', '<''\"'])[doc_id % 5 + 1] || source || ([ '''', '\"', '`', '>', '\"''>'])[doc_id % 5 + 1] as raw from documents"


@query(f"select doc_id, trim(raw, '''\"`<>') as cleaned from ({_QUOTES})")
def clean_import_text(spark, sf_dir):
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("doc_id") % 5 + 1).cast("int"))
    raw = F.concat(pick("'", '"', "`", "<", "<'\""), "source", pick("'", '"', "`", ">", "\"'>"))
    return _table(spark, sf_dir, "documents").select("doc_id", X.clean_import(raw).alias("cleaned"))


_ALIASES = (("@/a/b", "@/*", "src/*"), ("x", "x", "lib/x"), ("xy", "x", "lib/x"), ("@a.ts", "@*.ts", "t/*/*"), ("@.t", "@.*.t", "q"), ("a*b", "*a*", "z"))


@query("select * from (values ('@/a/b', '@/*', 'src/a/b'), ('x', 'x', 'lib/x'), ('xy', 'x', null), ('@a.ts', '@*.ts', 't/a/a'), ('@.t', '@.*.t', null), ('a*b', '*a*', null)) t(spec, pattern, resolved)")
def alias_pattern(spark, sf_dir):
    d = spark.createDataFrame(_ALIASES, "spec string, pattern string, target string")
    return d.select("spec", "pattern", X.alias_target(F.col("spec"), F.col("pattern"), F.col("target")).alias("resolved"))


@query(f"with {V} select doc_id, md5('### File: `' || path || '`' || chr(10) || '```' || ext || chr(10) || text || chr(10) || '```' || chr(10) || chr(10)) as digest from f")
def render_block(spark, sf_dir):
    return _parts(spark, sf_dir).select("doc_id", F.md5(X.render_block(F.col("path"), F.col("ext"), F.col("text")).cast("binary")).alias("digest"))


# --- comments


@query("""select doc_id, md5(replace(text, '. ', '." " ')) as digest from documents""")
def strip_comments_c(spark, sf_dir):
    """Comments of both kinds put behind sentences go; those in strings stay."""
    source = F.concat(F.replace(F.col("text"), F.lit(". "), F.lit('." " /* a\n// b */')), F.lit("// end"))
    d = _table(spark, sf_dir, "documents").select("doc_id", F.replace(F.replace(source, F.lit("'"), F.lit("'")), F.lit("\r"), F.lit("")).alias("text"))
    return d.select("doc_id", F.md5(udfs.strip_comments(F.col("text"), F.lit("c")).cast("binary")).alias("digest"))


@query("""select doc_id, md5('s = "# no"' || chr(10) || md5(text) || ' ' || chr(10)) as digest from documents""")
def strip_comments_py(spark, sf_dir):
    """The whole text, escaped, in a string between comments; what is left of it is hashed in its place."""
    escaped = F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    made = F.concat(F.lit('s = "# no"\n# "a\n"""'), escaped, F.lit('""" # it\'s \'\'\'\n'))
    d = _table(spark, sf_dir, "documents").select("doc_id", udfs.strip_comments(made, F.lit("py")).alias("left"))
    head, tail = 's = "# no"\n\n"""', '""" \n'
    body = F.substring("left", F.lit(len(head) + 1), F.length("left") - len(head) - len(tail))
    body = F.replace(F.replace(body, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    whole = F.col("left").startswith(head) & F.col("left").endswith(tail)
    hashed = F.concat(F.lit('s = "# no"\n'), F.md5(body.cast("binary")), F.lit(" \n"))
    return d.select("doc_id", F.md5(F.when(whole, hashed).cast("binary")).alias("digest"))


#: A language's extension, what stands before and after a string with the whole text, and what is left of both.
COMMENTED = (
    ("py", "#!x 'a\nb = 1  # c\ns = ", "  # it's\n", "\nb = 1  \ns = ", "  \n"),
    ("js", "f(/a'b/); // 'c\ns = ", "; /* x\n' */ t = `// no`", "f(/a'b/); \ns = ", ";  t = `// no`"),
    ("ts", "let a: T; /* \" */ s = ", " // y", "let a: T;  s = ", " "),
    ("tsx", "/** d */ s = ", "// <b/>\nq", " s = ", "\nq"),
    ("rs", "/* a /* ' */ b */ let s = ", "; // c\nr#\"// k\"#", " let s = ", "; \nr#\"// k\"#"),
    ("go", "c := `/* k` // d\ns := ", " /* e\n\" */", "c := `/* k` \ns := ", " "),
    ("c", "char c = '\"'; /* f ' */ s = ", "; // g \\\nh", "char c = '\"';  s = ", "; "),
    ("cpp", "x = R\"z(// k)z\"; // l\ns = ", "; /* m", "x = R\"z(// k)z\"; \ns = ", "; "),
    ("java", "/** n \" */ String s = ", "; // o", " String s = ", "; "),
    ("cs", "p = @\"c:\\\"; // q\ns = ", "; /* r */", "p = @\"c:\\\"; \ns = ", "; "),
    ("rb", "=begin\n' t\n=end\ns = ", " # u", "\ns = ", " "),
    ("php", "# html '\n<?php # v\n$s = ", "; // w ?> // x", "# html '\n<?php \n$s = ", "; ?> // x"),
)
_QUOTED = """'"' || translate(text, '"\\#' || chr(10), '    ') || '"'"""


def _sql(text):
    return "'" + text.replace("'", "''") + "'"


@query(f"with c as (select * from (values {', '.join(f'({i}, {_sql(x[0])}, {_sql(x[3])}, {_sql(x[4])})' for i, x in enumerate(COMMENTED))}) t(i, ext, head, tail)) select doc_id, ext, md5(head || {_QUOTED} || tail) as digest from documents join c on c.i = doc_id % {len(COMMENTED)}")
def strip_comments_languages(spark, sf_dir):
    """Every language of the scanner: comments before and behind a string that holds the whole text."""
    pick = lambda n: F.element_at(F.array(*[F.lit(x[n]) for x in COMMENTED]), (F.col("doc_id") % len(COMMENTED) + 1).cast("int"))
    quoted = F.concat(F.lit('"'), F.translate("text", '"\\#\n', "    "), F.lit('"'))
    d = _table(spark, sf_dir, "documents").select("doc_id", pick(0).alias("ext"), F.concat(pick(1), quoted, pick(2)).alias("text"))
    return d.select("doc_id", "ext", F.md5(udfs.strip_comments(F.col("text"), F.col("ext")).cast("binary")).alias("digest"))


@query("select page_id, strlen(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')) as n_bytes from pages")
def strip_comments_html(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.octet_length(X.strip_html_comments(F.col("html"))).cast("long").alias("n_bytes"))


@query("""with r as (select l_orderkey as k, l_linenumber * 10 as s, l_linenumber * 10 + l_quantity::int as e from lineitem),
m as (select *, max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding) as upto from r),
i as (select *, sum(case when upto is null or s > upto then 1 else 0 end) over (partition by k order by s, e rows unbounded preceding) as island from m)
select k, min(s) as start, max(e) as "end" from i group by k, island""")
def merge_ranges(spark, sf_dir):
    r = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).alias("end"))
    return packing.merge_ranges(r, "k")


# --- packing

_PROC = REDACT.format("text")
_RUN = f"""{V}, k as (select *, row_number() over (order by string_split(path, '/')) - 1 as seq from f where {REASON} is null),
p as (select *, {_PROC} as processed from k), c as (select *, strlen(processed) as nbytes, (20 + sum(strlen(processed)) over (order by seq rows unbounded preceding))::bigint as cum_bytes from p),
b as (select *, cum_bytes <= {BUDGET} as included, '### File: `' || path || '`' || chr(10) || '```' || ext || chr(10) || processed || chr(10) || '```' || chr(10) || chr(10) as block from c),
o as (select '# Codebase Context' || chr(10) || chr(10) || coalesce(string_agg(block, '' order by seq) filter (where included), '') || case when bool_or(not included) then chr(10) || '*Output truncated: reached configured output size limit.*' || chr(10) else '' end as document, bool_or(not included) as truncated, count(*) filter (where included) as files from b)"""


def _budgeted(spark, sf_dir, limit=LIMIT, budget=BUDGET):
    """The files that are kept, their budget and the skipped ones."""
    split = selection.partition(files(spark, sf_dir), limit, list(PATTERNS))
    kept = split.where("skip_reason is null")
    return kept, packing.with_budget(tracing.ranked(packing.sized(packing.process(kept))), budget), split.where("skip_reason is not null")


@query(f"with {_RUN} select doc_id, md5(processed) as digest from b")
def process_file(spark, sf_dir):
    kept = selection.partition(files(spark, sf_dir), LIMIT, list(PATTERNS)).where("skip_reason is null")
    return packing.process(kept).select("doc_id", F.md5(F.col("processed").cast("binary")).alias("digest"))


_MADE = """text || chr(10) || {} || 'API_KEY = "' || md5(text) || '"  ' || chr(10) || {} || 'end ;'"""


@query(f"select doc_id, md5({MINIFY.replace('@text', REDACT.format(_MADE.format("'  ' || chr(10)", "' '")))}) as digest from documents")
def process_minified(spark, sf_dir):
    """Redaction, then comments, then blank space, in this order: comments with a quote, blank lines and a secret behind the whole text."""
    made = F.concat("text", F.lit('\n// it\'s gone\n  \nAPI_KEY = "'), F.md5(F.col("text").cast("binary")), F.lit('"  \n/* a "\n\n b */ end ;'))
    d = _table(spark, sf_dir, "documents").select("doc_id", F.lit("c").alias("ext"), made.alias("text"))
    return packing.process(d, minify=True).select("doc_id", F.md5(F.col("processed").cast("binary")).alias("digest"))


@query(f"with {_RUN} select seq, path, nbytes, cum_bytes, included from b")
def pack_budget(spark, sf_dir):
    return _budgeted(spark, sf_dir)[1].select("seq", "path", "nbytes", "cum_bytes", "included")


@query(f"with {_RUN} select md5(document) as digest, strlen(document) as n_bytes, truncated from o")
def pack_document(spark, sf_dir):
    d = packing.document(*_budgeted(spark, sf_dir)[:2])
    return d.select(F.md5(F.col("document").cast("binary")).alias("digest"), F.octet_length("document").cast("long").alias("n_bytes"), "truncated")


@query(f"with {_RUN} select files, (select count(*) from f where {REASON} is not null) as skipped, strlen(document) as output_bytes, strlen(document) // 4 as tokens, truncated, strlen(document) // 4 > 100000 as large_payload from o")
def pack_stats(spark, sf_dir):
    return packing.stats(*_budgeted(spark, sf_dir)[1:])


# The same with the limits of a real run, 1 MiB a file and 100 MiB in all.

FULL = (selection.MAX_FILE_BYTES, packing.DEFAULT_MAX_MB << 20)
_FULL_REASON = REASON.replace(f"size > {LIMIT} ", f"size > {FULL[0]} ")
_FULL_RUN = _RUN.replace(REASON, _FULL_REASON).replace(f"<= {BUDGET} ", f"<= {FULL[1]} ")


@query(f"with {_FULL_RUN} select doc_id, md5(processed) as digest from b")
def process_file_full(spark, sf_dir):
    kept = selection.partition(files(spark, sf_dir), FULL[0], list(PATTERNS)).where("skip_reason is null")
    return packing.process(kept).select("doc_id", F.md5(F.col("processed").cast("binary")).alias("digest"))


@query(f"with {_FULL_RUN} select seq, path, nbytes, cum_bytes, included from b")
def pack_budget_full(spark, sf_dir):
    return _budgeted(spark, sf_dir, *FULL)[1].select("seq", "path", "nbytes", "cum_bytes", "included")


@query(f"with {_FULL_RUN} select md5(document) as digest, strlen(document) as n_bytes, truncated from o")
def pack_document_full(spark, sf_dir):
    d = packing.document(*_budgeted(spark, sf_dir, *FULL)[:2])
    return d.select(F.md5(F.col("document").cast("binary")).alias("digest"), F.octet_length("document").cast("long").alias("n_bytes"), "truncated")


@query(f"with {_FULL_RUN} select files, (select count(*) from f where {_FULL_REASON} is not null) as skipped, strlen(document) as output_bytes, strlen(document) // 4 as tokens, truncated, strlen(document) // 4 > 100000 as large_payload from o")
def pack_stats_full(spark, sf_dir):
    return packing.stats(*_budgeted(spark, sf_dir, *FULL)[1:])


@query(f"with {V} select path, row_number() over (order by string_split(path, '/')) as nth from f")
def path_sort(spark, sf_dir):
    return tracing.ranked(files(spark, sf_dir).select("path"), "nth", 1).select("path", "nth")


# --- imports, resolution, tracing

_N = "(select count(*) from documents)"
_NEXT = f"(doc_id * 7 + 1) % {_N}"


def _sources(spark, sf_dir, line, ext, last=""):
    """Made lines before and after the whole text."""
    d = _table(spark, sf_dir, "documents")
    n = d.agg(F.count(F.lit(1)).alias("n"))
    d = d.select("doc_id", F.col("text").alias("body")).crossJoin(F.broadcast(n)).withColumn("to", (F.col("doc_id") * 7 + 1) % F.col("n"))
    return d.select("doc_id", "to", F.concat_ws("\n", F.format_string(line, "to"), "body", F.format_string(last, "to")).alias("text"), F.lit(ext).alias("ext"))


def _imports(spark, sf_dir, line, ext, last=""):
    return _sources(spark, sf_dir, line, ext, last).select("doc_id", F.posexplode(udfs.extract_imports("text", "ext")).alias("ord", "spec"))


@query(f"select doc_id, ord, case ord when 0 then 'pkg.f' || {_NEXT} when 1 then 'alias' else '.g' end as spec from documents, (values (0), (1), (2)) t(ord)")
def imports_py(spark, sf_dir):
    return _imports(spark, sf_dir, "import pkg.f%d as alias  # import no", "py", "from . import g\n'import no'\n")


@query(f"select doc_id, ord, case ord when 0 then './f' || {_NEXT} else 'side' end as spec from documents, (values (0), (1)) t(ord)")
def imports_js(spark, sf_dir):
    return _imports(spark, sf_dir, "import { a } from './f%d';\n// require('no')", "js", "const s = require('side');\n")


@query(f"select doc_id, 0 as ord, 'f' || {_NEXT} || '.h' as spec from documents")
def imports_c(spark, sf_dir):
    return _imports(spark, sf_dir, '#include <stdio.h>', "c", '#include "f%d.h"\n')


#: One program a language: plain, nested, shared, commented out and outside imports.
CORPUS = (
    ("py", "start.py", "import draw.lines as dl, sys  # import no\ndef f():\n    from shapes import box\n'import no'\nfrom . import *\nfrom . import near, far as f2\n"),
    ("js", "start.js", "const a = require('./paint'), b = 1;\nimport z from \"./zoom\";\n// require('./no')\nif (b) { import('./late').then(go); }\n"),
    ("ts", "start.ts", "import type { Tone } from './tones';\nimport fs = require('node:fs');\nconst s = `import './no'`;\n"),
    ("go", "start.go", 'package start\n\nimport g "./grid"\n\nfunc run() { g.Draw() } // import "no"\n'),
    ("java", "Start.java", "import org.tint.Shade; // import no.No;\nclass Start { Shade s; }\n"),
    ("c", "start.c", '#include <math.h>\n/* #include "no.h" */\n#  include "pen.h"\nint tip(void);\n'),
    ("cs", "Start.cs", "using Tint.Wash;\nclass Start { void F() { using (var x = Open()) { } } }\n"),
    ("rb", "start.rb", "require './brush'\nrequire_relative 'ink'\n# require './no'\n"),
    ("php", "start.php", "<?php\nif ($a) { require_once __DIR__ . '/wall.php'; }\ninclude('./roof.php'); # include 'no'\n?> include 'no'\n"),
)
_GOLDEN = """values ('py', 0, 'draw.lines'), ('py', 1, 'dl'), ('py', 2, 'sys'), ('py', 3, 'shapes'), ('py', 4, '.near'), ('py', 5, '.far'), ('py', 6, '.f2'),
('js', 0, './paint'), ('js', 1, './zoom'), ('js', 2, './late'), ('ts', 0, './tones'), ('ts', 1, 'fs'), ('go', 0, './grid'), ('java', 0, 'org.tint.Shade'), ('c', 0, 'pen.h'),
('cs', 0, 'Tint.Wash'), ('rb', 0, './brush'), ('rb', 1, 'ink'), ('php', 0, '/wall.php'), ('php', 1, './roof.php')"""


def _programs(spark):
    return spark.createDataFrame(CORPUS, "corpus string, path string, text string").withColumn("ext", X.extension(F.col("path")))


@query(f"select * from ({_GOLDEN}) t(corpus, ord, spec)")
def imports_golden(spark, sf_dir):
    return _programs(spark).select("corpus", F.posexplode(udfs.extract_imports("text", "ext")).alias("ord", "spec"))


_INVENTORY = ("py/src/draw/lines.py", "py/setup.py", "py/shapes/box.py", "py/shapes/__init__.py", "js/paint/index.jsx", "js/zoom.js", "js/late/late.tsx", "ts/tones.ts", "go/grid/grid.go", "java/src/org/tint/Shade.java", "java/package.json", "c/pen.h", "cs/Tint/Wash/Wash.cs", "cs/.git/HEAD", "rb/brush.rb", "php/roof.php")


@query("""select * from (values ('py', 'draw.lines', 'py/src/draw/lines.py'), ('py', 'shapes', 'py/shapes/__init__.py'), ('js', './paint', 'js/paint/index.jsx'), ('js', './zoom', 'js/zoom.js'), ('js', './late', 'js/late/late.tsx'), ('ts', './tones', 'ts/tones.ts'),
('go', './grid', 'go/grid/grid.go'), ('java', 'org.tint.Shade', 'java/src/org/tint/Shade.java'), ('c', 'pen.h', 'c/pen.h'), ('cs', 'Tint.Wash', 'cs/Tint/Wash/Wash.cs'), ('rb', './brush', 'rb/brush.rb'), ('php', './roof.php', 'php/roof.php')) t(corpus, spec, dst)""")
def resolve_golden(spark, sf_dir):
    d = _programs(spark).withColumn("folder", F.col("corpus"))
    d = d.select("corpus", "folder", F.concat_ws("/", "corpus", "path").alias("path"), "ext", udfs.extract_imports("text", "ext").alias("specs"))
    listed = d.select("corpus", "folder", "path", "ext", "specs").unionByName(spark.createDataFrame([(p,) for p in _INVENTORY], "path string"), allowMissingColumns=True)
    out = resolving.edges(listed, resolving.project_roots(d, listed))
    return out.select(F.split_part("src", F.lit("/"), F.lit(1)).alias("corpus"), "spec", "dst")


@query(f"with {V}, c as (select doc_id, source || '/' || lang || '/f' || (doc_id + 40) as base from f), t as (select doc_id, prio, base || s as dst from c, (values (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.js'), (4, '.jsx')) x(prio, s)) select t.doc_id, arg_min(t.dst, prio) as dst from t join f on f.path = t.dst group by t.doc_id")
def resolve_candidates(spark, sf_dir):
    v = files(spark, sf_dir).select("doc_id", "path", F.regexp_replace("path", r"/[^/]*$", "").alias("folder"))
    wanted = resolving.probes(F.concat(F.col("folder"), F.lit("/f"), (F.col("doc_id") + 40).cast("string")), F.lit("js"))
    return resolving.first_existing(v, v, wanted, ["doc_id"])


@query(f"with {V}, c as (select doc_id, source || '/' || lang as folder, 'f' || (doc_id + 80) as spec from f), t as (select doc_id, 0 as prio, folder || '/' || spec || '.py' as dst from c union all select doc_id, 1, source || '/fr/' || 'f' || (doc_id + 80) || '.py' from f) select t.doc_id, arg_min(t.dst, prio) as dst from t join f on f.path = t.dst group by t.doc_id")
def resolve_imports(spark, sf_dir):
    v = files(spark, sf_dir).select("doc_id", "path", F.regexp_replace("path", r"/[^/]*$", "").alias("folder"))
    root = F.concat(F.regexp_replace("folder", r"/[^/]*$", ""), F.lit("/fr"))
    wanted = F.flatten(F.transform(resolving.bases(F.concat(F.lit("f"), (F.col("doc_id") + 80).cast("string")), F.col("folder"), root, F.lit("py")), lambda b: resolving.probes(b, F.lit("py"))))
    return resolving.first_existing(v, v, wanted, ["doc_id"])


@query("select * from (values ('@/a', 'src/a.ts'), ('@/lib/b', 'lib/b.js'), ('exact', 'src/exact.ts')) t(spec, dst)")
def resolve_alias(spark, sf_dir):
    specs = spark.createDataFrame([("@/a",), ("@/lib/b",), ("exact",), ("none",), ("@x@y",)], "spec string")
    patterns = spark.createDataFrame([("@/*", "src/*"), ("@/lib/*", "lib/*"), ("exact", "src/exact"), ("@*@*", "q")], "pattern string, target string")
    inventory = spark.createDataFrame([("src/a.ts",), ("lib/b.js",), ("src/lib/b.ts",), ("src/exact.ts",), ("q.ts",)], "path string")
    return resolving.resolve_aliases(specs, patterns, inventory, ["spec"])


@query(f"with {V}, d as (select distinct source || '/' || lang as folder, source from f) select folder, case when substr(source, 4)::int % 3 = 0 then folder when substr(source, 4)::int % 3 = 1 then source else folder end as root from d")
def project_root(spark, sf_dir):
    v = files(spark, sf_dir).select("path", F.regexp_replace("path", r"/[^/]*$", "").alias("folder"))
    n = F.substring(F.split_part("folder", F.lit("/"), F.lit(1)), 4, 9).cast("int") % 3
    marks = v.select(F.when(n == 0, F.concat("folder", F.lit("/setup.py"))).when(n == 1, F.concat(F.split_part("folder", F.lit("/"), F.lit(1)), F.lit("/.git/HEAD"))).alias("path")).where("path is not null").distinct()
    return resolving.project_roots(v, v.select("path").unionByName(marks))


@query("select * from (values ('a/b/c', 'a/b/jsconfig.json'), ('a/x', 'a/tsconfig.json')) t(folder, config)")
def tsconfig_nearest(spark, sf_dir):
    folders = spark.createDataFrame([("a/b/c",), ("a/x",), ("z",)], "folder string")
    configs = spark.createDataFrame([("a/tsconfig.json", "{}"), ("a/b/tsconfig.json", "{ bad"), ("a/b/jsconfig.json", '{"compilerOptions": {}}'), ("z/other.json", "{}")], "path string, json string")
    return resolving.nearest_tsconfig(folders, configs)


_BFS = "with recursive e as (select doc_id as src, (doc_id * 7 + 1) % (select count(*) from documents) as dst from documents), r as (select 0::bigint as node union select e.dst from r join e on e.src = r.node)"


@query(f"{_BFS} select node from r")
def trace_bfs(spark, sf_dir):
    e = _sources(spark, sf_dir, "%d", "py").select(F.col("doc_id").alias("src"), F.col("to").alias("dst"))
    return tracing.reachable(spark.range(1).select(F.col("id").alias("node")), e).select("node")


_HOPS = """with recursive s as (select user_id, event_type, lead(user_id) over (order by ts, event_id) as nxt from events),
e as (select distinct user_id as src, nxt as dst from s where event_type = 'error' and nxt is not null),
r as (select min(src) as node, 0 as depth from e union select e.dst, r.depth + 1 from r join e on e.src = r.node where r.depth < 40)"""


@query(f"{_HOPS} select node, min(depth) as depth from r group by node")
def trace_depth(spark, sf_dir):
    s = _table(spark, sf_dir, "events").withColumn("nxt", F.lead("user_id").over(Window.orderBy("ts", "event_id")))
    e = s.where("event_type = 'error' and nxt is not null").select(F.col("user_id").alias("src"), F.col("nxt").alias("dst"))
    return tracing.reachable(e.agg(F.min("src").alias("node")), e)


# --- change sets and trees


@query("with o as (select doc_id, md5(text) as h from documents where doc_id % 7 <> 0), n as (select doc_id, md5(case when doc_id % 5 = 0 then text || '!' else text end) as h from documents where doc_id % 11 <> 0) select coalesce(o.doc_id, n.doc_id)::varchar as path, case when o.h is null then 'added' when n.h is null then 'deleted' else 'modified' end as change from o full join n on o.doc_id = n.doc_id where o.h is distinct from n.h")
def diff_snapshot(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").withColumn("path", F.col("doc_id").cast("string"))
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return snapshots.diff(d.where("doc_id % 7 <> 0").select("path", F.md5(F.col("text").cast("binary")).alias("hash")), d.where("doc_id % 11 <> 0").select("path", F.md5(changed.cast("binary")).alias("hash")))


@query(f"with {V} select 0 as part, path from f where doc_id % 5 = 0 union all select 1, path from f where doc_id % 7 = 0")
def union_ordered(spark, sf_dir):
    v = files(spark, sf_dir)
    return snapshots.in_sequence(v.where("doc_id % 5 = 0").select("path"), v.where("doc_id % 7 = 0").select("path"))


@query(f"with {V} select 0 as part, path from f union all select 1, path from f")
def union_ordered_whole(spark, sf_dir):
    v = files(spark, sf_dir).select("path")
    return snapshots.in_sequence(v, v)


@query()
def scan_tree(spark, sf_dir):
    """A small tree, written by the query: a file system has no SQL."""
    root = tempfile.mkdtemp()
    os.makedirs(f"{root}/.git")
    for name, body in ((".gitignore", "no.txt\n"), ("no.txt", "x"), ("a.py", "print(1)\n"), ("d/b.py", "print(2)\n"), ("target/c.py", "")):
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "w") as f:
            f.write(body)
    return tree.scan_tree(spark, root).select("seq", F.substring("path", len(root) + 2, 99).alias("path"), "size")
