"""Selection, cleaning, tracing and packing on small trees and literals."""

import os
import random
import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packloom.functions import globs, syntax, udfs
from packloom.functions import text as X
from packloom.operators import packing, selection, tracing
from packloom.plans import engine
from packloom.sources import tree

PLAIN = tree.Config()


def made(root, files):
    for name, body in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body if isinstance(body, bytes) else body.encode())
    return str(root)


def packed(spark, root, files, entry=None, **options):
    at = made(root, files)
    return engine.pack(spark, os.path.join(at, entry) if entry else at, mode="trace" if entry else "scan", config=options.pop("config", PLAIN), **options)


#: Entry, files, and those that the trace reaches beside the entry.
TRACES = [
    ("run.py", {"run.py": "def f():\n    from paint import dip\n", "paint.py": "", "other.py": ""}, ["paint.py"]),
    ("run.py", {"run.py": "import art.ink as i\n", "art/ink.py": "from .pen import nib\n", "art/pen.py": "", "pen.py": ""}, ["art/ink.py", "art/pen.py"]),
    ("run.py", {"run.py": "from . import hue\n", "hue.py": "import run\n"}, ["hue.py"]),
    ("run.py", {"run.py": "import json, sys\nfrom ..up import x\n", "up.py": ""}, []),
    ("run.js", {"run.js": "let a = require('./a'), b;\n", "a.js": "export * from './no';\nimport './b.js';\n", "b.js": "", "no.js": ""}, ["a.js", "b.js"]),
    ("run.js", {"run.js": "if (1) import('./late.js');\n", "late.js": ""}, ["late.js"]),
    ("run.js", {"run.js": "import Vue from 'vue';\n"}, []),
    ("run.ts", {"run.ts": "import type { T } from './t';\nimport { u } from './u';\n", "t.ts": "", "u/index.tsx": ""}, ["t.ts", "u/index.tsx"]),
    ("run.go", {"run.go": 'package run\n\nimport (\n\tp "./plot"\n)\n', "plot/plot.go": "", "plot/more.go": ""}, ["plot/plot.go"]),
    ("Run.java", {"Run.java": "package a;\nimport org.dye.Vat;\n", "org/dye/Vat.java": ""}, ["org/dye/Vat.java"]),
    ("run.c", {"run.c": '#include <stdlib.h>\n#include "rim.h"\n', "rim.h": "", "rim.c": "", "stdlib.h": ""}, ["rim.h"]),
    ("run.c", {"run.c": '#include "sub/rim.h"\n', "sub/rim.h": '#include "edge.h"\n', "sub/edge.h": "", "edge.h": ""}, ["sub/rim.h", "sub/edge.h"]),
    ("run.cpp", {"run.cpp": '#include <vector>\n#include "rim.hpp"\n', "rim.hpp": ""}, ["rim.hpp"]),
    ("Run.cs", {"Run.cs": "using Dye.Vat;\nclass Run {}\n", "Dye/Vat.cs": ""}, ["Dye/Vat.cs"]),
    ("run.rb", {"run.rb": "require './vat'\n", "vat.rb": ""}, ["vat.rb"]),
    ("run.rb", {"run.rb": "require_relative './dye/vat'\n", "dye/vat.rb": ""}, ["dye/vat.rb"]),
    ("run.php", {"run.php": "<?php\ninclude_once './a.php';\nif (1) { require './b.php'; }\n?>\ninclude './no.php';\n", "a.php": "", "b.php": "", "no.php": ""}, ["a.php", "b.php"]),
]


@pytest.mark.parametrize("entry,files,reached", TRACES)
def test_trace(spark, tmp_path, entry, files, reached):
    files = {"setup.py": "", **files}  # a project's root, so that nothing above the folder is listed
    at = made(tmp_path, files)
    got = [r.path[len(at) + 1 :] for r in engine.trace(spark, str(tmp_path / entry), str(tmp_path)).orderBy("seq").collect()]
    assert got == sorted([entry, *reached], key=lambda p: p.split("/"))


def test_trace_follows_aliases(spark, tmp_path):
    config = '{"compilerOptions": {"baseUrl": "web", "paths": {"@/*": ["src/*"], "@/lib/*": ["lib/*"], "none": []}}}'
    files = {"package.json": "{}", "tsconfig.json": config, "app/tsconfig.base.json": "{ // no JSON\n}", "app/main.ts": "import { a } from '@/a';\nimport b from '@/lib/b';\nimport c from 'plain';\n", "web/src/a.ts": "import '@/d';\n", "web/lib/b/index.ts": "", "web/src/lib/b.ts": "", "web/src/d.tsx": "", "plain.ts": "", "app/x.py": ""}
    at = made(tmp_path, files)
    want = ["app/main.ts", "plain.ts", "web/lib/b/index.ts", "web/src/a.ts", "web/src/d.tsx"]
    assert [r.path[len(at) + 1 :] for r in engine.trace(spark, f"{at}/app/main.ts").orderBy("seq").collect()] == want


def test_trace_looks_in_the_file_system(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    files = {".gitignore": "made.py\n", "app/main.py": "import pkg.helper\nimport made\nimport target.gen\n", "pkg/helper.py": "", "made.py": "", "target/gen.py": "", "unused.py": ""}
    files |= {"web/tsconfig.base.json": '{"compilerOptions": {"paths": {"@/*": ["lib/*"]}}}', "web/app/package.json": "{}", "web/app/main.ts": "import '@/a';\nimport './b';\n", "web/lib/a.ts": "", "web/lib/b.ts": ""}
    at = made(tmp_path, files)
    os.symlink(f"{at}/web/lib/b.ts", f"{at}/web/app/b.ts")
    got = lambda entry: [r.path[len(at) + 1 :] for r in engine.trace(spark, f"{at}/{entry}").orderBy("seq").collect()]
    assert got("app/main.py") == ["app/main.py", "made.py", "pkg/helper.py", "target/gen.py"]
    assert got("web/app/main.ts") == ["web/app/main.ts", "web/lib/a.ts", "web/lib/b.ts"]


def test_alias_patterns():
    assert syntax.alias_patterns('{"compilerOptions": {"paths": {"a": ["b", "c"], "d": []}}}') == [["a", "b", "."]]
    assert [syntax.alias_patterns(t) for t in ("{}", '{"compilerOptions": null}')] == [[], []]
    assert [syntax.alias_patterns(t) for t in ("[]", "{,}", '{"compilerOptions": {"baseUrl": 1}}', '{"compilerOptions": {"paths": {"a": "b"}}}')] == [None] * 4


def test_scan_ignores_and_filters(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    doc, stats = packed(spark, tmp_path, {".gitignore": "ignored.txt\n", "main.py": "print('hello')\n", "ignored.txt": "no", "data.bin": b"\x00\x01", "big.txt": "x" * (1 << 20) + "x", "fits.txt": "y" * (1 << 20), "a.lock": "", "a.min.js": "", "bad.txt": b"\xff\xfe\xfa", "target/t.py": ""})
    names = [x.split("`")[1].rpartition("/")[2] for x in doc.split("\n") if x.startswith("### File:")]
    assert names == [".gitignore", "fits.txt", "main.py"]
    assert (stats["files"], stats["skipped"], stats["truncated"]) == (3, 3, False)


def test_minify_redact_budget(spark, tmp_path):
    files = {"paint.rs": '// gone\nfn hue(n: u8) -> u8 { n / 2 }   \n\n\nstatic SECRET_KEY: &str = "0123456789abcdefghij-_";\nstatic API_KEY: &str = "brief";\n'}
    files |= {"keys.py": 'TOKEN = "ghp_0a1b2c3d4e5f6a7b8c9d"\nmy_password: str = \'long.enough.to.hide\'\n'}
    doc, stats = packed(spark, tmp_path, files, minify=True)
    assert "gone" not in doc and "fn hue(n: u8) -> u8 { n / 2 }\nstatic [REDACTED_SECRET];\n" in doc and '"brief"' in doc
    assert doc.count("[REDACTED_SECRET]") == 3 and "ghp_" not in doc and "long.enough" not in doc
    doc, stats = packed(spark, tmp_path, {}, config=tree.Config(max_output_mb=0))
    assert stats["truncated"] and stats["files"] == 0 and doc == packing.HEADER + packing.TRAILER


def test_sinks(spark, tmp_path, monkeypatch, capsys):
    files, out, spare, got = {"a.py": "x\r\n", "b/c.py": "é\n", "b.py": ""}, tmp_path / "out.md", tmp_path / "spare.md", []
    def broken(text):
        raise OSError("no clipboard")
    doc, stats = packed(spark, tmp_path / "t", files, output=str(out))
    assert out.read_bytes().decode() == doc and stats["output_bytes"] == len(doc.encode())
    packed(spark, tmp_path / "t", files, sink=got.append, fallback=str(spare))
    assert got == [doc] and not spare.exists()
    packed(spark, tmp_path / "t", files, sink=broken, fallback=str(spare))
    assert spare.read_bytes().decode() == doc and "no clipboard" in capsys.readouterr().err
    monkeypatch.setattr(packing, "MAX_ROW_BYTES", 10)
    out.unlink()
    assert packed(spark, tmp_path / "t", files, output=str(out)) == (None, stats) and out.read_bytes().decode() == doc
    with pytest.raises(ValueError):
        packed(spark, tmp_path / "t", files)


def test_walk_obeys_rules_above_the_root(spark, tmp_path):
    (tmp_path / ".git/info").mkdir(parents=True)
    made(tmp_path, {".git/info/exclude": "*.log\n", ".gitignore": "/sub/no.py\n*.tmp\nout/\n", "sub/.gitignore": "!keep.tmp\n", ".ignore": "never.py\n"})
    at = made(tmp_path / "sub", {"no.py": "", "yes.py": "", "a.log": "", "b.tmp": "", "keep.tmp": "", "out/x.py": "", "deep/no.py": "", "deep/never.py": "", "deep/out": "", "a/1.py": "", "b.py": "", "c.py": ""})
    want = [".gitignore", "a/1.py", "b.py", "c.py", "deep/no.py", "deep/out", "keep.tmp", "yes.py"]
    assert [p[len(at) + 1 :] for p, _ in tree.walk(at)] == want
    listed = tree.scan_tree(spark, at)
    assert [r.path[len(at) + 1 :] for r in listed.orderBy("seq").collect()] == want and listed.rdd.getNumPartitions() == 5
    assert [p for p, _ in tree.walk(f"{at}/yes.py")] == [f"{at}/yes.py"] and tree.walk(f"{at}/out/..")[0][0].endswith(".gitignore")
    (tmp_path / "empty").mkdir()
    assert tree.scan_tree(spark, str(tmp_path / "empty")).collect() == []


def test_nothing_selected_and_dry_run(spark, tmp_path):
    assert packed(spark, tmp_path, {"a.lock": ""}) == (None, None)
    assert {r.name: r.skip_reason for r in engine.select(spark, made(tmp_path, {"b.py": "", "c.csv": ""}), config=tree.Config(global_ignore=["*.csv"])).collect()} == {"a.lock": "name", "b.py": None}


def test_change_set(spark, tmp_path):
    made(tmp_path, {".gitignore": "ignored.txt\n", "tracked.py": "print(1)\n"})
    for c in (["init", "-q"], ["add", "."], ["-c", "user.name=a", "-c", "user.email=a@b", "commit", "-qm", "x"]):
        subprocess.run(["git", *c], cwd=tmp_path, check=True)
    made(tmp_path, {"tracked.py": "print(2)\n", "new.py": "n\n", "ignored.txt": "i"})
    doc, _ = engine.pack(spark, str(tmp_path), mode="diff", config=PLAIN)
    assert [x for x in doc.split("\n") if x.startswith("###")] == ["### File: `tracked.py`", "### File: `new.py`"] and "print(2)" in doc


def test_config(tmp_path):
    (tmp_path / ".packloomrc").write_text("default_minify = true\nglobal_ignore = ['*.csv']\n")
    assert tree.load_config(str(tmp_path)) == tree.Config(True, ["*.csv"], None)
    (tmp_path / ".packloomrc").write_text("= bad")
    assert tree.load_config(str(tmp_path)) == tree.Config()


def test_globs():
    assert [globs.normalize(p) for p in ("*.csv", "**/*.json", "/foo.tmp", "dir/*.log")] == ["**/*.csv", "**/*.json", "foo.tmp", "dir/*.log"]
    assert globs.to_regex("a{b") is None and globs.to_regex("[a") is None


@pytest.mark.parametrize("lang,source,left", [
    ("rust", "/// docs\nfn f() { /* a /* b */ c */ g('\"', \"// s\", r#\"// r\"#) }", "\nfn f() {  g('\"', \"// s\", r#\"// r\"#) }"),
    ("javascript", "a = /\\/\\//; // c\nb = `// t`", "a = /\\/\\//; \nb = `// t`"), ("python", 's = """# no"""  # yes\n', 's = """# no"""  \n'),
    ("csharp", 'a = @"c:\\"; // x', 'a = @"c:\\"; '), ("go", "a := `// r` // c", "a := `// r` "), ("ruby", "a = \"#{b}\" # c\n=begin\nx\n=end\n", 'a = "#{b}" \n\n'), ("php", "# html\n<?php # c\n$a = '# s'; ?> // t", "# html\n<?php \n$a = '# s'; ?> // t"),
])
def test_comments(lang, source, left):
    assert syntax.strip_comments(source, lang) == left


@pytest.mark.parametrize("lang", syntax.PLAIN)
def test_comments_in_spark_are_those_of_the_scanner(spark, lang):
    rng, ext = random.Random(3), {"python": "py", "csharp": "cs"}.get(lang, lang)
    bits = ["\"", "'", "`", "\\", "\n", "/", "*", "//", "/*", "*/", "#", '"""', "'''", "@\"", '""', "r", "x", " ", "é", "$"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ['"' + "a\\n" * 200_000 + '" # x', "/*" + "y" * 300_000, "# " + "z\\" * 100_000, None]
    d = spark.createDataFrame(list(enumerate(texts)), "i long, text string").withColumn("ext", F.lit(ext))
    got = [r[0] for r in d.orderBy("i").select(udfs.strip_comments(F.col("text"), F.col("ext"))).collect()]
    assert got == [None if t is None else syntax.strip_comments(t, lang) for t in texts]


def test_ranks_over_partitions(spark):
    rng = random.Random(4)
    paths = [f"{rng.choice('abc')}/{rng.choice(['x', 'x-y', 'x.z'])}/{i}" for i in range(500)] + ["a/x", "a", "", "b/x/1", "b/x/1"]
    got = tracing.ranked(spark.createDataFrame([(p,) for p in paths], "path string").repartition(7), "nth", 1).orderBy("nth").collect()
    assert [r.path for r in got] == sorted(paths, key=lambda p: p.split("/")) and [r.nth for r in got] == list(range(1, len(paths) + 1))
    assert tracing.ranked(spark.createDataFrame([], "path string")).collect() == []


def test_reachable_over_many_levels(spark, monkeypatch):
    monkeypatch.setattr(tracing, "MAX_LEVELS", 3)
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(9, 3), (0, 5), (20, 21), (4, None)], "src long, dst long")
    got = {r.node: r.depth for r in tracing.reachable(spark.createDataFrame([(0,), (0,)], "node long"), edges).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 2, 7: 3, 8: 4, 9: 5}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\r\n\x0b\u00a0\u0085\u2028\u3000\u200b\u00e9", max_size=30), max_size=5))
def test_minify_matches_python(texts):
    from pyspark.sql import SparkSession

    space = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
    want = ["\n".join(y for x in t.split("\n") if (y := x.rstrip(space))) for t in texts]
    spark = SparkSession.getActiveSession() or SparkSession.builder.master("local[2]").getOrCreate()
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(X.minify(F.col("t"))).collect()]
    assert got == want


def test_minify_uses_few_examples(spark):
    assert spark.createDataFrame([("fn a() {}\n   \n\nfn b() {}   \n",)], "t string").select(X.minify(F.col("t"))).first()[0] == "fn a() {}\nfn b() {}"


def test_budget_edges(spark):
    rows = packing.sized(spark.createDataFrame([(0, "a", "x", "12345"), (1, "b", "x", "é")], "seq long, path string, ext string, processed string"))
    at = lambda n: [r.included for r in packing.with_budget(rows, n).orderBy("seq").collect()]
    assert (at(27), at(26), at(24)) == ([True, True], [True, False], [False, False])


def test_skip_reasons(spark):
    rows = spark.createDataFrame([(p, n) for p, n in (("a", 1 << 20), ("b", (1 << 20) + 1), ("x-lock.json", 1), ("p.PNG", 1), ("p.png", 1), ("a.min", 1), ("docs/q.md", 1))], "path string, size long")
    got = {r.path: r.skip_reason for r in selection.partition(rows, patterns=["docs/**", "[bad"]).collect()}
    assert got == {"a": None, "b": "size", "x-lock.json": "name", "p.PNG": None, "p.png": "name", "a.min": None, "docs/q.md": "ignored"}
    assert {r.path for r in selection.partition(rows, patterns=["docs/**"], no_limit=True).collect() if r.skip_reason} == {"docs/q.md"}


def test_trace_of_long_chains(spark, monkeypatch):
    """A path of any length takes few joins; depths are those of a search level by level, also with chains, cycles and branches."""
    made = []
    monkeypatch.setattr(tracing, "cut", lambda df, f=tracing.cut: made.append(1) or (f(df) if len(made) < 200 else pytest.fail("a join a node")))
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(1500)] + [(1500, 900), (700, 2000), (2000, 1400), (5, 3000), (3000, 3001), (3001, 6), (4000, 4001)]
    loops = [(i, (i * 7 + 1) % 3001) for i in range(3001)]
    wide = [(rng.randrange(400), rng.randrange(400)) for _ in range(380)] + [(i, i + 1) for i in range(60)]
    for edges in (chain, loops, wide):
        after, want, line = {}, {0: 0}, [0]
        for a, b in edges:
            after.setdefault(a, []).append(b)
        for a in line:
            for b in after.get(a, []):
                if b not in want:
                    want[b] = want[a] + 1
                    line.append(b)
        got = tracing.reachable(spark.createDataFrame([(0,)], "node long"), spark.createDataFrame(edges, "src long, dst long")).collect()
        assert len(got) == len(want) and {r.node: r.depth for r in got} == want
        assert got[0].asDict().keys() == {"node", "depth"}
        made.clear()
