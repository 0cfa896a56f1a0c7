"""Imports to files: candidate paths joined with the inventory, the first that exists wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.functions import text as X
from packloom.functions import udfs

# Fixed values
CANDIDATES = {"py": ("py",), "go": ("go",), "java": ("java",), "cs": ("cs",), "rb": ("rb",), "php": ("php",), "c": ("c", "h"), "h": ("c", "h"), **dict.fromkeys(("cpp", "hpp", "cc", "cxx"), ("cpp", "hpp", "cc", "cxx"))}
OTHER = ("ts", "tsx", "js", "jsx")
INDEXES = {"py": ("__init__.py",)}
OTHER_INDEXES = ("index.ts", "index.tsx", "index.js", "index.jsx")
C_LIKE = ("c", "cpp", "h", "hpp", "cc", "cxx")
MARKERS = ("tsconfig.json", "package.json", "pyproject.toml", "setup.py", "Cargo.toml")
TSCONFIGS = ("tsconfig.json", "tsconfig.base.json", "jsconfig.json")


def _lookup(table: dict, other: tuple, ext: Column) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    return F.coalesce(F.create_map(*pairs)[ext], F.array(*map(F.lit, other)))


def probes(base: Column, ext: Column) -> Column:
    """Paths to try for a base, in order: itself, with an extension, named like its folder inside it, an index inside it."""
    exts, indexes = _lookup(CANDIDATES, OTHER, ext), _lookup(INDEXES, OTHER_INDEXES, ext)
    base = X.fold_path(base)
    return F.concat(F.array(base), F.transform(exts, lambda e: F.concat(base, F.lit("."), e)), F.transform(exts, lambda e: F.concat(base, F.lit("/"), X.file_name(base), F.lit("."), e)), F.transform(indexes, lambda i: F.concat(base, F.lit("/"), i)))


def bases(spec: Column, folder: Column, root: Column, ext: Column) -> Column:
    """Where an import may lead, by its form and language; root is the project's."""
    at = lambda a, b: F.concat_ws("/", a, b)
    dots = F.length(spec) - F.length(F.regexp_replace(spec, r"^\.+", ""))
    module = F.replace(F.regexp_replace(spec, r"^\.+", ""), F.lit("."), F.lit("/"))
    plain = F.translate(spec, ".\\", "//")
    none = F.array().cast("array<string>")
    return (
        F.when(spec.startswith("./") | spec.startswith("../"), F.array(at(folder, spec)))
        .when(ext.isin(*C_LIKE), F.array(at(folder, spec)))
        .when(ext == "py", F.when((dots >= 2) | (module == ""), none).otherwise(F.array(at(folder, module), at(root, module), at(F.concat_ws("/", root, F.lit("src")), module))))
        .otherwise(F.array(at(root, plain), at(F.concat_ws("/", root, F.lit("src")), plain)))
    )


def first_existing(imports: DataFrame, inventory: DataFrame, candidates: Column, keys: list[str]) -> DataFrame:
    """keys and dst: the first of the candidates that the inventory has; imports without one are left out."""
    return _first(imports.select(*keys, F.posexplode(candidates).alias("prio", "dst")), inventory, keys)


def ancestors(folder: Column) -> Column:
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def project_roots(folders: DataFrame, inventory: DataFrame) -> DataFrame:
    """folder and root: the nearest ancestor with a marker file or a .git folder, else the folder itself."""
    parts = F.split(F.col("path"), "/")
    marked = F.when(F.element_at(parts, -1).isin(*MARKERS), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"))
    git = F.when(F.array_position(parts, ".git") > 0, F.array_join(F.slice(parts, 1, F.array_position(parts, ".git").cast("int") - 1), "/"))
    roots = inventory.select(F.explode(F.array_compact(F.array(marked, git))).alias("up")).distinct()
    up = folders.select("folder").distinct().select("folder", F.posexplode(ancestors(F.col("folder"))).alias("depth", "up"))
    best = up.join(roots, "up").groupBy("folder").agg(F.max_by("up", "depth").alias("root"))
    return folders.select("folder").distinct().join(best, "folder", "left").select("folder", F.coalesce("root", "folder").alias("root"))


def nearest_tsconfig(folders: DataFrame, configs: DataFrame) -> DataFrame:
    """folder and path of the nearest valid config: configs has path and json; of one folder the first name that parses wins."""
    name, at = X.file_name(F.col("path")), F.array_join(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), "/")
    valid = configs.where(name.isin(*TSCONFIGS) & F.expr("try_parse_json(json)").isNotNull())
    valid = valid.select(at.alias("up"), "path", F.array_position(F.array(*map(F.lit, TSCONFIGS)), name).alias("nth"))
    up = folders.select("folder").distinct().select("folder", F.posexplode(ancestors(F.col("folder"))).alias("depth", "up"))
    return up.join(valid, "up").groupBy("folder").agg(F.max_by("path", F.struct("depth", (-F.col("nth")).alias("n"))).alias("config"))


def aliases(folders: DataFrame, configs: DataFrame) -> DataFrame:
    """folder, pattern, target and base for the alias patterns of the config that holds for a folder; configs has path and json."""
    read = configs.withColumn("patterns", udfs.alias_patterns("json")).where("patterns is not null")
    at = F.regexp_replace("path", "/?[^/]*$", "")
    each = read.select(F.col("path").alias("config"), at.alias("at"), F.explode("patterns").alias("p"))
    base = F.when(F.col("p")[2].startswith("/"), F.col("p")[2]).otherwise(F.concat_ws("/", "at", F.col("p")[2]))
    return nearest_tsconfig(folders, read).join(each, "config").select("folder", F.col("p")[0].alias("pattern"), F.col("p")[1].alias("target"), base.alias("base"))


def alias_candidates(imports: DataFrame, patterns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, prio and dst: the paths to try for imports through alias patterns, the longest pattern's first; ties by pattern.

    Patterns with a folder (and the base of their targets) hold for imports of that folder alone.
    """
    to = X.alias_target(F.col("spec"), F.col("pattern"), F.col("target"))
    if "folder" in patterns.columns:
        found, at = imports.join(patterns, "folder").where(to.isNotNull()), F.when(to.startswith("/"), to).otherwise(F.concat_ws("/", "base", to))
    else:
        # A pattern begins with the letters before its star, so that it is one of the spec's prefixes that finds it: any number of patterns.
        headed = patterns.withColumn("_head", F.split_part("pattern", F.lit("*"), F.lit(1)))
        prefixes = F.transform(F.sequence(F.lit(0), F.length("spec")), lambda i: F.substring("spec", F.lit(1), i))
        found, at = imports.withColumn("_head", F.explode(prefixes)).join(headed, "_head").where(to.isNotNull()).drop("_head"), to
    tried = found.select(*keys, "pattern", F.posexplode(probes(at, F.lit(""))).alias("nth", "dst"))
    return tried.select(*keys, F.struct(F.lit(0).alias("way"), (-F.length("pattern")).alias("l"), "pattern", "nth").alias("prio"), "dst")


def resolve_aliases(imports: DataFrame, patterns: DataFrame, inventory: DataFrame, keys: list[str]) -> DataFrame:
    """Imports through alias patterns (pattern, target), the longest that leads to a file first; ties by pattern."""
    return _first(alias_candidates(imports, patterns, keys), inventory, keys)


def candidates(files: DataFrame, roots: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """src, ord, spec, prio and dst: the paths to try for the imports of files with path, folder, ext and specs.

    roots has folder and root. patterns, from aliases(), come before the other ways; not for relative imports, Python and C.
    """
    specs = files.join(roots, "folder").select("path", "folder", "root", "ext", F.posexplode("specs").alias("ord", "spec")).withColumnRenamed("path", "src")
    wanted = F.flatten(F.transform(bases(F.col("spec"), F.col("folder"), F.col("root"), F.col("ext")), lambda b: probes(b, F.col("ext"))))
    keys = ["src", "ord", "spec"]
    tried = specs.select(*keys, F.posexplode(wanted).alias("nth", "dst"))
    out = tried.select(*keys, F.struct(F.lit(1).alias("way"), F.lit(0).alias("l"), F.lit("").alias("pattern"), "nth").alias("prio"), "dst")
    if patterns is None:
        return out
    named = specs.where(~(F.col("spec").startswith("./") | F.col("spec").startswith("../") | F.col("ext").isin("py", *C_LIKE)))
    return alias_candidates(named, patterns, keys).unionByName(out)


def _first(tried: DataFrame, inventory: DataFrame, keys: list[str]) -> DataFrame:
    return tried.join(inventory.select(F.col("path").alias("dst")), "dst").groupBy(*keys).agg(F.min_by("dst", "prio").alias("dst"))


def edges(files: DataFrame, roots: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """src, ord, spec, dst: the first candidate of every import that is one of the files."""
    return _first(candidates(files, roots, patterns), files, ["src", "ord", "spec"])
