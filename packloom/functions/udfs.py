"""Arrow-batched functions for what needs a scan of syntax."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packloom.functions import syntax
from packloom.functions.text import LANGUAGES, language


@F.pandas_udf(T.StringType())
def _scanned(text: pd.Series, ext: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else syntax.strip_comments(t, LANGUAGES.get(e)) for t, e in zip(text, ext, strict=True)], dtype=object)


def strip_comments(text: Column, ext: Column) -> Column:
    """The text without the comments of the language of its extension: by Spark's own patterns where they can tell strings from comments, else by a scan."""
    lang = language(ext)
    scanned = lang.isNotNull() & ~lang.isin(*syntax.PLAIN)
    out = F.when(scanned, _scanned(F.when(scanned, text), ext))
    for name in syntax.PLAIN:
        out = out.when(lang == name, F.regexp_replace(text, F.lit(syntax.java_pattern(name)), F.lit("$1")))
    return out.otherwise(text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def extract_imports(text: pd.Series, ext: pd.Series) -> pd.Series:
    return pd.Series([syntax.imports(t or "", LANGUAGES.get(e)) for t, e in zip(text, ext, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def alias_patterns(json: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else syntax.alias_patterns(t) for t in json], dtype=object)


@F.udtf(returnType=T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("spec", T.StringType())]))
class ImportRows:
    """extract_imports(text, ext) as rows, for LATERAL."""

    def eval(self, text: str, ext: str):
        yield from enumerate(syntax.imports(text or "", LANGUAGES.get(ext)))
