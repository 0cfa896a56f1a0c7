"""Every registered query with SQL, against DuckDB on the smallest tables."""

import glob
import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from packloom.plans import queries as q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"))
def test_query(spark, db, name):
    got = entry.queries()[name](spark, SF)
    want = db.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


def test_whole_texts_are_scanned(spark, tmp_path):
    texts = ["plain", "\nimport extra\n", "\nrequire('extra');\n", 'a\0b\n#include "extra.h"\n', "it's \"# no\\\" ''' é" * 50_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("doc_id", F.col("doc_id") + 13).write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).collect()))
    assert (16, True) in run("filter_binary") and (14, 2, "extra") in run("imports_py") and (15, 1, "extra") in run("imports_js") and (16, 0, "extra.h") in run("imports_c")
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert run("strip_comments_py") == [(i + 13, md5(f's = "# no"\n{md5(t)} \n')) for i, t in enumerate(texts)]


def test_full_limits_keep_long_texts(db):
    small, full = (db.sql(f"select sum(size), count(*) from (with {q._RUN if k == 0 else q._FULL_RUN} select * from b)").fetchall()[0] for k in (0, 1))
    assert full[0] > small[0] and full[1] > small[1], (small, full)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
