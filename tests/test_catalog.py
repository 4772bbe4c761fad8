"""Every registered query of the library's own operators against its SQL on DuckDB."""

import math

import duckdb
import pandas as pd
import pytest
from quern.plans import catalog

from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    return tuple(map(plain, v)) if isinstance(v, list) else round(v, 9) if isinstance(v, float) else v


def rows(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())


def test_a_source_without_an_id_ending_in_07_is_affected(spark, tmp_path):
    docs = [(1, "en", "a"), (2, "en", "b"), (7, "en", "c"), (3, "de", "a"), (4, "de", "d")]
    spark.createDataFrame(docs, "doc_id long, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1,), (3,)], "doc_id long").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"]: r["files"] for r in catalog.QUERIES["affected_files"](spark, str(tmp_path)).collect()}
    assert got == {1: ["b", "c"], 3: ["d"]}


def test_first_lines_of_odd_texts(spark, duck, tmp_path):
    """Texts that are null, empty, blank or begin with other white space than spaces; characters beyond 16 bits."""
    import random

    rng = random.Random(3)
    texts = [None, "", " ", "\n", " \n  \n", "\t\na", " \ta\r\nb ", "\r\n", "\n\n x \n", "\x0b\n\x0c", "\u00a0 x", "\u2028a\nb", "\x00a", "e\u0301" * 150, "😀" * 250, "🇩🇪" * 150, " " * 300 + "x" * 300]
    texts += ["".join(rng.choice(" \n\t\r\x0b\x1c\u00a0\u3000aé") for _ in range(rng.randint(0, 9))) for _ in range(400)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES["first_lines"](spark, str(tmp_path)).collect()
    con = duck.cursor()
    con.sql(f"CREATE TEMP VIEW odd AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(catalog.ORACLES["first_lines"].replace("FROM documents", "FROM odd")).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
