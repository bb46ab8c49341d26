"""Every query runs, and agrees with its SQL where it has any."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest

import corpusql.queries as Q
from corpusql.operators.evaluation import bleu, rouge
from corpusql.oracles import ORACLES

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, list | tuple | np.ndarray):
        return [plain(v) for v in value]
    if isinstance(value, np.generic):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return None if value is None or value != value else value


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr([plain(v) for v in r]) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    mine, theirs = Q.QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = Q.QUERIES[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_text_measures(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("the cat sat", "the cat ran away", "", None)], "a string, b string, c string, d string").select(
        rouge(F.col("a"), F.col("b")).alias("r"), rouge(F.col("a"), F.col("b"), 2).alias("r2"), bleu(F.col("a"), F.col("a")).alias("same"), bleu(F.col("a"), F.col("b"), 2).alias("b"), bleu(F.col("c"), F.col("d")).alias("none")
    ).first()
    assert (row.r.precision, row.r.recall) == (pytest.approx(2 / 3, abs=1e-6), 0.5)
    assert row.r2.precision == 0.5 and row.same == 1.0 and row.none == 0.0
    assert row.b == pytest.approx(math.exp((math.log(2 / 3) + math.log(2 / 3)) / 2 + 1 - 4 / 3), abs=1e-6)


def test_entry_file(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(Q.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
