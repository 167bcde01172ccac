"""Every registered query with SQL gives the SQL's rows; the others give rows with a stable schema."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import canonical, kinds

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
# Fitted models take seconds each; one of every family is run here, all of them by check_oracle and the driver.
OTHERS = ["decode_signals", "baseline_als", "baseline_arpls", "persistence", "persistence_peaks", "pca_project", "adasyn",
          "borderline_smote", "repeated_edited", "one_sided", "model_gaussian_bayes", "confidence_report", "projection_sweep"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    mine = [tuple(r) for r in df.collect()]
    cursor = db.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert canonical(mine, df.columns) == canonical(theirs, columns)
    assert kinds(mine, df.columns) == kinds(theirs, columns)


@pytest.mark.parametrize("name", OTHERS)
def test_gives_rows(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["antibiotic", "S", "R", "I"] and df.count() == 5


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(entry.queries())
