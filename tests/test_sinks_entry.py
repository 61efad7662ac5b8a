import os
import sys
import tempfile

import duckdb
from pyspark.sql import functions as F

from faultline.plans.queries import registry
from faultline.sources import sinks

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import check_oracle  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from conftest import SF001  # noqa: E402


def test_json_codec(spark):
    df = spark.createDataFrame([("r", "a.yml", "f1", "b1")], "repo string, filepath string, fic string, bic string")
    enc = sinks.encode_fixed_files(df)
    assert enc.first().json == '{"filepath":"a.yml","fic":"f1","bic":"b1"}'
    assert sinks.decode_fixed_files(enc).first().asDict() == {"filepath": "a.yml", "fic": "f1", "bic": "b1"}
    other = spark.createDataFrame([('{"x": 1}',)], "json string")
    assert sinks.decode_failure_prone(other).first().asDict() == {"filepath": None, "commit": None,
                                                                  "fixing_commit": None}


def test_csv_overwrite(spark):
    path = tempfile.mkdtemp(prefix="faultline-csv-")
    df = spark.createDataFrame([("a", 1)], "filepath string, n long")
    sinks.to_csv(df, path)
    sinks.to_csv(df, path)
    back = sinks.read_csv(spark, path, "filepath string, n long")
    assert back.collect() == df.collect()
    header = [l for f in os.listdir(path) if f.endswith(".csv") for l in open(os.path.join(path, f))][0]
    assert header.strip() == "filepath,n"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["repo", "commit_hash", "idx", "labels"]
    assert df.count() > 0


def test_queries_match_oracle(spark):
    con = duckdb.connect()
    for t in check_oracle.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    qs, oracle = registry(), E.oracle_sql()
    assert set(qs) <= set(oracle) and set(qs) <= set(E.queries())
    bad = []
    for key in qs:
        c1, r1 = check_oracle.rows(qs[key](spark, SF001).toPandas())
        c2, r2 = check_oracle.rows(con.execute(oracle[key]).df())
        if c1 != c2 or r1 != r2:
            bad.append(key)
    assert bad == []
