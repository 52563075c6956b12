"""Every query of the core against its SQL in DuckDB, and rows of the others."""

import glob
import os

import duckdb
import pytest

from kernmill.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, db, name):
    a, b = QUERIES[name](spark, SF).toPandas(), db.sql(ORACLE_SQL[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert [str(a[c].dtype) for c in columns] == [str(b[c].dtype) for c in columns]
    a, b = (x[columns].sort_values(columns).reset_index(drop=True).astype(str) for x in (a, b))
    assert len(a) == len(b) and (a == b).all(axis=None)
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["qid", "density"] and out.count() == 500
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_subpackage_is_optional(tmp_path):
    """Without the llm folders and the pipeline the entry module imports, and offers the core alone."""
    import shutil
    import subprocess
    import sys

    import kernmill

    root = os.path.dirname(os.path.dirname(kernmill.__file__))
    shutil.copytree(f"{root}/kernmill", tmp_path / "kernmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLE_SQL))]


def test_shared_folder(spark, monkeypatch):
    """The setting comes first, then the context's folder; outside local mode one of them is needed."""
    from types import SimpleNamespace

    from kernmill import storage

    def session(conf, given, master):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: given, setCheckpointDir=lambda at: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: conf or other), sparkContext=context)

    assert storage.shared_dir(session("hdfs://a/b", "hdfs://c", "yarn")) == "hdfs://a/b"
    assert storage.shared_dir(session(None, "hdfs://c", "yarn")) == "hdfs://c"
    assert storage.shared_dir(session(None, None, "local[4]")).startswith("/tmp/")
    with pytest.raises(ValueError):
        storage.shared_dir(session(None, None, "spark://host:7077"))
    df, path = storage.written(spark.range(5), "test")
    assert df.count() == 5
    storage.forget(spark, path)
    assert not os.path.exists(path)
