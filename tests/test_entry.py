"""The driver's contract: every query with SQL agrees with DuckDB on the smallest tables, and
the rest of the library stands without the subpackage llm."""

import glob
import os
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def names():
    from quire.queries import QUERIES

    return sorted(QUERIES)


def shown(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", names())
def test_query(spark, db, name):
    from quire.queries import ORACLE_SQL, QUERIES

    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(shown(r[c]) for c in cols)) for r in df.collect())
    assert rows
    if name in ORACLE_SQL:
        want = db.sql(ORACLE_SQL[name])
        at = [want.columns.index(c) for c in cols]
        assert rows == sorted(repr(tuple(shown(r[k]) for k in at)) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 50


def test_stands_without_llm(tmp_path):
    for name in os.listdir(ROOT):
        if name not in ("corpus_pipeline.py", ".git", "quire", "tests"):
            os.symlink(os.path.join(ROOT, name), tmp_path / name)
    (tmp_path / "quire").mkdir()
    for name in os.listdir(os.path.join(ROOT, "quire")):
        if name != "llm":
            os.symlink(os.path.join(ROOT, "quire", name), tmp_path / "quire" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_entry_hides_no_broken_import(tmp_path):
    """Only the absence of the subpackage is taken quietly."""
    (tmp_path / "quire" / "llm").mkdir(parents=True)
    for name in os.listdir(os.path.join(ROOT, "quire")):
        if name != "llm":
            os.symlink(os.path.join(ROOT, "quire", name), tmp_path / "quire" / name)
    os.symlink(os.path.join(ROOT, "__spark_entry__.py"), tmp_path / "__spark_entry__.py")
    (tmp_path / "quire" / "llm" / "__init__.py").write_text("")
    (tmp_path / "quire" / "llm" / "queries.py").write_text("import no_such_module\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode and "no_such_module" in out.stderr


@pytest.mark.parametrize("name", ["keynote_features", "docx_features", "html_blocks", "pages_features"])
def test_documents_made_of_rows_are_dealt_out(spark, name):
    """A table's only file, of a few bytes a row, doesn't leave all documents to one task."""
    from quire.queries import QUERIES

    assert QUERIES[name](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_no_row_holds_a_workbook_of_cells(spark, capsys):
    from quire.queries import QUERIES

    QUERIES["xlsx_sheets"](spark, SF).explain()
    assert "collect_list" not in capsys.readouterr().out
