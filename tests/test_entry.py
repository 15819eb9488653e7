import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_every_sql_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_imports_without_the_pipeline_operators(tmp_path):
    for p in ROOT.iterdir():
        if p.name in ("lexloom", "__spark_entry__.py"):
            subprocess.run(["cp", "-r", p, tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "lexloom" / "llm"], check=True)
    code = "import __spark_entry__ as e; assert 'lexicon_scores' in e.queries() and 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_an_operator_that_cannot_be_imported_leaves_the_rest(tmp_path):
    code = "import sys; sys.modules['xxhash'] = None\nimport __spark_entry__ as e; assert 'lexicon_scores' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(ROOT)})


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from lexloom.session import ensure_checkpoint_dir

    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_flagship(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.execute(entry.oracle_sql()["lexicon_class_stats"]).fetchall()
    assert [tuple(r) for r in entry.entry(spark).collect()] == want
