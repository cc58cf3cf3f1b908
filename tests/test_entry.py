import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SF = Path("/root/testdata/sf0.001")


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not SF.exists(), reason="the tables aren't here")
def test_graph_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from linkweave import fixture_queries as q

    db = duckdb.connect()
    for t in ("part", "lineitem"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name in ("page_scan_ns0", "edges_multiset", "edges_transitive", "vertices_union", "csr_offsets", "graph_stats", "all_shortest_paths", "csr_edges", "csr_reverse_edges", "degree_from_offsets", "offsets_tail", "path_response_fields", "row_counts", "dump_file_page", "dump_file_links"):
        frame, want = q.QUERIES[name](spark, str(SF)), db.sql(q.ORACLE_SQL[name])
        columns = sorted(frame.columns)
        assert columns == sorted(want.columns)
        rows = [tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()]
        assert sorted(map(tuple, frame.select(*columns).collect()), key=str) == sorted(rows, key=str), name


def test_the_rest_works_without_the_training_operators(tmp_path):
    """Where the llm folders and the pipeline are gone, the entry module still imports, lists the other queries, and the
    other tests are found and work."""
    import shutil

    for folder in ("linkweave", "tests"):
        shutil.copytree(ROOT / folder, tmp_path / folder, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'edges_multiset' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
    subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only"], cwd=tmp_path, env=env, check=True)
    subprocess.run([sys.executable, "-m", "pytest", "tests/test_bfs_depth.py", "tests/test_entry.py::test_every_oracle_has_a_query", "-q"], cwd=tmp_path, env=env, check=True)


def test_only_their_absence_is_forgiven(tmp_path):
    """A package that the training operators need and that is missing isn't taken for their absence."""
    (tmp_path / "corpus_pipeline.py").write_text("import a_package_that_is_not_there\n")
    env = os.environ | {"PYTHONPATH": f"{tmp_path}:{ROOT}"}
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], env=env, cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode and "a_package_that_is_not_there" in done.stderr
