import pytest

N = 600


@pytest.mark.parametrize("name", ["bfs_levels", "bfs_parents"])
def test_only_levels_beyond_its_bound_are_missing_from_the_sql(spark, tmp_path, name):
    """On 27 levels of two pages the query gives what the SQL gives with a bound above them; at levels up to 25, what the SQL gives as it is."""
    duckdb = pytest.importorskip("duckdb")
    from linkweave import fixture_queries as q

    levels = [(q.START,), *[(20 * k, 20 * k + 5) for k in range(27)]]
    links = [(s, d) for one, two in zip(levels, levels[1:]) for s in one for d in two]
    links += links[:9] + [(20, 20), (520, 27), (300, 25), (7 * 20, 27)]  # again, to itself, and back
    db = duckdb.connect()
    db.execute(f"create table part as select range as p_partkey from range({N})")
    db.execute("create table lineitem (l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double)")
    db.executemany("insert into lineitem values (?, 0, ?, 1)", [(s, (d - 7 * s) % N) for s, d in links])
    for t in ("part", "lineitem"):
        db.execute(f"copy {t} to '{tmp_path}/{t}.parquet'")

    frame, sql = q.QUERIES[name](spark, str(tmp_path)), q.ORACLE_SQL[name]
    got, given, whole = sorted(map(tuple, frame.collect())), db.sql(sql), db.sql(sql.replace("h < 25", "h < 100"))
    assert frame.columns == given.columns == whole.columns
    far = set(levels[26] + levels[27])
    assert got == sorted(whole.fetchall()) and {n for row in got for n in row} >= far
    assert [row for row in got if row[0] not in far] == sorted(given.fetchall())
