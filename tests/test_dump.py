import gzip
import io

import pytest

from linkweave.functions.dump_text import strict_unsigned
from linkweave.operators.paths import all_shortest_paths
from linkweave.plans.build import graph_from_dumps
from linkweave.plans.response import path_response, path_summary
from linkweave.sources import Settings, dump_path, dump_url, fetch, header_columns, read_dump, read_plain_dump
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

HEADERS = {
    "page": ("page_id", "page_namespace", "page_title", "page_is_redirect"),
    "redirect": ("rd_from", "rd_namespace", "rd_title"),
    "linktarget": ("lt_id", "lt_namespace", "lt_title"),
    "pagelinks": ("pl_from", "pl_from_namespace", "pl_target_id"),
}
ROWS = {
    "page": r"(1,0,'A',0),(2,0,'B',0),(3,0,'R1',1),(4,0,'R2',1),(5,0,'C',0),(6,1,'Talk',0),(7,0,'D',0),(8,0,'It\'s_(x),y',0)",
    "redirect": "(3,0,'B'),(4,0,'R1'),(2,0,'C'),(7,1,'Talk')",
    "linktarget": r"(10,0,'A'),(11,0,'B'),(12,0,'R1'),(13,0,'R2'),(14,0,'C'),(15,1,'Talk'),(16,0,'Missing'),(17,0,'It\'s_(x),y')",
    "pagelinks": "(1,0,11),(1,0,11),(1,0,12),(2,0,14),(1,0,17),(8,0,14),(5,0,14),(6,1,10),(99,0,10),(7,0,13),(1,0,16),(1,0,15),(1,0,777),(3,0,11)",
}


def dump(table, rows=None, header=None):
    columns = "".join(f"  `{c}` varbinary(255) NOT NULL,\n" for c in header or HEADERS[table])
    return f"-- a dump (1,2)\nDROP TABLE IF EXISTS `{table}`;\nCREATE TABLE `{table}` (\n{columns}  PRIMARY KEY (`{(header or HEADERS[table])[0]}`)\n) ENGINE=InnoDB;\nINSERT INTO `{table}` VALUES {rows or ROWS[table]};\n-- end\n"


@pytest.fixture(params=[True, False], ids=["gz", "plain"])
def folder(request, tmp_path):
    for table in HEADERS:
        raw = dump(table).encode()
        with open(dump_path(str(tmp_path), "xx", table, request.param), "wb") as f:
            f.write(gzip.compress(raw) if request.param else raw)
    return str(tmp_path), request.param


def test_graph_from_dumps(spark, folder):
    graph = graph_from_dumps(spark, folder[0], "xx", compressed=folder[1])
    links = sorted(map(tuple, graph.links.collect()))
    assert links == [(1, 2), (1, 2), (1, 5), (1, 8), (2, 5), (3, 2), (5, 5), (8, 5), (99, 1)]
    assert [r.page_id for r in graph.vertex_index().orderBy("idx").collect()] == [1, 2, 3, 4, 5, 7, 8, 99]
    assert [r.off for r in graph.offsets().orderBy("idx").collect()] == [0, 4, 5, 6, 6, 7, 7, 8, 9]
    assert [r.off for r in graph.offsets(True).orderBy("idx").collect()] == [0, 1, 4, 4, 4, 8, 8, 9, 9]
    assert [r.idx for r in graph.csr_edges().orderBy("pos").collect()] == [1, 1, 4, 6, 4, 1, 4, 4, 0]
    assert [r.idx for r in graph.csr_edges(True).orderBy("pos").collect()] == [7, 0, 0, 2, 0, 1, 4, 6, 0]
    assert [r.path for r in all_shortest_paths(graph, 99, 5).collect()] == [[99, 1, 5]]
    assert [r.path for r in all_shortest_paths(graph, 1, 2).collect()] == [[1, 2]]
    for pair, n, size in (((5, 5), 1, 1), ((4, 1), 0, 0), ((6, 6), 0, 0)):
        assert tuple(path_summary(all_shortest_paths(graph, *pair)).first()) == (n, size)
    assert '"num_paths":1,"shortest_path_length":3' in path_response(graph, 99, 5).first().response


def test_transitive_redirects(spark, folder):
    graph = graph_from_dumps(spark, folder[0], "xx", "transitive", folder[1], plain_pagelinks=True)
    assert sorted(map(tuple, graph.links.collect())) == [(1, 2)] * 3 + [(1, 8), (2, 5), (3, 2), (5, 5), (7, 2), (8, 5), (99, 1)]
    assert sorted(r.path for r in all_shortest_paths(graph, 99, 5).collect()) == [[99, 1, 2, 5], [99, 1, 8, 5]]


def test_tokenizer_quirks(spark, tmp_path):
    path = f"{tmp_path}/t.sql"
    with open(path, "w", encoding="utf-8") as f:
        f.write(dump("t", r"""(1,0,'It\'s_(a)_b,c',NULL,''),(2,1,'x''y\\z\n',0.5,'NULL'),(3, 0,'',a(b,'é\"q'),(4,0,'open""", ("a", "b", "c", "d", "e")))
    assert header_columns(spark, path) == ["a", "b", "c", "d", "e"]
    rows = read_dump(spark, path, "t", ["c", "a", "b", "d", "e"]).orderBy("_pos").drop("_pos").collect()
    assert list(map(tuple, rows)) == [("It's_(a)_b,c", "1", "0", "NULL", ""), ("xy\\zn", "2", "1", "0.5", "NULL"), ("", "3", " 0", "a(b", 'é"q')]
    with pytest.raises(ValueError, match="no column z"):
        read_dump(spark, path, "t", ["a", "z"])


def test_plain_reader_takes_columns_by_position(spark, tmp_path):
    path = f"{tmp_path}/t.sql"
    with open(path, "w") as f:
        f.write(dump("pagelinks", "(1,0,5),(2,1,6)", ("x", "y", "z")))
    assert sorted(tuple(r)[:3] for r in read_plain_dump(spark, path, "pagelinks", ["pl_from", "ns", "to"]).collect()) == [("1", "0", "5"), ("2", "1", "6")]


def test_last_row_of_a_key_stays_in_file_order(spark, tmp_path):
    from linkweave.operators.resolve import page_rows

    path = f"{tmp_path}/p.sql.gz"
    with open(path, "wb") as f:
        f.write(gzip.compress(dump("page", "(9,0,'A',0),(5,0,'A',1),(7,0,'B',0),(8,1,'B',0)").encode()))
    got = page_rows(read_dump(spark, path, "page", list(HEADERS["page"])))
    assert sorted((r.page_id, r.page_title, r.is_redirect) for r in got.collect()) == [(5, "A", True), (7, "B", False)]


@pytest.mark.parametrize(("text", "value"), [("0", 0), ("+7", 7), ("0004294967295", 4294967295)])
def test_unsigned(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(strict_unsigned(F.col("t"), "t").alias("v")).first().v == value


@pytest.mark.parametrize("text", ["", " 2", "2 ", "-1", "4294967296", "x", None, "5\n", "\n5"])
def test_no_unsigned(spark, text):
    with pytest.raises(SparkRuntimeException):
        spark.createDataFrame([(text,)], "t string").select(strict_unsigned(F.col("t"), "t").alias("v")).collect()


def test_fetch_and_settings(tmp_path):
    asked = []

    def opener(url):
        asked.append(url)
        return io.BytesIO(b"data")

    path = fetch("xx", "page", f"{tmp_path}/in/side", opener)
    assert open(path, "rb").read() == b"data" and fetch("xx", "page", f"{tmp_path}/in/side", opener) == path
    assert asked == [dump_url("xx", "page")]
    assert Settings.of({"WIKI_LANG": "en", "PORT": "x", "USE_MULTITHREAD": "1"}) == Settings("en", True, 8080)
    with pytest.raises(ValueError, match="WIKI_LANG"):
        Settings.of({})


def test_plain_file_beside_a_compressed_one(tmp_path):
    from linkweave.sources import gunzip

    path = f"{tmp_path}/a.sql.gz"
    with open(path, "wb") as f:
        f.write(gzip.compress(b"text"))
    assert open(gunzip(path), "rb").read() == b"text" and gunzip(path) == gunzip(f"{tmp_path}/a.sql")


def test_progress(spark):
    from linkweave.plans.progress import clock, observed, remaining

    frame, report = observed(spark.range(1000), "numbers")
    assert frame.count() == 1000 and report()["rows"] == 1000
    assert clock(3725) == "01h02m05s" and clock(remaining(0, 5, 1)) == "N/A" and remaining(10, 30, 5) == 10


def test_decompressed_as_it_comes_in(tmp_path):
    from linkweave.sources import fetch_plain

    raw = gzip.compress(b"first") + gzip.compress(b" second")
    path = fetch_plain("xx", "page", f"{tmp_path}/d", lambda url: io.BytesIO(raw))
    assert open(path, "rb").read() == b"first second" and path == dump_path(f"{tmp_path}/d", "xx", "page", False)
    assert fetch_plain("xx", "page", f"{tmp_path}/d", None) == path


def test_bytes_that_are_not_utf8(spark, tmp_path):
    path = f"{tmp_path}/t.sql"
    with open(path, "wb") as f:
        f.write(dump("t", "(1,'A'),(2,'B@C'),(3,'é')", ("a", "b")).encode().replace(b"@", b"\xff"))
    got = read_dump(spark, path, "t", ["a", "b"]).orderBy("_pos").drop("_pos").collect()
    assert [tuple(r) for r in got] == [("1", "A"), ("2", "B\ufffdC"), ("3", "é")]


def test_header_after_many_lines(spark, tmp_path):
    path = f"{tmp_path}/t.sql"
    with open(path, "w") as f:
        f.write("-- a line\n" * 5000 + dump("t", "(1,'A')", ("a", "b")))
    assert header_columns(spark, path) == ["a", "b"]


def test_build_and_ask_by_command(spark, tmp_path, monkeypatch, capsys):
    from linkweave import __main__ as command

    for table in HEADERS:
        with open(dump_path(str(tmp_path), "xx", table, False), "w") as f:
            f.write(dump(table))
    monkeypatch.setenv("WIKI_LANG", "xx")
    assert command.main(["build", str(tmp_path), f"{tmp_path}/graph"]) == 0
    assert "MiB/s" in capsys.readouterr().out
    assert command.main(["path", f"{tmp_path}/graph", "99", "5"]) == 0
    assert '"paths":[[99,1,5]]' in capsys.readouterr().out
    assert command.main(["stats", f"{tmp_path}/graph"]) == 0 and command.main(["path"]) == 2
    assert '"vertices":8' in capsys.readouterr().out


def test_progress_lines(spark):
    from linkweave.plans.progress import Watch, progress_line

    assert progress_line("x", 0.5, 4 << 20, 2.0).startswith("x: 2.0 of 4.0 MiB, 1.0 MiB/s") and progress_line("x", 0.5, 4 << 20, 2.0).endswith("00h00m02s left")
    assert progress_line("x", 0.0, 4, 2.0).endswith("N/A left")
    said = []
    with Watch(spark, "w", 1 << 20, said.append, 0.05):
        spark.range(200_000_000).selectExpr("sum(hash(id))").collect()
    assert len(said) > 1 and said[-1].startswith("w: 1.0 of 1.0 MiB")
