"""Queries over link-graph views of the part and lineitem tables, and the SQL that gives the same rows."""

from __future__ import annotations

import os
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dump_text import insert_rows, quoted_fields, unquoted_fields
from .operators import paths as P
from .operators import resolve as R
from .operators.graph import LinkGraph
from .operators.store import shared_dir
from .plans.build import graph_from_tables
from .plans.response import path_response, path_summary
from .sources.dump import read_dump, read_plain_dump

START, GOAL = 27, 126

_VIEWS = """
n AS (SELECT count(*) AS n FROM part),
page AS (SELECT p_partkey AS page_id, 'P' || p_partkey AS page_title, CASE WHEN p_partkey % 20 = 13 THEN 1 ELSE 0 END AS page_namespace, CASE WHEN p_partkey % 10 = 7 THEN 1 ELSE 0 END AS page_is_redirect FROM part),
redirect AS (SELECT p_partkey AS rd_from, CASE WHEN p_partkey % 50 = 37 THEN 4 ELSE 0 END AS rd_namespace,
  'P' || (CASE WHEN p_partkey % 100 = 57 THEN p_partkey + 10 WHEN p_partkey % 10 = 7 THEN (p_partkey * 3 + 1) % n ELSE (p_partkey + 3) % n END) AS rd_title
  FROM part CROSS JOIN n WHERE p_partkey % 10 = 7 OR p_partkey % 20 = 2),
linktarget AS (SELECT 1000000 + p_partkey AS lt_id, CASE WHEN p_partkey % 25 = 11 THEN 4 ELSE 0 END AS lt_namespace, 'P' || p_partkey AS lt_title FROM part),
pagelinks AS (SELECT l_partkey AS pl_from, CASE WHEN l_partkey % 20 = 13 THEN 1 ELSE 0 END AS pl_from_namespace, 1000000 + (l_partkey * 7 + l_suppkey * 13 + l_linenumber) % n AS pl_target_id FROM lineitem CROSS JOIN n WHERE l_quantity <= 4),
p0 AS (SELECT * FROM page WHERE page_namespace = 0), lt0 AS (SELECT * FROM linktarget WHERE lt_namespace = 0),
rd0 AS (SELECT r.rd_from, r.rd_title, t.page_id AS tid FROM redirect r JOIN p0 t ON t.page_title = r.rd_title WHERE r.rd_namespace = 0 AND t.page_is_redirect = 0),
lk AS (SELECT l.pl_from AS src, t.page_id AS tid, t.page_is_redirect AS isr FROM pagelinks l JOIN lt0 ON lt0.lt_id = l.pl_target_id JOIN p0 t ON t.page_title = lt0.lt_title WHERE l.pl_from_namespace = 0),
hop2 AS (SELECT r1.rd_from AS root, r2.tid AS dst FROM rd0 r1 JOIN rd0 r2 ON r2.rd_from = r1.tid),
e AS (SELECT src, tid AS dst FROM lk WHERE isr = 0 UNION ALL SELECT src, dst FROM lk JOIN hop2 ON root = tid WHERE isr = 1),
v AS (SELECT page_id FROM p0 UNION SELECT src FROM e),
idx AS (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS idx FROM v),
ei AS (SELECT s.idx AS src_idx, d.idx AS dst_idx FROM e JOIN idx s ON s.page_id = e.src JOIN idx d ON d.page_id = e.dst),
od AS (SELECT idx, count(e.src) AS degree FROM idx LEFT JOIN e ON e.src = idx.page_id GROUP BY idx),
rdg AS (SELECT idx, count(e.dst) AS degree FROM idx LEFT JOIN e ON e.dst = idx.page_id GROUP BY idx),
off AS (SELECT idx, CAST(sum(degree) OVER (ORDER BY idx) - degree AS BIGINT) AS off FROM od UNION ALL SELECT count(*), CAST(sum(degree) AS BIGINT) FROM od),
roff AS (SELECT idx, CAST(sum(degree) OVER (ORDER BY idx) - degree AS BIGINT) AS off FROM rdg UNION ALL SELECT count(*), CAST(sum(degree) AS BIGINT) FROM rdg),
rdall AS (SELECT r.rd_from, t.page_id AS tid, t.page_is_redirect AS isr FROM redirect r JOIN p0 t ON t.page_title = r.rd_title WHERE r.rd_namespace = 0),
hop(root, tid, isr, h) AS (SELECT rd_from, tid, isr, 1 FROM rdall UNION ALL SELECT hop.root, r.tid, r.isr, hop.h + 1 FROM hop JOIN rdall r ON r.rd_from = hop.tid WHERE hop.isr = 1 AND hop.h < 10),
et AS (SELECT src, tid AS dst FROM lk WHERE isr = 0 UNION ALL SELECT lk.src, hop.tid FROM lk JOIN hop ON hop.root = lk.tid WHERE lk.isr = 1 AND hop.isr = 0),
ed AS (SELECT DISTINCT src, dst FROM e),
fr AS (SELECT page_id AS node FROM v WHERE page_id % 50 = 2), br AS (SELECT page_id AS node FROM v WHERE page_id % 40 = 5)
"""


def _sql(select: str, more: str = "") -> str:
    return f"WITH RECURSIVE {_VIEWS}{more} {select}"


def _search(start: int) -> str:
    return f""", lvl(node, h) AS (SELECT CAST({start} AS BIGINT), 0 UNION SELECT ed.dst, h + 1 FROM lvl JOIN ed ON ed.src = lvl.node WHERE h < 25),
dist AS (SELECT node, min(h) AS dist FROM lvl GROUP BY node)"""


def _paths(start: int, goal: int) -> str:
    return _search(start) + f""", paths(node, path, h) AS (SELECT CAST({start} AS BIGINT), [CAST({start} AS BIGINT)], 0
UNION ALL SELECT ed.dst, list_append(path, ed.dst), paths.h + 1 FROM paths JOIN ed ON ed.src = paths.node JOIN dist d ON d.node = ed.dst AND d.dist = paths.h + 1 WHERE paths.h < (SELECT dist FROM dist WHERE node = {goal})),
found AS (SELECT path FROM paths WHERE node = {goal} AND {start} IN (SELECT page_id FROM v))"""


class Views:
    """The four dump tables as text columns."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        part, line = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem"))
        n, k = part.count(), F.col("p_partkey")
        flag = lambda c, yes: F.when(c, yes).otherwise("0")
        self.spark = spark
        self.page = part.select(k.cast("string").alias("page_id"), F.concat(F.lit("P"), k).alias("page_title"), flag(k % 20 == 13, "1").alias("page_namespace"), flag(k % 10 == 7, "1").alias("page_is_redirect"))
        to = F.when(k % 100 == 57, k + 10).when(k % 10 == 7, (k * 3 + 1) % n).otherwise((k + 3) % n)
        self.redirect = part.where((k % 10 == 7) | (k % 20 == 2)).select(k.cast("string").alias("rd_from"), flag(k % 50 == 37, "4").alias("rd_namespace"), F.concat(F.lit("P"), to).alias("rd_title"))
        self.linktarget = part.select((k + 1_000_000).cast("string").alias("lt_id"), flag(k % 25 == 11, "4").alias("lt_namespace"), F.concat(F.lit("P"), k).alias("lt_title"))
        source = F.col("l_partkey")
        self.pagelinks = line.where("l_quantity <= 4").select(source.cast("string").alias("pl_from"), flag(source % 20 == 13, "1").alias("pl_from_namespace"), ((source * 7 + F.col("l_suppkey") * 13 + F.col("l_linenumber")) % n + 1_000_000).cast("string").alias("pl_target_id"))

    def graph(self, mode: str = "reference", staged: bool = False) -> LinkGraph:
        return graph_from_tables(self.page, self.redirect, self.linktarget, self.pagelinks, mode, staged)

    def kept(self) -> LinkGraph:
        return self.graph(staged=True)

    def some(self, modulo: int, rest: int) -> DataFrame:
        """A frontier: vertices of one remainder."""
        return self.graph().nodes.where(F.col("page_id") % modulo == rest).select(F.col("page_id").alias("node"))


def _text(df: DataFrame, array: str) -> DataFrame:
    return df.withColumn(array, F.array_join(array, ">"))


def _shortest(view: Views, start: int = START, goal: int = GOAL) -> DataFrame:
    return P.all_shortest_paths(view.kept(), start, goal)


def _levels(view: Views, start: int = START) -> tuple[DataFrame, DataFrame]:
    """(node, dist) and (child, parent) of a search that goes on until nothing new is found."""
    side, parents = P.Side(view.kept(), start), None
    while side.size:
        side.advance()
        side.weigh()
        level = side.levels[-1].select("child", "parent")
        parents = level if parents is None else parents.unionByName(level)
    return side.seen, parents


def _round_trip(view: Views) -> DataFrame:
    folder = f"{shared_dir(view.spark)}/graph-{os.urandom(8).hex()}"
    view.graph().save(folder)
    return LinkGraph.load(view.spark, folder).links


_TUPLES = r"""INSERT INTO `t` VALUES (1,0,'It\'s_(a)_b,c',NULL,''),(2,1,'x''y\\z\n',0.5,'NULL'),(3, 0,'',a(b,'é\"q'),(4,0,'open"""
_PLAIN = "INSERT INTO `pagelinks` VALUES (1,0,5),(2,1,6);"


def _quoted(view: Views) -> DataFrame:
    line = view.spark.createDataFrame([(_TUPLES,)], "value string")
    return line.select(F.explode(insert_rows(F.col("value"))).alias("t")).select(quoted_fields(F.col("t")).alias("f")).select(*[F.get("f", F.lit(k)).alias(f"c{k}") for k in range(5)])


def _unquoted(view: Views) -> DataFrame:
    line = view.spark.createDataFrame([(_PLAIN,)], "value string")
    return line.select(F.explode(insert_rows(F.col("value"), False)).alias("t")).select(unquoted_fields(F.col("t")).alias("f")).select(*[F.get("f", F.lit(k)).alias(f"c{k}") for k in range(3)])


#: Columns of the page dump that is written, in its order, which isn't that of the readers.
_PAGE_HEADER = ("page_id", "page_namespace", "page_title", "page_is_redirect", "page_len")


def _write_dump(view: Views, table: str, header: tuple[str, ...], tuples: DataFrame, compression: str) -> str:
    """tuples(t, k) as a dump's lines: comments, CREATE TABLE, and an INSERT for each k."""
    head = ["-- a dump (1,2)", f"DROP TABLE IF EXISTS `{table}`;", f"CREATE TABLE `{table}` (", *[f"  `{c}` varbinary(255) NOT NULL," for c in header], f"  PRIMARY KEY (`{header[0]}`)", ") ENGINE=InnoDB;"]
    inserts = tuples.groupBy("k").agg(F.concat(F.lit(f"INSERT INTO `{table}` VALUES "), F.array_join(F.collect_list("t"), ","), F.lit(";")).alias("value"))
    lines = view.spark.createDataFrame([(line,) for line in head], "value string").coalesce(1).union(inserts.select("value"))
    path = f"{shared_dir(view.spark)}/dump-{os.urandom(8).hex()}/{table}.sql" + (".gz" if compression == "gzip" else "")
    lines.coalesce(1).write.option("compression", compression).text(path)
    return path


def _page_file(view: Views) -> DataFrame:
    """The page view, through a compressed dump with a header, escapes and a column that isn't asked for."""
    key = F.col("page_id").cast("long")
    title = F.when(key % 7 == 3, F.concat(F.lit("P\\'"), "page_id", F.lit(",(x)"))).otherwise(F.col("page_title"))
    body = F.concat(F.lit("("), "page_id", F.lit(","), "page_namespace", F.lit(",'"), title, F.lit("',"), "page_is_redirect", F.lit(",NULL)"))
    path = _write_dump(view, "page", _PAGE_HEADER, view.page.select(body.alias("t"), (key % 23).alias("k")), "gzip")
    return read_dump(view.spark, path, "page", ["page_title", "page_id", "page_is_redirect", "page_namespace"]).drop("_pos")


def _links_file(view: Views) -> DataFrame:
    """The pagelinks view, through a plain dump that is read by position."""
    body = F.concat(F.lit("("), F.concat_ws(",", "pl_from", "pl_from_namespace", "pl_target_id"), F.lit(")"))
    path = _write_dump(view, "pagelinks", ("a", "b", "c"), view.pagelinks.select(body.alias("t"), F.pmod(F.hash("pl_from"), F.lit(40)).alias("k")), "none")
    return read_plain_dump(view.spark, path, "pagelinks", ["pl_from", "pl_from_namespace", "pl_target_id"]).drop("_pos")


def _row_counts(view: Views) -> DataFrame:
    """name, read, kept: rows of each dump, and those that its scan keeps (links: that lead to a page)."""
    page, target = R.page_rows(view.page), R.linktarget_rows(view.linktarget)
    pairs = (("page", view.page, page), ("redirect", view.redirect, R.redirect_rows(view.redirect, page)), ("linktarget", view.linktarget, target), ("pagelinks", view.pagelinks, R.resolved_links(view.pagelinks, target, page)))
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), F.lit(kind).alias("kind"), "n") for name, *both in pairs for kind, df in zip(("read", "kept"), both)]
    return reduce(DataFrame.unionByName, rows).groupBy("name").agg(*[F.max(F.when(F.col("kind") == kind, F.col("n"))).alias(kind) for kind in ("read", "kept")])


def _response_fields(view: Views) -> DataFrame:
    """The JSON answer taken apart; its time is only held to be there."""
    body = F.from_json("response", "paths array<array<bigint>>, num_paths bigint, shortest_path_length bigint, time_spent_ms bigint")
    row = path_response(view.kept(), START, GOAL).select(body.alias("r"))
    paths = F.array_join(F.transform("r.paths", lambda p: F.array_join(p, ">")), "|")
    return row.select(paths.alias("paths"), "r.num_paths", "r.shortest_path_length", (F.col("r.time_spent_ms") >= 0).alias("timed"))


def _keep_last(view: Views) -> DataFrame:
    rows = view.page.select((F.col("page_id").cast("long") % 17).alias("k"), F.col("page_id").cast("long").alias("id"), F.col("page_id").cast("long").alias("ord"))
    return R.keep_last(rows, "k", "ord")


def _stats_sql() -> str:
    return """SELECT count(*) AS vertices, count(*) + 1 AS offsets_len, (SELECT count(*) FROM ei) AS edges_len, (SELECT count(*) FROM ei) AS last_offset,
(SELECT dst_idx FROM ei ORDER BY src_idx DESC, dst_idx DESC LIMIT 1) AS last_edge, count(*) + 1 AS reverse_offsets_len, (SELECT count(*) FROM ei) AS reverse_edges_len,
(SELECT count(*) FROM ei) AS last_reverse_offset, (SELECT src_idx FROM ei ORDER BY dst_idx DESC, src_idx DESC LIMIT 1) AS last_reverse_edge FROM idx"""


_READ = {
    "page_scan_ns0": (lambda v: R.page_rows(v.page), _sql("SELECT page_id, page_title, page_is_redirect = 1 AS is_redirect FROM p0")),
    "redirect_to_article": (lambda v: R.redirect_rows(v.redirect, R.page_rows(v.page)), _sql("SELECT rd_from, rd_title, tid AS target_id FROM rd0")),
    "linktarget_scan_ns0": (lambda v: R.linktarget_rows(v.linktarget), _sql("SELECT lt_id, lt_title FROM lt0")),
    "keep_last_by_key": (_keep_last, "SELECT k, max(id) AS id FROM (SELECT p_partkey % 17 AS k, p_partkey AS id FROM part) GROUP BY k"),
    "links_resolved_target": (lambda v: R.resolved_links(v.pagelinks, R.linktarget_rows(v.linktarget), R.page_rows(v.page)), _sql("SELECT src, tid AS target_id, isr = 1 AS is_redirect FROM lk")),
    "redirect_two_hop": (lambda v: R._second_hops(R.redirect_rows(v.redirect, R.page_rows(v.page))), _sql("SELECT root AS target_id, dst FROM hop2")),
    "redirect_transitive": (lambda v: R._chains(R.all_redirects(v.redirect, R.page_rows(v.page))), _sql("SELECT root AS target_id, tid AS dst FROM hop WHERE isr = 0")),
    "edges_multiset": (lambda v: v.graph().links, _sql("SELECT src, dst FROM e")),
    "edges_transitive": (lambda v: v.graph("transitive").links, _sql("SELECT src, dst FROM et")),
    "link_counts": (lambda v: R.link_counts(v.page, v.redirect, v.linktarget, v.pagelinks), _sql('SELECT (SELECT count(*) FROM pagelinks) AS "read", (SELECT count(*) FROM lk) AS resolved, (SELECT count(*) FROM e) AS kept')),
    "vertices_union": (lambda v: v.graph().nodes, _sql("SELECT page_id FROM v")),
    "vertex_index": (lambda v: v.kept().vertex_index(), _sql("SELECT page_id, idx FROM idx")),
    "edges_indexed": (lambda v: v.kept().indexed_edges(), _sql("SELECT src_idx, dst_idx FROM ei")),
    "adjacency_list": (lambda v: _text(v.graph().adjacency(), "neighbours"), _sql("SELECT src, string_agg(CAST(dst AS VARCHAR), '>' ORDER BY dst) AS neighbours FROM e GROUP BY src")),
    "reverse_adjacency_list": (lambda v: _text(v.graph().adjacency(True), "neighbours"), _sql("SELECT dst, string_agg(CAST(src AS VARCHAR), '>' ORDER BY src) AS neighbours FROM e GROUP BY dst")),
    "csr_offsets": (lambda v: v.kept().offsets(), _sql("SELECT idx, off FROM off")),
    "csr_reverse_offsets": (lambda v: v.kept().offsets(True), _sql("SELECT idx, off FROM roff")),
    "csr_edges": (lambda v: v.kept().csr_edges(), _sql("SELECT row_number() OVER (ORDER BY src_idx, dst_idx) - 1 AS pos, dst_idx AS idx FROM ei")),
    "csr_reverse_edges": (lambda v: v.kept().csr_edges(True), _sql("SELECT row_number() OVER (ORDER BY dst_idx, src_idx) - 1 AS pos, src_idx AS idx FROM ei")),
    "degree_from_offsets": (lambda v: v.kept().degrees_from_offsets(), _sql("SELECT idx, degree FROM od")),
    "frontier_expand_forward": (lambda v: P.expand(v.some(50, 2), v.graph().links, v.some(40, 5)), _sql("SELECT DISTINCT dst AS child, src AS parent FROM e JOIN fr ON fr.node = src WHERE dst NOT IN (SELECT node FROM br)")),
    "frontier_expand_backward": (lambda v: P.expand(v.some(50, 2), v.graph().links, v.some(40, 5), True), _sql("SELECT DISTINCT src AS child, dst AS parent FROM e JOIN fr ON fr.node = dst WHERE src NOT IN (SELECT node FROM br)")),
    "frontier_link_counts": (lambda v: P.frontier_links(v.some(50, 2), v.graph().links).select(F.lit("forward").alias("side"), "links").union(P.frontier_links(v.some(40, 5), v.graph().links, True).select(F.lit("backward"), "links")), _sql("SELECT 'forward' AS side, count(*) AS links FROM e JOIN fr ON node = src UNION ALL SELECT 'backward', count(*) FROM e JOIN br ON node = dst")),
    "frontier_meet": (lambda v: P.meet(v.some(50, 2), 3, v.some(20, 12).select("node", (F.col("node") % 7).alias("dist"))), _sql("SELECT node, node % 7 + 3 AS length FROM fr WHERE node % 20 = 12")),
    "bfs_levels": (lambda v: _levels(v)[0].select("node", F.col("dist").cast("long").alias("dist")), _sql("SELECT node, CAST(dist AS BIGINT) AS dist FROM dist", _search(START))),
    "bfs_parents": (lambda v: _levels(v)[1], _sql("SELECT ed.dst AS child, ed.src AS parent FROM ed JOIN dist a ON a.node = ed.src JOIN dist b ON b.node = ed.dst AND b.dist = a.dist + 1", _search(START))),
    "all_shortest_paths": (lambda v: _text(_shortest(v), "path"), _sql("SELECT array_to_string(path, '>') AS path FROM found", _paths(START, GOAL))),
    "all_shortest_paths_other": (lambda v: _text(_shortest(v, 3, 165), "path"), _sql("SELECT array_to_string(path, '>') AS path FROM found", _paths(3, 165))),
    "all_shortest_paths_same_node": (lambda v: _text(_shortest(v, 27, 27), "path"), "SELECT '27' AS path"),
    "all_shortest_paths_unknown_node": (lambda v: _text(_shortest(v, 13, 13), "path"), _sql("SELECT array_to_string(path, '>') AS path FROM found", _paths(13, 13))),
    "all_shortest_paths_unreachable": (lambda v: _text(_shortest(v, 27, 7), "path"), _sql("SELECT array_to_string(path, '>') AS path FROM found", _paths(27, 7))),
    "path_summary": (lambda v: path_summary(_shortest(v)), _sql("SELECT count(*) AS num_paths, CAST(coalesce(min(len(path)), 0) AS BIGINT) AS shortest_path_length FROM found", _paths(START, GOAL))),
    "path_response_json": (lambda v: path_response(v.kept(), START, GOAL), None),
    "path_response_fields": (_response_fields, _sql("SELECT array_to_string(list_transform(list_sort(list(path)), lambda p: array_to_string(p, '>')), '|') AS paths, count(*) AS num_paths, CAST(coalesce(min(len(path)), 0) AS BIGINT) AS shortest_path_length, true AS timed FROM found", _paths(START, GOAL))),
    "row_counts": (_row_counts, _sql("""SELECT 'page' AS name, (SELECT count(*) FROM page) AS "read", (SELECT count(*) FROM p0) AS kept UNION ALL SELECT 'redirect', (SELECT count(*) FROM redirect), (SELECT count(*) FROM rd0)
UNION ALL SELECT 'linktarget', (SELECT count(*) FROM linktarget), (SELECT count(*) FROM lt0) UNION ALL SELECT 'pagelinks', (SELECT count(*) FROM pagelinks), (SELECT count(*) FROM lk)""")),
    "dump_file_page": (_page_file, _sql("SELECT CAST(page_id AS VARCHAR) AS page_id, CASE WHEN page_id % 7 = 3 THEN concat('P', chr(39), page_id, ',(x)') ELSE page_title END AS page_title, CAST(page_namespace AS VARCHAR) AS page_namespace, CAST(page_is_redirect AS VARCHAR) AS page_is_redirect FROM page")),
    "dump_file_links": (_links_file, _sql("SELECT CAST(pl_from AS VARCHAR) AS pl_from, CAST(pl_from_namespace AS VARCHAR) AS pl_from_namespace, CAST(pl_target_id AS VARCHAR) AS pl_target_id FROM pagelinks")),
    "graph_stats": (lambda v: v.kept().stats(), _sql(_stats_sql())),
    "offsets_tail": (lambda v: v.kept().offsets_tail(), _sql("SELECT idx, off FROM off ORDER BY idx DESC LIMIT 10")),
    "graph_roundtrip": (_round_trip, _sql("SELECT src, dst FROM e")),
    "dump_parse_quoted": (_quoted, "SELECT * FROM (VALUES ('1', '0', 'It''s_(a)_b,c', 'NULL', ''), ('2', '1', 'xy\\zn', '0.5', 'NULL'), ('3', ' 0', '', 'a(b', 'é\"q')) t(c0, c1, c2, c3, c4)"),
    "dump_parse_unquoted": (_unquoted, "SELECT * FROM (VALUES ('1', '0', '5'), ('2', '1', '6')) t(c0, c1, c2)"),
}


def _run(use, spark: SparkSession, sf_dir: str) -> DataFrame:
    return use(Views(spark, sf_dir))


QUERIES = {name: partial(_run, use) for name, (use, _) in _READ.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _READ.items() if sql}
