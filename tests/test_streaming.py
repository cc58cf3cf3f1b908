import gzip

from linkweave.streaming import append_new, stream_dump


def test_each_file_is_read_once(spark, tmp_path):
    def put(name, tuples):
        text = f"CREATE TABLE `page` (\n  `id` int,\n  `title` varchar(9),\n) x;\nINSERT INTO `page` VALUES {tuples};\n"
        with open(f"{tmp_path}/in/{name}", "wb") as f:
            f.write(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())

    (tmp_path / "in").mkdir()

    def rows():
        append_new(stream_dump(spark, f"{tmp_path}/in", "page", ["id", "title"], ["title", "id"]), f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination()
        return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))

    put("a.sql", r"(1,'A'),(2,'It\'s, (x)')")
    first = [("A", "1", "a.sql", 0), ("It's, (x)", "2", "a.sql", 1)]
    assert rows() == first and rows() == first
    put("b.sql.gz", "(3,'C')")
    assert rows() == [*first[:1], ("C", "3", "b.sql.gz", 0), *first[1:]]
