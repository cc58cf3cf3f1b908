"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions only.

A text is cut into paragraphs (lines, and long lines at the ends of sentences, or after PIECE characters). A sketch has
three tables of cells; each distinct digest is added to one cell of each: a count, the digests' exclusive or, and that
of their checks. Sketches of two versions are subtracted cell by cell: what both hold cancels out. Peeling then takes
digests out of cells that hold a single one, until nothing is left, which recovers the digests that differ.

The fingerprint of a document is its sketch of BASE cells. If a difference is too large for it, both versions are
sketched again, larger: their digests are dealt into groups of GROUP on average, each with a sketch of its own, so work
grows in proportion to the digests; a group that can't be peeled is sketched anew with other cells, twice as many, and
at last compared digest by digest. The likeness of two fingerprints is the number of digests that both hold over that of
digests that either holds, as the recovered differences give it.

The next document in the order of doc_id is found by a window in each range of doc_id; the first row of a range is also
dealt to the range before. Texts are shuffled once.

Edge cases: a null text counts as empty; an empty text has no digests, and two of them have likeness 1. A null doc_id
comes first, equal doc_ids follow in the order of their texts' hashes; a single row is followed by itself. An empty
table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import doc_rows

PIECE, BASE, GROUP = 160, 4, 8
#: Cells of each of the three tables of a group, by try.
TABLES = (12, 32)
ROUNDS = 10
#: UTF-8 bytes of a range's texts, about, and ranges at most: their borders are literals, looked up in two steps. Beyond
#: that many, ranges grow; a range is sorted by a window that spills, so it needn't fit into memory.
RANGE_BYTES, RANGES = 4 << 20, 1 << 15
_PARAGRAPH = rf"[^\n.!?|]{{1,{PIECE}}}[\n.!?|]*|[\n.!?|]+"


def digests(text: Column) -> Column:
    """The distinct paragraphs' digests."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _entry(key: Column, table: int, salt: int) -> Column:
    """A digest with its cells and its check."""
    return _let(F.xxhash64(key, F.lit(salt)), lambda h: F.struct(key.alias("k"), h.alias("h"), F.pmod(h, F.lit(table)).alias("a"), (F.pmod(F.shiftright(h, 16), F.lit(table)) + F.lit(table)).alias("b"), (F.pmod(F.shiftright(h, 32), F.lit(table)) + F.lit(2 * table)).alias("c")))


def _cell(n, k, h) -> Column:
    return F.struct(n.cast("int").alias("n"), k.alias("k"), h.alias("h"))


_NOTHING = lambda: _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))


def sketch(keys: Column, table: int, salt: int) -> Column:
    """3 * table cells (n, k, h) of an array of distinct digests."""

    def cells(entries: Column, place: str, first: int) -> Column:
        numbers = F.sequence(F.lit(first).cast("long"), F.lit(first + table - 1).cast("long"))
        return F.transform(numbers, lambda i: F.aggregate(F.filter(entries, lambda e: e[place] == i), _NOTHING(), lambda c, e: _cell(c["n"] + 1, c["k"].bitwiseXOR(e["k"]), c["h"].bitwiseXOR(e["h"]))))

    return _let(F.transform(keys, lambda k: _entry(k, table, salt)), lambda e: F.concat(cells(e, "a", 0), cells(e, "b", table), cells(e, "c", 2 * table)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["h"].bitwiseXOR(y["h"])))


def peel(difference: Column, table: int, salt: int) -> Column:
    """(done, found): found holds (k, n), n = 1 for digests of the first version alone, -1 for those of the second."""
    pair = "array<struct<k:bigint,n:int>>"

    def pure(cells: Column) -> Column:
        def signed(n: int) -> Column:
            single = F.filter(cells, lambda c: (c["n"] == n) & (c["h"] == F.xxhash64(c["k"], F.lit(salt))))
            return F.transform(F.array_distinct(F.transform(single, lambda c: c["k"])), lambda k: F.struct(F.lit(n).alias("n"), _entry(k, table, salt).alias("e")))

        return F.concat(signed(1), signed(-1))

    def without(cells: Column, found: Column) -> Column:
        def part(place: str, first: int) -> Column:
            return F.transform(F.slice(cells, first + 1, table), lambda c, i: F.aggregate(F.filter(found, lambda p: p["e"][place] == i + F.lit(first)), c, lambda x, p: _cell(x["n"] - p["n"], x["k"].bitwiseXOR(p["e"]["k"]), x["h"].bitwiseXOR(p["e"]["h"]))))

        return F.concat(part("a", 0), part("b", table), part("c", 2 * table))

    def empty(cells: Column) -> Column:
        return F.forall(cells, lambda c: (c["n"] == 0) & (c["k"] == 0))

    def step(state: Column, _: Column) -> Column:
        def take(found: Column) -> Column:
            rest = without(state["cells"], found)
            got = F.concat(state["found"], F.transform(found, lambda p: F.struct(p["e"]["k"].alias("k"), p["n"].alias("n"))))
            stuck = F.struct(state["cells"].alias("cells"), state["found"].alias("found"), F.lit(True).alias("over"))
            return F.when(F.size(found) == 0, stuck).otherwise(_let(rest, lambda r: F.struct(r.alias("cells"), got.alias("found"), empty(r).alias("over"))))

        return F.when(state["over"], state).otherwise(_let(pure(state["cells"]), take))

    def peeled(cells: Column) -> Column:
        # A digest is in three cells, so counts of more than the cells can't be taken apart.
        held = F.aggregate(cells, F.lit(0), lambda n, c: n + F.abs(c["n"]))
        start = F.struct(cells.alias("cells"), F.array().cast(pair).alias("found"), ((held == 0) & empty(cells) | (held > 3 * 3 * table)).alias("over"))
        last = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
        return _let(last, lambda s: F.struct(empty(s["cells"]).alias("done"), s["found"].alias("found")))

    return _let(difference, peeled)


def _deal(keys: Column, groups: Column) -> Column:
    """An array of so many arrays: first into about the root of their number, then each of those."""
    wide = F.ceil(F.sqrt(groups.cast("double"))).cast("long")

    def part(a: Column) -> Column:
        return _let(F.filter(keys, lambda k: F.floor(F.pmod(k, groups) / wide) == a), lambda some: F.transform(F.sequence(a * wide, F.least(a * wide + wide, groups) - 1), lambda g: F.filter(some, lambda k: F.pmod(k, groups) == g)))

    return F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.floor((groups - 1) / wide)), part))


def _group_difference(a: Column, b: Column) -> Column:
    """What two groups of digests differ in, by sketches of growing size."""
    exact = F.concat(F.transform(F.array_except(a, b), lambda k: F.struct(k.alias("k"), F.lit(1).alias("n"))), F.transform(F.array_except(b, a), lambda k: F.struct(k.alias("k"), F.lit(-1).alias("n"))))
    out = exact
    for salt, table in reversed(list(enumerate(TABLES, 1))):
        out = _tried(a, b, table, salt, out)
    return out


def _tried(a: Column, b: Column, table: int, salt: int, larger: Column) -> Column:
    return _let(peel(subtract(sketch(a, table, salt), sketch(b, table, salt)), table, salt), lambda r: F.when(r["done"], r["found"]).otherwise(larger))


def with_difference(df: DataFrame, name: str, a: str, b: str, sketch_a: str, sketch_b: str) -> DataFrame:
    """Adds name: (k, n) of the digests that the columns a and b of digests differ in, and name_larger: whether the
    fingerprints sketch_a and sketch_b were too small."""
    df = df.withColumn("_small", peel(subtract(F.col(sketch_a), F.col(sketch_b)), BASE, 0))
    df = df.withColumn("_groups", F.greatest(F.lit(1), F.ceil((F.size(a) + F.size(b)) / (2 * GROUP))).cast("long"))
    larger = ~F.col("_small.done")
    some = lambda c: F.when(larger, _deal(F.col(c), F.col("_groups")))
    df = df.withColumn("_a", some(a)).withColumn("_b", some(b))
    parts = F.flatten(F.zip_with("_a", "_b", lambda x, y: _group_difference(x, y)))
    return df.withColumn(name, F.when(larger, parts).otherwise(F.col("_small.found"))).withColumn(f"{name}_larger", larger).drop("_small", "_groups", "_a", "_b")


def likeness(found: Column, size_a: Column, size_b: Column) -> Column:
    """Of the digests that either version has, the share that both have."""
    only_a = F.size(F.filter(found, lambda d: d["n"] == 1))
    only_b = F.size(F.filter(found, lambda d: d["n"] == -1))
    return F.when(size_a + size_b == 0, F.lit(1.0)).otherwise((size_a - only_a) / (size_a + only_b))


def to_hex(cells: Column) -> Column:
    word = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    return F.array_join(F.transform(cells, lambda c: F.concat(word(c["n"].cast("long"), 4), word(c["k"], 16), word(c["h"], 16))), "")


def _range_of(value: Column, borders: list[int]) -> Column:
    """How many of the ascending borders are at most the value: among every so many-th, then among those between."""
    if not borders:
        return F.lit(0)
    width = max(1, int(len(borders) ** 0.5))
    runs = [borders[k : k + width] for k in range(0, len(borders), width)]
    longs = lambda some: F.array(*[F.lit(b).cast("long") for b in some])
    upto = lambda some: F.size(F.filter(some, lambda b: b <= value))
    return _let(F.greatest(upto(longs([r[0] for r in runs])) - 1, F.lit(0)), lambda run: run * width + upto(F.get(F.array(*map(longs, runs)), run)))


def with_next(docs: DataFrame) -> DataFrame:
    """Adds next_text and next_keys, of the next row in the order of doc_id (after the last: the first)."""
    rows = doc_rows(docs).withColumn("ord", F.coalesce("doc_id", F.lit(-(1 << 63))))
    held = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = max(1, min(RANGES, held // RANGE_BYTES))
    accuracy = 100_000 if count < 10_000 else 1_000_000
    borders = sorted({int(x) for x in (rows.select(F.percentile_approx("ord", [k / count for k in range(1, count)], accuracy)).first()[0] or [])}) if count > 1 else []
    bucket = _range_of(F.col("ord"), borders)
    least = {r["bucket"]: r["least"] for r in rows.select(bucket.alias("bucket"), "ord").groupBy("bucket").agg(F.min("ord").alias("least")).collect()}  # a row a range
    full = sorted(least)
    if not full:
        return rows.withColumn("keys", digests(F.col("text"))).withColumn("next_text", F.col("text")).withColumn("next_keys", F.col("keys"))
    # For each range the least key, the range before it (before the first: the last), and whether that wraps around.
    at = {b: k for k, b in enumerate(full)}
    edges = [(least.get(b), full[at.get(b, 0) - 1], int(at.get(b) == 0)) for b in range(len(borders) + 1)]
    table = F.array(*[F.struct(F.lit(low).cast("long").alias("least"), F.lit(before).alias("before"), F.lit(wrap).alias("wrap")) for low, before, wrap in edges])
    rows = rows.withColumn("bucket", bucket).withColumn("_edge", F.get(table, F.col("bucket"))).withColumn("keys", digests(F.col("text")))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("wrap"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.col("_edge.before").alias("bucket"), F.col("_edge.wrap").alias("wrap"), F.lit(True).alias("ghost"))
    dealt = rows.withColumn("_to", F.explode(F.when(F.col("ord") == F.col("_edge.least"), F.array(own, ghost)).otherwise(F.array(own))))
    dealt = dealt.select("doc_id", "text", "keys", "ord", F.col("_to.bucket").alias("bucket"), F.col("_to.wrap").alias("wrap"), F.col("_to.ghost").alias("ghost")).withColumn("tie", F.xxhash64("text"))
    order = Window.partitionBy("bucket").orderBy("wrap", "ord", "tie", "ghost")
    return dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("next_keys", F.lead("keys").over(order)).where("not ghost")


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """For every row: its own and its edited text's fingerprint, and their likeness to each other and to the next row's."""
    df = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    df = df.withColumn("edited", F.concat(F.left("text", F.col("n_chars").cast("int") - quarter), F.left("next_text", quarter)))
    df = df.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "keys", "next_keys", digests(F.col("edited")).alias("edited_keys"))
    for name in ("keys", "edited_keys", "next_keys"):
        df = df.withColumn(f"{name}_sketch", sketch(F.col(name), BASE, 0))
    for name in ("edited", "next"):
        df = with_difference(df, f"{name}_diff", "keys", f"{name}_keys", "keys_sketch", f"{name}_keys_sketch")
    size = lambda c: F.size(c).cast("double")
    return df.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        to_hex(F.col("keys_sketch")).alias("fingerprint"),
        to_hex(F.col("edited_keys_sketch")).alias("edited_fingerprint"),
        likeness(F.col("edited_diff"), size("keys"), size("edited_keys")).alias("near_edited"),
        likeness(F.col("next_diff"), size("keys"), size("next_keys")).alias("near_next"),
        "edited_diff",
        "next_diff",
    )


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("edited_diff", "next_diff")
