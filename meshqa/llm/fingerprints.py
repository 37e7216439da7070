"""Operator 9: document fingerprints by invertible Bloom lookup sketches.

A text is the set of its paragraphs, each a 64-bit digest: lines, cut after sentences, so that where a paragraph ends
depends on the text around that place alone. A sketch has three tables of cells; a digest goes to one cell of each, where
it is counted and its bits and a checksum are XORed in. Two versions are subtracted cell by cell: common paragraphs
cancel, and peeling recovers the others, as a cell with one digest left gives it away and frees its other cells. The
fingerprint is the smallest sketch. Where peeling it gets stuck, a larger sketch of the two sets is peeled, with cells
enough for all their paragraphs; where that gets stuck, one of sixteen times the cells, until none is. The digests that
differ, d of them, give the likeness of sets of a and b paragraphs: (a + b - d) / (a + b + d), their Jaccard index. So
likeness takes the paragraphs' digests besides the two fingerprints where more paragraphs differ than these can tell.

Cells are rows, empty ones none, and subtracting and peeling are aggregations; so cost follows the paragraphs and not the
cells. A round of peeling looks at one table, in which a digest has one cell; so none is taken twice.

Everything is DataFrame functions. The next document is found without a global window: rows are cut into blocks at
quantiles of their ids, rows of one frequent id or none by their texts' hashes; each block's first row is also sent to
the block before it, and windows run inside blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshqa.llm.common import WORD, new_path, table

#: A paragraph ends at a line's or a sentence's end.
PARAGRAPH_END = r"\n|(?<=[.!?]) +"
#: Cells of one of a fingerprint's three tables.
CELLS, TABLES = 8, 3
#: A larger sketch has so many cells a paragraph in each table, the next so many times more.
ROOM, LARGER = 8, 16
#: Peeling looks at each table so many times.
TIMES = 2
#: Rows that a block should have; quantiles that are cut at, and the most blocks.
BLOCK_ROWS, QUANTILES, MOST_BLOCKS = 2000, 4096, 65536
#: Rows whose cells one task holds.
TASK_ROWS = 1500
_BIT = 1 << 40


def digests(text: Column) -> Column:
    """The set of paragraph digests of a text."""
    return F.array_distinct(F.transform(F.filter(F.split(text, PARAGRAPH_END, -1), lambda x: x.rlike(WORD)), lambda x: F.xxhash64(x)))


def _cell(x: str, t: int, cells: str) -> str:
    """SQL for the cell of digest x in table t; cells is a power of two."""
    return f"({t * _BIT}L + (xxhash64({t}, {x}) & ({cells} - 1)))"


def sketch(digest: DataFrame, keys: list[str], cells: str, sign: str = "1") -> DataFrame:
    """keys, cell, n, x, h: the cells that are not empty of the digests (x) of each key; sign and cells (of one table) are
    SQL. What has sign -1 is subtracted."""
    at = ", ".join(_cell("x", t, cells) for t in range(TABLES))
    dealt = digest.select(*keys, F.expr(f"cast({sign} as long)").alias("n"), "x", F.expr(f"xxhash64({TABLES}, x)").alias("h"), F.expr(f"explode(array({at}))").alias("cell"))
    return _summed(dealt, keys)


def _summed(entries: DataFrame, keys: list[str]) -> DataFrame:
    cells = entries.groupBy(*keys, "cell").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("h").alias("h"))
    return cells.where("n <> 0 or x <> 0 or h <> 0")


def peeled(cells: DataFrame, keys: list[str], size: str) -> DataFrame:
    """keys, d: how many digests peeling recovers from subtracted sketches; null if it gets stuck. Equal sets have no cell
    and so no row. `size` is SQL for the cells of a table, over keys."""
    found = "named_struct('cell', -1L, 'n', 1L, 'x', 0L, 'h', 0L)"
    for t in [*range(TABLES)] * TIMES:
        pure = f"cell >= {t * _BIT}L and cell < {(t + 1) * _BIT}L and abs(n) = 1 and h = xxhash64({TABLES}, x)"
        # the digest's own cell is then empty; it goes from its other two
        freed = [f"named_struct('cell', {_cell('x', o, size)}, 'n', -n, 'x', x, 'h', h)" for o in range(TABLES) if o != t]
        stays = "named_struct('cell', cell, 'n', n, 'x', x, 'h', h)"
        cells = _summed(cells.select(*keys, F.expr(f"inline(if({pure}, array({found}, {', '.join(freed)}), array({stays})))")), keys)
    left = cells.groupBy(*keys).agg(F.count(F.when(F.col("cell") >= 0, 1)).alias("stuck"), F.sum(F.when(F.col("cell") < 0, F.col("n"))).alias("d"))
    return left.select(*keys, F.when(F.col("stuck") == 0, F.col("d")).alias("d"))


def _sides(pairs: DataFrame, *keys: str) -> DataFrame:
    """keys, side (1, -1) and x: the digests of both sides (a, b) of pairs, in rows."""
    return pairs.select(*keys, F.expr("inline(array(named_struct('side', 1, 'xs', a), named_struct('side', -1, 'xs', b)))")).select(*keys, "side", F.explode("xs").alias("x"))


def _room(*sizes: str) -> str:
    """SQL for a power of two that is ROOM to 2 * ROOM times the sum of sizes, and larger than a fingerprint's."""
    return f"cast(greatest({2 * CELLS}, shiftleft(1L, cast(floor(log2(greatest(1, {2 * ROOM} * ({' + '.join(sizes)})))) as int))) as bigint)"


def differences(sets: DataFrame) -> DataFrame:
    """sets: r (unique) and sets, three arrays of digests. A row for each r and each other set (p: 1, 2) that differs from
    the first, with d, by how many digests."""
    levels = [f"named_struct('p', {p}, 'size', {size}, 'a', sets[0], 'b', sets[{p}])" for p in (1, 2) for size in (f"{CELLS}L", _room("size(sets[0])", f"size(sets[{p}])"))]
    keys = ["r", "p", "size"]
    tried = peeled(sketch(_sides(sets.select("r", F.expr(f"inline(array({', '.join(levels)}))")), *keys), keys, "size", "side"), keys, "size")
    # without its own size, which equals the fingerprint's for tiny sets, a pair has one row a size
    return tried.groupBy("r", "p").agg(F.min_by("d", F.when(F.col("d").isNotNull(), F.col("size"))).alias("d"), F.max("size").alias("size"))


def _resolved(spark: SparkSession, sets: DataFrame, scratch: list[str]) -> DataFrame:
    """differences(), and for pairs that got stuck ever larger sketches until none is. What is open is written each time;
    one number comes to the driver."""

    def kept(df: DataFrame) -> DataFrame:
        scratch.append(new_path(spark, "fingerprint-distances"))
        df.write.parquet(scratch[-1])
        return spark.read.schema(df.schema).parquet(scratch[-1])

    known = kept(differences(sets))
    done, stuck = known.where("d is not null").select("r", "p", "d"), known.where("d is null").select("r", "p", "size")
    while stuck.limit(1).count():
        keys = ["r", "p", "size"]
        pairs = stuck.join(sets, "r").select("r", "p", (F.col("size") * LARGER).alias("size"), F.expr("sets[0]").alias("a"), F.expr("sets[p]").alias("b"))
        known = kept(peeled(sketch(_sides(pairs, *keys), keys, "size", "side"), keys, "size"))
        done = done.unionByName(known.where("d is not null").select("r", "p", "d"))
        stuck = known.where("d is null").select("r", "p", "size")
    return done


def written_out(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fingerprint: for each cell that is not empty its number, count, digests and checksums in hexadecimal digits
    (2, 8, 16 and 16 of them), in the order of cells."""
    digits = lambda v, n: F.lpad(F.lower(F.hex(v)), n, "0")
    number = F.expr(f"cast(cell div {_BIT}L * {CELLS} + cell % {_BIT}L as int)")
    text = F.concat(digits(number, 2), digits(F.col("n"), 8), digits(F.col("x"), 16), digits(F.col("h"), 16))
    return cells.select(*keys, text.alias("t")).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("t")), "").alias("fingerprint"))


def _placed(rows: DataFrame) -> DataFrame:
    """rows (doc_id, _tie) with _block, numbered in the order of descending ids (null last), then of ties."""
    r = rows.agg(F.count("*").alias("all"), F.count("doc_id").alias("n"), F.percentile_approx("doc_id", [k / QUANTILES for k in range(QUANTILES + 1)], 20_000).alias("q")).first()
    wanted = max(1, -(-r.all // BLOCK_ROWS))
    parts = 1 << min(12, (wanted - 1).bit_length())
    coarse_cuts = min(wanted, QUANTILES)
    q = [r.q[round(k * QUANTILES / coarse_cuts)] for k in range(coarse_cuts + 1)] if r.n else []
    cuts = sorted(set(q))
    often = sorted(x for x in cuts if q.count(x) > 1) if len(cuts) < len(q) else []
    inner = max(1, min(MOST_BLOCKS // QUANTILES, -(-r.n // (BLOCK_ROWS * QUANTILES))))
    array = lambda values, kind="bigint": F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")
    doc, part = F.col("doc_id"), (F.shiftright("_tie", 52) + 2048).cast("long")
    part = F.floor(part * parts / 4096).cast("long")
    # two steps of at most 64 comparisons: first among every 64th cut
    coarse = F.size(F.filter(array(cuts[63::64]), lambda c: c <= doc))
    below = coarse * 64 + F.size(F.filter(F.slice(array(cuts), coarse * 64 + 1, F.lit(64)), lambda c: c <= doc))
    low, high = F.get(array(cuts), below - 1), F.get(array(cuts), below)
    step = F.when(low.isNull() | high.isNull(), F.lit(0)).otherwise(F.least(F.lit(inner - 1), F.floor((high - 1 - doc).cast("double") * inner / (high - low)))).cast("long") if inner > 1 else F.lit(0).cast("long")
    at_cut = F.array_contains(array(often), doc) if often else F.lit(False)
    place = (F.lit(len(cuts)) - below).cast("long") * 2 + F.when(at_cut, 1).otherwise(0)
    width = inner * parts
    block = F.when(doc.isNull(), F.lit(2 * len(cuts) + 2) * width + part).when(at_cut, place * width + part).otherwise(place * width + step)
    return rows.withColumn("_block", block.cast("long"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text: the text of the next row by descending doc_id (null last, equal ids by their texts'
    hash); after the last row comes the first. Texts are shuffled once."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    placed = _placed(rows)
    first = F.struct((-F.col("doc_id")).alias("id"), F.col("_tie").alias("tie"))
    # some MOST_BLOCKS rows: the first row of each block, for the block before it
    heads = placed.groupBy("_block").agg(F.min(first).alias("first")).withColumnRenamed("_block", "_of")
    order = Window.orderBy("_of")
    before = F.coalesce(F.lag("_of").over(order), F.max("_of").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = F.broadcast(heads.select("_of", "first", before.alias("_before")))
    own = F.struct(F.col("_block").alias("b"), F.lit(False).alias("copy"))
    # rows that tie with the first are sent too; they are equal, and one is as good as another
    sent = placed.join(heads, (F.col("_block") == F.col("_of")) & first.eqNullSafe(F.col("first")), "left").select(
        "doc_id", "text", "_tie", F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("_before").alias("b"), F.lit(True).alias("copy"))))).alias("_to")
    )
    inside = Window.partitionBy("_to.b").orderBy("_to.copy", F.col("doc_id").desc_nulls_last(), "_tie")
    return sent.withColumn("next_text", F.lead("text").over(inside)).where("not _to.copy").select("doc_id", "text", "next_text")


def fingerprint(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text; others are not read): doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    Null text counts as empty. A text without paragraphs has an empty fingerprint and likeness 1 to another such. Texts
    of any length are read whole; their paragraphs are rows, so a very long one is no row of many cells. A single row is
    its own next document. Null ids come last, rows of equal ids in the order of their texts' hashes; repeated rows are
    next to each other. An empty table gives an empty result.
    """
    spark, pair = docs.sparkSession, with_next(docs)
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    edited = pair.select("doc_id", n.cast("long").alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"), "text", "next_text")
    path = new_path(spark, "fingerprint-sets")
    of_row = edited.select(
        F.monotonically_increasing_id().alias("r"), "doc_id", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        F.array(*[digests(F.col(c)) for c in ("text", "edited", "next_text")]).alias("sets"),
    ).withColumn("sizes", F.transform("sets", lambda s: F.size(s)))
    of_row.write.parquet(path)
    rows = spark.read.schema(of_row.schema).parquet(path)
    # all that follows is dealt by r, to tasks that hold their cells in memory
    sets = rows.select("r", "sets").repartition(max(1, min(MOST_BLOCKS, -(-rows.count() // TASK_ROWS))), "r")
    scratch: list[str] = []
    d = _resolved(spark, sets, scratch).groupBy("r").agg(*[F.max(F.when(F.col("p") == p, F.col("d"))).alias(f"d{p}") for p in (1, 2)])
    of_set = sets.select("r", F.posexplode("sets").alias("p", "xs")).where("p < 2").select("r", "p", F.explode("xs").alias("x"))
    marks = written_out(sketch(of_set, ["r", "p"], f"{CELLS}L"), ["r", "p"]).groupBy("r").agg(*[F.max(F.when(F.col("p") == p, F.col("fingerprint"))).alias(f"f{p}") for p in (0, 1)])
    both = rows.select("r", "doc_id", "n_chars", "edited_sha256", "sizes").join(marks, "r", "left").join(d, "r", "left")
    text = lambda p: F.coalesce(f"f{p}", F.lit(""))
    return both.select("doc_id", "n_chars", "edited_sha256", text(0).alias("fingerprint"), text(1).alias("edited_fingerprint"), likeness(1).alias("near_edited"), likeness(2).alias("near_next"))


def likeness(p: int) -> Column:
    d, n = F.coalesce(f"d{p}", F.lit(0)), F.get("sizes", F.lit(0)) + F.get("sizes", F.lit(p))
    return F.when(n + d == 0, F.lit(1.0)).otherwise((n - d) / (n + d)).cast("double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents"))
