"""Operator 4: mixing sources to target weights. Words are summed for each source, weights become targets and repetition
rates, and a document is emitted floor(rate) times plus one hash-seeded Bernoulli copy with the fraction as probability.

Of SEEDS seeds a source takes the one whose copies come nearest its target. So the draws of a source are Bernoulli for
each seed, and conditioned on their sum by the choice: a document's probability is the fraction only nearly, and more
nearly the more documents a source has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshqa.llm.common import fraction, n_words, table, whole_row, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
#: Seeds that each source tries; it keeps the one whose copies come nearest its target. Four to an MD5.
SEEDS = 16
#: Rows of the plan (one a source) up to which it is broadcast; beyond, Spark joins by shuffle.
BROADCAST_SOURCES = 10_000


def _coin(k: int):
    return fraction(F.lit(f"mix{k // 4}"), F.col("doc_id"), at=k % 4)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """source, source_size -> also target: weights repeat over the sources by code point, null last; a target stops at
    `most` times its source's size and what it leaves goes to the others by weight, until none is above."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    sized = sizes.withColumn("w", weight.cast("double")).withColumn("cap", (most * F.col("source_size")).cast("double"))
    by_room = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    levelled = sized.withColumn("level", level).withColumn("nth", F.row_number().over(by_room))
    # the sources before the first whose share stays within its cap are full
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("nth", "level"))).over(everything)
    filled = levelled.withColumn("fill", first["level"])
    return filled.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("fill") * F.col("w"), F.col("cap"))).alias("target"))


def plan(sized: DataFrame) -> DataFrame:
    """sized: doc_id, source, size, a row a document. A row a source: source, source_size, target, rate and seed."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rated = written(targets(sizes).withColumn("rate", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))), "mix-rates")
    part = F.col("rate") - F.floor("rate")
    tried = _with_plan(sized, rated).groupBy("source").agg(*[F.sum(F.when(_coin(k) < part, F.col("size")).otherwise(0)).alias(f"s{k}") for k in range(SEEDS)])
    sums = tried.select("source", F.array(*[f"s{k}" for k in range(SEEDS)]).alias("sums")).withColumnRenamed("source", "of")
    missing = F.col("target") - F.floor("rate") * F.col("source_size")
    tries = F.transform("sums", lambda s, i: F.struct(F.abs(s - missing).alias("off"), i.alias("seed")))
    best = rated.join(sums, F.col("source").eqNullSafe(F.col("of"))).withColumn("seed", F.array_min(tries)["seed"])
    return written(best.select("source", "source_size", "target", "rate", "seed"), "mix-plan")


def _with_plan(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs with the plan's columns of their source. The plan has a row a source and is broadcast only where it is counted to be small."""
    renamed = plan.withColumnRenamed("source", "_source")
    if renamed.count() <= BROADCAST_SOURCES:
        renamed = F.broadcast(renamed)
    return docs.join(renamed, docs["source"].eqNullSafe(renamed["_source"])).drop("_source")


def copies(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs (doc_id, source, anything else) with the plan's columns and `copies`, how often the mix takes a document."""
    part = F.col("rate") - F.floor("rate")
    coin = F.get(F.array(*[_coin(k) for k in range(SEEDS)]), F.col("seed"))
    return _with_plan(docs, plan).withColumn("copies", (F.floor("rate") + F.when(coin < part, 1).otherwise(0)).cast("int"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: rows of docs, each as often as the mix takes it; columns as given.

    Null text has size 0, texts of any length are counted whole, a null source is a source of its own. Repeated ids share
    their coin, and all rows of a source without ids one coin too. Of seeds equally near a target the first is taken. An
    empty table stays empty. Other columns, whatever their names, are carried in a struct and come back unchanged.
    """
    held = docs.select(F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"), whole_row(docs).alias("_row"))
    made = plan(written(held.select("doc_id", "source", "size"), "mix-sizes"))
    taken = copies(held.select("doc_id", "source", "_row"), made).where("copies > 0")
    repeated = taken.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_n"))
    return repeated.select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    return copies(sized, plan(sized)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), s1 AS (
  SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s0
), s2 AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())
    - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS nth FROM s1
), s3 AS (
  SELECT *, arg_min(level, nth) FILTER (level * w <= cap) OVER () AS fill FROM s2
), rated AS (
  SELECT source, source_size, least(cap, coalesce(fill * w, cap))::DOUBLE AS target,
    coalesce(CASE WHEN source_size > 0 THEN least(cap, coalesce(fill * w, cap)) / source_size END, 0)::DOUBLE AS rate FROM s3
), coins AS (
  SELECT d.doc_id, d.source, d.size, k.k,
    ('0x' || substr(md5('mix' || (k.k // 4) || ':' || coalesce(d.doc_id::VARCHAR, '~')), 1 + 8 * (k.k % 4)::INT, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM sized d, range(16) k(k)
), tried AS (
  SELECT c.source, c.k, abs(sum(CASE WHEN u < rate - floor(rate) THEN size ELSE 0 END) - (any_value(target) - floor(any_value(rate)) * any_value(source_size))) AS off
  FROM coins c JOIN rated r ON c.source IS NOT DISTINCT FROM r.source GROUP BY c.source, c.k
), seeds AS (
  SELECT source, k FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY off, k) AS rn FROM tried) WHERE rn = 1
)
SELECT c.doc_id, c.size, r.source_size, r.target,
  (c.size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM coins c JOIN rated r ON c.source IS NOT DISTINCT FROM r.source
JOIN seeds s ON c.source IS NOT DISTINCT FROM s.source AND c.k = s.k
"""
