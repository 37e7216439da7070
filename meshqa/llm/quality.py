"""Operator 1: quality rules. Base rules on words, lines and repeated windows, then a hashed n-gram log-likelihood
ratio between a trusted target and the raw corpus, normalised by length, with one fixed threshold for every document."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshqa.llm.common import WORD, table, whole_row, words

BUCKETS = 65536
#: Pseudo-count of a bucket in the raw multinomial, and of the whole raw multinomial in the target's.
SMOOTHING, PULL = 8.0, 131072.0
#: A ratio is shrunk by this many standard errors of the target's count, to 0 at most: rare n-grams say little.
CHANCE = 3.0
#: Ratios are held as whole thousandths, so that sums do not depend on the order of adding.
SCALE = 1000
#: A document is kept if its mean log-likelihood ratio (natural log, a feature) is at least this. On 10,000 documents, with
#: ratios trained without one of five folds, labelled documents of the other four that pass the base rules lay at -0.051
#: and below (quality 0) and at -0.023 and above (quality 1).
THRESHOLD = -0.045
MIN_WORDS = 50
#: Parts that rows without id are dealt to.
SPREAD = 4096
MAX_REPEAT_PERCENT = 50


def _features(hashes: Column) -> Column:
    """Buckets of the words and word pairs, from the words' hashes."""
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    two = F.transform(
        F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))),
        lambda h, i: F.pmod(F.xxhash64(F.get(hashes, i), h), F.lit(BUCKETS)).cast("int"),
    )
    return F.concat(one, two)


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def fit(docs: DataFrame, trusted: DataFrame) -> list[int]:
    """The log-likelihood ratio of each bucket in thousandths: counts over all rows of docs, and over those whose doc_id
    is in trusted. BUCKETS rows come to the driver, however large the corpus. Without trusted text every ratio is 0."""
    ids = trusted.select(F.col("doc_id").alias("trusted_id"), F.lit(0).alias("trusted_spread")).where("trusted_id is not null").distinct()
    # rows without id meet none; they are spread, so that they do not all go to one task
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(SPREAD)).cast("int")).otherwise(F.lit(0))
    flagged = (
        docs.select("doc_id", "text", spread.alias("spread"))
        # trusted ids grow with the corpus, so they are never broadcast
        .join(ids.hint("merge"), (F.col("doc_id") == F.col("trusted_id")) & (F.col("spread") == F.col("trusted_spread")), "left")
        .select(_hashes(F.col("text")).alias("h"), F.col("trusted_id").isNotNull().cast("long").alias("t"))
    )
    counts = flagged.select("t", F.explode(_features(F.col("h"))).alias("b")).groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in counts.collect():
        raw[r.b], target[r.b] = r.raw, r.target
    return ratios(raw, target)


def ratios(raw: list[int], target: list[int]) -> list[int]:
    all_raw, all_target = sum(raw), sum(target)
    if not all_target:
        return [0] * len(raw)
    part, spread, out = all_target / all_raw, SMOOTHING * len(raw), []
    for r, t in zip(raw, target):
        p = (r + SMOOTHING) / (all_raw + spread)
        q = (t + PULL * p) / (all_target + PULL)
        error = math.sqrt(r * part * (1 - part))
        off = abs(t - r * part)
        out.append(round(SCALE * math.log(q / p) * (1 - CHANCE * error / off)) if off > CHANCE * error else 0)
    return out


def base_columns(docs: DataFrame, *more: str) -> DataFrame:
    """docs (doc_id, text) and columns `more` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the words' hashes `_h`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    with_words = docs.select(
        "doc_id",
        *more,
        _hashes(F.col("text")).alias("_h"),
        (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)).alias("_lines"),
    )
    h = F.col("_h")
    windows = with_words.withColumn(
        "_w",
        F.transform(F.slice(h, 3, F.greatest(F.size(h) - 2, F.lit(0))), lambda c, i: F.xxhash64(F.get(h, i), F.get(h, i + 1), c)),
    )
    w = F.col("_w")
    ordered = windows.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct(w)) < F.size(w),
            F.sort_array(F.transform(w, lambda c, i: F.struct(c.alias("w"), i.alias("i")))),
        ),
    )
    s = F.col("_s")
    same = lambda at, c: F.coalesce(F.get(s, at)["w"] == c["w"], F.lit(False))
    repeated = ordered.withColumn(
        "_p",
        F.sort_array(
            F.transform(
                F.filter(F.transform(s, lambda c, i: F.struct(c["i"].alias("i"), (same(i - 1, c) | same(i + 1, c)).alias("r"))), lambda c: c["r"]),
                lambda c: c["i"],
            )
        ),
    )
    p = F.col("_p")
    covered = F.aggregate(F.transform(p, lambda c, i: F.least(F.coalesce(F.get(p, i + 1) - c, F.lit(3)), F.lit(3)).cast("long")), F.lit(0).cast("long"), lambda a, c: a + c)
    measured = repeated.select(
        "doc_id",
        *more,
        "_h",
        F.size("_h").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.monotonically_increasing_id().alias("_at"),
    ).withColumn("n_repeat_words", F.when(F.col("_at") >= 0, F.col("n_repeat_words")).otherwise(F.lit(0)))
    # _at, which is never negative, holds filters above these projections: pushed through them, a filter would hold each
    # of their nested expressions many times over
    return measured


def judge(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text; other columns are not read): the base columns, base_failed, llr
    (mean ratio a feature, 0 without words) and kept.

    Null text has no words and fails the base rules. Texts of any length are read whole. Null and repeated ids are judged
    like any other row; a repeated id that is trusted is so in each of its rows. A ratio at the threshold is kept. An
    empty table gives an empty result. Without trusted documents the ratio is 0 throughout and only the base rules decide.
    """
    return _judged(base_columns(docs.select("doc_id", "text")), fit(docs, trusted)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def keep(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, columns as given, whatever their names: judged in one pass, without a join
    back. Nulls, empty and long texts, repeated rows and an empty table as in judge(); repeated rows are kept alike."""
    held = docs.select("doc_id", "text", whole_row(docs).alias("_row"))
    return _judged(base_columns(held, "_row"), fit(docs, trusted)).where("kept").select("_row.*")


def _judged(base: DataFrame, ratio: list[int]) -> DataFrame:
    table_of_ratios = F.split(F.lit(",".join(map(str, ratio))), ",").cast("array<int>")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    features = 2 * F.col("n_words") - 1
    total = F.aggregate(_features(F.col("_h")), F.lit(0).cast("long"), lambda a, b: a + F.get(table_of_ratios, b))
    llr = F.when(features > 0, total / features / SCALE).otherwise(F.lit(0.0))
    return (
        base.withColumn("base_failed", failed)
        .withColumn("llr", llr)
        .withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(THRESHOLD)))
    )


def trusted_documents(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("quality") == 1).select("doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), trusted_documents(table(spark, sf_dir, "labels")))
