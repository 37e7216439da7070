"""Operator 7: toxicity. A linear classifier over character n-grams whose features are scaled by naive Bayes log-count
ratios (NB-LR), trained on labelled text.

A feature is the presence of an n-gram of 3 to 6 characters of the lower-cased text in which runs of white space are one
space, hashed to TABLE places. r is its smoothed log-count ratio between the classes; features whose ratio stands out
from chance are kept, scaled by r, and weighed by a logistic regression. Its offset is moved from the balanced sample to
the labels' own share, so that 0.5 is the likelier class.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshqa.llm.common import new_path, table, whole_row
from meshqa.sources.scratch import removed

SIZES = (3, 4, 5, 6)
TABLE = 1 << 20
#: Bound of the training sample: rows a class, in the order of a hash of their ids. Their texts are read whole.
SAMPLE_ROWS = 3000
#: An n-gram is kept if |r| is this many standard errors, and at most so many are. The first is that of 2, 3, 4 and 5 which
#: has the least log loss in cross-validation over the training folds.
STANDS_OUT, FEATURES = 4.0, 30_000
RIDGE, STEPS = 1e-3, 300
FOLDS = 5


def places(text: str) -> np.ndarray:
    """The table places of all n-grams of a text, repeats included."""
    codes = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out, h = [], codes * np.uint32(2654435761)
    for n in range(2, max(SIZES) + 1):
        if len(h) < 2:
            break
        h = h[:-1] * np.uint32(40503) ^ (h[:-1] >> np.uint32(15)) ^ (codes[n - 1 :] + np.uint32(n)) * np.uint32(2246822519)
        if n in SIZES:
            mixed = (h ^ (h >> np.uint32(16))) * np.uint32(2146121005)
            out.append(mixed >> np.uint32(12))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass
class Model:
    """weights: what the presence of a place adds to the log-odds; 0 for places that are no features."""

    at: np.ndarray
    weight: np.ndarray
    offset: float

    def dense(self) -> np.ndarray:
        out = np.zeros(TABLE, np.float32)
        out[self.at] = self.weight
        return out

    def scorer(self):
        weights, is_feature, offset = self.dense(), np.zeros(TABLE, bool), self.offset
        is_feature[self.at] = True

        def score(text: str) -> float:
            p = places(text)
            hit = np.unique(p[is_feature[p]])
            return float(1 / (1 + np.exp(-np.clip(offset + weights[hit].astype(np.float64).sum(), -500, 500))))

        return score


def train(texts: list[str], toxic: list[int], share: float | None = None) -> Model:
    """share: of label 1 among all labelled rows, if the sample's differs. With one class or none, the share alone decides."""
    y = np.asarray(toxic, np.float64)
    n1, n0 = y.sum(), (1 - y).sum()
    prior = _prior(share if share is not None else (n1 + 0.5) / (n1 + n0 + 1))
    if not n1 or not n0:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), prior)
    # places are found twice, so that only those of one text are held at a time
    keep, scaled = standing_out(count_places(texts, toxic), n1, n0)
    column = columns_of(keep)
    return weighed([c[c >= 0] for c in (column[np.unique(places(text))] for text in texts)], y, keep, scaled, prior)


def _prior(share: float) -> float:
    share = min(1 - 1e-6, max(1e-6, share))
    return float(np.log(share / (1 - share)))


def count_places(texts: Iterable[str], toxic: Iterable[int], counts: np.ndarray | None = None) -> np.ndarray:
    """In how many texts of each class a place occurs, added to counts."""
    counts = np.zeros((2, TABLE)) if counts is None else counts
    for text, t in zip(texts, toxic):
        counts[t, np.unique(places(text))] += 1
    return counts


def standing_out(counts: np.ndarray, n1: float, n0: float) -> tuple[np.ndarray, np.ndarray]:
    """The places that are features, ascending, and their ratios."""
    a, b = counts[1] + 1, counts[0] + 1
    r = np.log(a / (n1 + 2)) - np.log(b / (n0 + 2))
    z = np.abs(r) / np.sqrt(1 / a + 1 / b)
    keep = np.flatnonzero(z > STANDS_OUT)
    keep = np.sort(keep[np.argsort(-z[keep], kind="stable")[:FEATURES]])
    return keep, r[keep]


def columns_of(keep: np.ndarray) -> np.ndarray:
    """The number of each place among the features, -1 for others."""
    column = np.full(TABLE, -1, np.int32)
    column[keep] = np.arange(len(keep))
    return column


def weighed(sparse: list[np.ndarray], y: np.ndarray, keep: np.ndarray, scaled: np.ndarray, prior: float) -> Model:
    """The logistic regression; sparse: the features that each text has."""
    n1, n0 = y.sum(), (1 - y).sum()
    col = np.concatenate(sparse)
    row = np.repeat(np.arange(len(sparse)), [len(c) for c in sparse])
    # each class counts for half, whatever its rows
    importance = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    w, c, m, v, mc, vc = np.zeros(len(keep)), 0.0, np.zeros(len(keep)), np.zeros(len(keep)), 0.0, 0.0
    for step in range(1, STEPS + 1):
        logit = np.bincount(row, (w * scaled)[col], len(sparse)) + c
        error = (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - y) * importance
        g, gc = np.bincount(col, error[row], len(keep)) * scaled + RIDGE * w / max(1, len(keep)) ** 0.5, error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mc, vc = 0.9 * mc + 0.1 * gc, 0.99 * vc + 0.01 * gc * gc
        rate = 0.02 / (1 - 0.9**step) * (1 - 0.99**step) ** 0.5
        w, c = w - rate * m / (np.sqrt(v) + 1e-9), c - rate * mc / (np.sqrt(vc) + 1e-9)
    return Model(keep, (w * scaled).astype(np.float32), float(c + prior))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS: 0 is held out. A null id is never held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % FOLDS, F.lit(1))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from a bounded sample of labelled rows outside the held-out fold: SAMPLE_ROWS a class at most, which also
    bounds what is broadcast and what comes to the driver. Texts are read whole."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(fold(F.col("doc_id")) != 0).select(F.col("doc_id").alias("labelled"), F.col("toxic").cast("int").alias("toxic"))
    total = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    if not total.n:
        return train([], [], 0.0)
    by_hash = [F.xxhash64("labelled"), F.col("labelled")]
    sample = None
    for t in (0, 1):
        part = known.where(F.col("toxic") == t).groupBy("labelled", "toxic").count().drop("count").orderBy(*by_hash).limit(SAMPLE_ROWS)
        sample = part if sample is None else sample.unionByName(part)
    path = new_path(docs.sparkSession, "toxicity-sample")
    rows = (
        docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .join(F.broadcast(sample), F.col("doc_id") == F.col("labelled"))
        .groupBy("labelled", "toxic").agg(F.min("text").alias("text"))
    )
    rows.write.parquet(path)
    model = _fit(docs.sparkSession.read.schema(rows.schema).parquet(path), total.t / total.n)
    removed(docs.sparkSession, path)
    return model


def _fit(rows: DataFrame, share: float) -> Model:
    """train() over rows (labelled, toxic, text). Texts stay on the executors: what comes to the driver is a count a class
    for each of TABLE places, and a bit a feature for each row."""
    of = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(of) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), _prior(share))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, TABLE), np.int64)
        for b in batches:
            count_places(b["text"], b["toxic"], counts)
        at = np.flatnonzero(counts.any(axis=0))
        for k in range(0, len(at), 1 << 16):
            part = at[k : k + (1 << 16)]
            yield pd.DataFrame({"place": part, "n0": counts[0, part], "n1": counts[1, part]})

    sums = rows.select("text", "toxic").mapInPandas(counted, "place int, n0 long, n1 long").groupBy("place").agg(*[F.sum(c).cast("int").alias(c) for c in ("n0", "n1")]).toArrow()
    counts, at = np.zeros((2, TABLE)), sums["place"].to_numpy()
    counts[0, at], counts[1, at] = sums["n0"].to_numpy(), sums["n1"].to_numpy()
    keep, scaled = standing_out(counts, of[1], of[0])
    del sums, counts, at
    shared = rows.sparkSession.sparkContext.broadcast(keep)  # FEATURES places at most

    @F.pandas_udf("binary")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        column = columns_of(shared.value)
        for texts in batches:
            out = []
            for text in texts:
                has, c = np.zeros(len(shared.value), bool), column[places(text)]
                has[c[c >= 0]] = True
                out.append(np.packbits(has).tobytes())
            yield pd.Series(out, dtype="object")

    found = rows.select(F.xxhash64("labelled").alias("h"), "labelled", "toxic", features("text").alias("has")).collect()
    found.sort(key=lambda r: (r.h, r.labelled, r.toxic))
    sparse = [np.flatnonzero(np.unpackbits(np.frombuffer(r.has, np.uint8), count=len(keep))).astype(np.int32) for r in found]
    return weighed(sparse, np.asarray([r.toxic for r in found], np.float64), keep, scaled, _prior(share))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, anything else) with `score`, the probability of label 1. Null text is scored as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights at most

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = shared.value.scorer()
        for texts in batches:
            yield pd.Series([of(t) for t in texts], dtype="float64")

    return docs.withColumn("score", scored(F.coalesce(F.col("text"), F.lit(""))))


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that score below 0.5, columns as given, whatever their names. Null and empty texts, repeated rows
    and an empty table as in judge()."""
    return score(docs.select("text", whole_row(docs).alias("_row")), model).where("score < 0.5").select("_row.*")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text; others are not read): doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without n-grams; texts of any length are read whole, in training too.
    Null ids are not held out and never train; repeated rows are scored alike. Of rows that share a labelled id, that
    with the least text trains, and an id with both labels trains once for each. A score of 0.5 is toxic. Labels that are
    null or neither 0 nor 1 do not train; without any, every score is about 0. Columns of other names are not read.
    """
    return score(docs.select("doc_id", "text"), fit(docs, labels)).select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
