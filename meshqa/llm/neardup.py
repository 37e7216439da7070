"""Operator 10: SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments. The Manhattan distance of two such vectors
never exceeds the Hamming distance, so a range join of the vectors finds every link. The vector space is cut into
grids of neighbouring segments: vectors within distance LIMIT differ in at most LIMIT of them, so they share the cell of
all but LIMIT grids, and meet where fingerprints are dealt out by the cells of every such choice. The more fingerprints
there are, the more grids, so that cells stay small: the links are the same. There the Manhattan distance is checked
first, then the Hamming distance exactly. Only distinct fingerprints take part.

A cell with more than CELL fingerprints is cut into parts that are compared pair by pair, each in a task's own bounds;
and of the links within a crowded cell a spanning forest is given, which keeps every component whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshqa.llm.common import table, whole_row, written
from meshqa.operators.components import components, looked_up

SHINGLE, SEED, LIMIT = 4, 42, 4
#: Grids: so many at least, and at most.
BLOCKS, MOST_BLOCKS = 7, 12
CELL = 512
#: Runs up to this long give all their links, longer ones a spanning forest.
ALL_LINKS = 32
_ODD = 0x5555555555555555


def fingerprint(text: str) -> int:
    """Unsigned. bytes.lower and bytes.split know ASCII letters and the six ASCII white-space characters only."""
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = list(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))) if len(words) >= SHINGLE else [b" ".join(words)]
    of = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for i in range(0, len(shingles), 1 << 15):
        part = np.array([of(s, SEED) for s in shingles[i : i + (1 << 15)]], "<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, columns `more` and fp (the 64 bits as a long) for each row of docs. Null text has no words: fingerprint 0."""

    @F.pandas_udf("long")
    def marks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return docs.select("doc_id", *more, marks(F.coalesce(F.col("text"), F.lit(""))).alias("fp"))


def blocks_for(n: int) -> int:
    """The fewest grids by which n fingerprints fall into cells of a dozen or so: a segment tells about 1.5 bits."""
    return next((k for k in range(BLOCKS, MOST_BLOCKS) if 8 * 2 ** (1.5 * 32 * (k - LIMIT) / k) >= n), MOST_BLOCKS)


def _masks(blocks: int = BLOCKS) -> list[int]:
    """A bit mask for every choice of all grids but LIMIT."""
    edges = [round(k * 32 / blocks) * 2 for k in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(block[k] for k in chosen) for chosen in combinations(range(blocks), blocks - LIMIT)]


def embedded(fp: Column) -> Column:
    """Bit counts of two-bit segments in unary (0: 00, 1: 01, 2: 11), so that Manhattan distance is a Hamming distance."""
    odd = F.lit(_ODD)
    high = F.shiftright(fp, 1)
    return fp.bitwiseOR(high).bitwiseAND(odd).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(odd), 1))


def _embed(fp: np.ndarray) -> np.ndarray:
    odd, one = np.uint64(_ODD), np.uint64(1)
    high = fp >> one
    return ((fp | high) & odd) | ((fp & high & odd) << one)


def _linked(a: np.ndarray, b: np.ndarray, ea: np.ndarray, eb: np.ndarray) -> np.ndarray:
    near = np.flatnonzero(np.bitwise_count(ea ^ eb) <= LIMIT)
    return near[np.bitwise_count(a[near] ^ b[near]) <= LIMIT]


def _forest(fp: np.ndarray) -> list[np.ndarray]:
    """Links that join what any link of a run joins: each fingerprint looks once at those not reached yet."""
    em, left, out = _embed(fp), np.arange(len(fp)), []
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            k = reached.pop()
            hit = _linked(np.broadcast_to(fp[k], len(left)), fp[left], np.broadcast_to(em[k], len(left)), em[left])
            if len(hit):
                found = left[hit]
                out.append(np.stack([np.broadcast_to(fp[k], len(found)), fp[found]]))
                reached.extend(found.tolist())
                left = np.delete(left, hit)
    return out


def _links_of_runs(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Links among rows of equal keys; rows are sorted by key."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    length = np.diff(np.append(start, len(key)))
    out = []
    for s, n in zip(start[length > ALL_LINKS], length[length > ALL_LINKS]):
        out += _forest(np.unique(fp[s : s + n]))
    small = np.repeat((length > 1) & (length <= ALL_LINKS), length)
    key, fp = key[small], fp[small]
    em = _embed(fp)
    for step in range(1, ALL_LINKS):
        same = np.flatnonzero(key[step:] == key[:-step])
        if not len(same):
            break
        hit = same[_linked(fp[same], fp[same + step], em[same], em[same + step])]
        out.append(np.stack([fp[hit], fp[hit + step]]))
    return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.uint64)


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by key; the last key of a batch waits for the next. A key has about two cells' rows at most."""
    key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def done(n: int) -> pd.DataFrame:
        pairs = _links_of_runs(key[:n], fp[:n]) if n else np.zeros((2, 0), np.uint64)
        pairs = np.unique(np.sort(pairs.view(np.int64), axis=0), axis=1)
        return pd.DataFrame({"u": pairs[0], "v": pairs[1]})

    for batch in batches:
        key = np.concatenate([key, batch["key"].to_numpy()])
        fp = np.concatenate([fp, batch["fp"].to_numpy().view(np.uint64)])
        n = int(np.searchsorted(key, key[-1])) if len(key) else 0
        yield done(n)
        key, fp = key[n:], fp[n:]
    yield done(len(key))


def links(distinct: DataFrame) -> DataFrame:
    """u, v: pairs of distinct fingerprints (fp) within LIMIT bits, or in crowded cells a forest that joins the same."""
    masks = _masks(blocks_for(distinct.count()))
    cells = [F.xxhash64(F.lit(t), embedded(F.col("fp")).bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64)).cast("long"))) for t, m in enumerate(masks)]
    dealt = distinct.select("fp", F.explode(F.array(*cells)).alias("key"))
    crowded = dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CELL).select(F.col("key").alias("_key"), F.ceil(F.col("n") / CELL).cast("int").alias("_parts"))
    part = F.pmod(F.xxhash64(F.lit(1), "fp"), F.col("_parts")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda j: F.xxhash64("key", F.least(part, j), F.greatest(part, j)))
    keyed = dealt.join(crowded, F.col("key") == F.col("_key"), "left").select("fp", F.explode(F.when(F.col("_parts").isNull(), F.array("key")).otherwise(meets)).alias("key"))
    return keyed.repartition("key").sortWithinPartitions("key").mapInPandas(_links, "u long, v long").distinct()


def _rooted(marked: DataFrame, least: Column) -> DataFrame:
    """fp, n, `least` over its rows, and root, a fingerprint that names its component; null for one without links."""
    distinct = written(marked.groupBy("fp").agg(least.alias("least"), F.count("*").alias("n")), "simhash-distinct")
    found = components(links(distinct))
    return written(distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "n", "least", F.col("component").alias("root")), "simhash-rooted")


def groups(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text; others are not read): doc_id, fp, component_id, the smallest doc_id
    reachable by links of fingerprints that differ in LIMIT bits or fewer.

    Equal fingerprints are linked, whatever their texts; so are all texts without words (null ones too). Texts of any
    length are read whole, their shingles in parts. Null ids are not among the smallest; a component of null ids alone
    has a null id. Columns of other names are not read. An empty table gives an empty result.
    """
    marked = written(fingerprints(docs), "simhash")
    rooted = _rooted(marked, F.min("doc_id"))
    linked = rooted.where("root is not null")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("many")).withColumnRenamed("root", "_root")
    of_linked = looked_up(linked.select("fp", "n", "root"), "root", named, "_root", "many", rooted.count())
    of_fp = of_linked.select(F.col("fp").alias("_fp"), "n", "component_id").unionByName(rooted.where("root is null").select(F.col("fp").alias("_fp"), "n", F.col("least").alias("component_id")))
    return looked_up(marked, "fp", of_fp, "_fp", "n", marked.count()).select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """Of each component one row, columns as given: that with the smallest doc_id (null is above all others); of rows
    that share this id, the one with the least hash of its text; of rows that share the text too, the one with the least
    hash of all its values. Rows of equal or null ids whose texts are in different components all stay."""
    key = [F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text")]
    names = ["_none", "_id", "_text"]
    marked = written(fingerprints(docs.select("doc_id", "text"), *key), "simhash")
    rooted = _rooted(marked, F.min(F.struct(*names)))
    kept = written(rooted.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("least")).select("least.*"), "simhash-kept")
    # the rows that meet here are dealt and sorted by the columns that they are grouped by
    whole = docs.select(*key, whole_row(docs).alias("_row")).join(kept, names, "left_semi")
    return whole.groupBy(*names).agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
