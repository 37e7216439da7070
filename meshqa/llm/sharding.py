"""Operator 6: sharding by a k-d tree. A node is split at the distributed weighted median of its widest metadata
dimension, again and again, until there are as many leaves as shards and so each has reached its target bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshqa.llm.common import table, written

SHARDS = 24
ROW_BYTES = 8
#: A median is searched by histograms of so many bins over a node's range, finer round by round.
BINS = 1024
ROUNDS = 8
#: A split is near enough if it misses its aim by this part of a shard's bytes.
TOLERANCE = 0.002
#: Rows of a shard are numbered in so many runs, so that no task must sort a whole shard.
RUNS = 256
HASH_BITS = 28


def points(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, and the metadata dimensions: bytes, the share of characters beyond ASCII's in them and the
    mean length of a word, in thousandths. They depend on the text alone, so equal texts share a point and stay together.
    Each holds a 32-bit value above hash bits of the text, which part texts of equal value."""
    text = F.coalesce(F.col("text"), F.lit(""))
    octets = F.octet_length(text).cast("long")
    digest = F.xxhash64(text)
    tie = F.shiftrightunsigned(digest, 64 - HASH_BITS)
    value = lambda v: F.shiftleft(v.cast("long"), HASH_BITS) + tie
    return docs.select(
        "doc_id",
        (octets + ROW_BYTES).alias("size"),
        F.crc32(F.encode(text, "utf-8")).cast("long").alias("text_crc32"),
        digest.alias("digest"),
        value(F.least(octets, F.lit(2**31 - 1))).alias("d0"),
        value(F.floor(F.coalesce(F.try_divide(1_000_000 * (octets - F.char_length(text)), octets), F.lit(0)))).alias("d1"),
        value(F.floor(F.try_divide(1000 * octets, 1 + octets - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))))).alias("d2"),
    )


DIMENSIONS = ("d0", "d1", "d2")


def _pick(node: Column, values: dict[int, int]) -> Column:
    """values[node]; at most a value for each shard."""
    row = [str(values.get(k, 0)) for k in range(max(values) + 1)]
    return F.get(F.split(F.lit(",".join(row)), ",").cast("array<long>"), node)


def tree(at: DataFrame, shards: int = SHARDS) -> DataFrame:
    """at with `node`, the leaf of each row, 0 to shards - 1. A level of splits has for each node its dimension, the
    largest key of its left child, left node and right node; nodes are numbered by the first shard below them, and the
    rows are written anew with their nodes after each level (a few dozen bytes a row). Only node and bin sums come to the driver: at most shards * BINS rows a round."""
    nodes, placed = {0: shards}, at.withColumn("node", F.lit(0))
    whole = at.agg(F.sum("size").alias("size"), *[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if whole["size"] is None:
        return placed
    extent = {d: max(1, (whole[f"hi_{d}"] >> HASH_BITS) - (whole[f"lo_{d}"] >> HASH_BITS)) for d in DIMENSIONS}
    aim = whole["size"] / shards
    while any(n > 1 for n in nodes.values()):
        open_nodes = [k for k, n in nodes.items() if n > 1]
        stats = {r.node: r for r in placed.where(F.col("node").isin(open_nodes)).groupBy("node").agg(F.sum("size").alias("size"), *[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
        widest, want, span, below = {}, {}, {}, {}
        for k in open_nodes:
            left = nodes[k] // 2
            if k in stats:
                r = stats[k]
                widest[k] = max(DIMENSIONS, key=lambda d: ((r[f"hi_{d}"] >> HASH_BITS) - (r[f"lo_{d}"] >> HASH_BITS)) / extent[d])
                want[k] = r["size"] * left / nodes[k]
                span[k], below[k] = (r[f"lo_{widest[k]}"], r[f"hi_{widest[k]}"]), 0
            else:
                widest[k], span[k] = DIMENSIONS[0], (0, 0)
        cut = {k: span[k][1] for k in open_nodes}
        searching = [k for k in open_nodes if k in stats]
        for _ in range(ROUNDS):
            if not searching:
                break
            width = {k: max(1, -(-(span[k][1] - span[k][0] + 1) // BINS)) for k in searching}
            node = F.col("node")
            key = F.coalesce(*[F.when(node.isin([k for k in searching if widest[k] == d]), F.col(d)) for d in DIMENSIONS])
            inside = placed.where(node.isin(searching)).select("node", "size", key.alias("key"), _pick(node, {k: span[k][0] for k in searching}).alias("lo"), _pick(node, {k: span[k][1] for k in searching}).alias("hi"), _pick(node, width).alias("width"))
            bins = inside.where("key between lo and hi").groupBy("node", F.expr("(key - lo) div width").alias("bin")).agg(F.sum("size").alias("size"), F.max("key").alias("most"), F.min("key").alias("least")).orderBy("node", "bin").collect()
            again = []
            for k in searching:
                so_far, crossing = below[k], None
                for b in (b for b in bins if b.node == k):
                    if so_far + b["size"] >= want[k]:
                        crossing = b
                        break
                    so_far += b["size"]
                    cut[k] = b.most
                if crossing is None:
                    continue
                over, under = so_far + crossing["size"] - want[k], want[k] - so_far
                if crossing.most == crossing.least or min(over, under) <= TOLERANCE * aim:
                    if over <= under:
                        cut[k] = crossing.most
                    elif so_far == below[k] and cut[k] == span[k][1]:
                        cut[k] = span[k][0] - 1
                else:
                    if so_far == below[k]:
                        cut[k] = crossing.least - 1
                    below[k], span[k] = so_far, (crossing.least, crossing.most)
                    again.append(k)
            searching = again
        level = {k: (widest[k], cut[k], k, k + nodes[k] // 2) for k in open_nodes}
        placed = written(_step(placed, level), "shard-level")
        nodes = {c: n for k, m in nodes.items() for c, n in (((k, m // 2), (k + m // 2, m - m // 2)) if m > 1 else ((k, 1),))}
    return placed


def _step(placed: DataFrame, level: dict[int, tuple[str, int, int, int]]) -> DataFrame:
    """placed with every row moved from its node to a child. A level is four arrays by node, of a value a shard at most."""
    split = [level.get(k, (DIMENSIONS[0], 0, k, k)) for k in range(max(level) + 1)]
    whole = lambda values, kind: F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")
    node = F.col("node")
    key = F.get(F.array(*DIMENSIONS), F.get(whole([DIMENSIONS.index(d) for d, *_ in split], "int"), node))
    left = key <= F.get(whole([cut for _, cut, *_ in split], "long"), node)
    here = [F.get(whole([x[n] for x in split], "int"), node) for n in (2, 3)]
    return placed.withColumn("node", F.when(node >= len(split), node).when(left, here[0]).otherwise(here[1]))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for each row of docs (doc_id, text).

    Sizes of shards are near equal (law `bytes`), as far as groups of equal texts, which stay together, allow: a group
    larger than a shard makes that shard larger. Null text counts as empty; texts of any length are measured whole; null
    and repeated ids are rows like others, and slots of rows alike in id and text are theirs in any order. Columns of
    other names are not read. An empty table gives an empty result, fewer texts than shards leave shards empty.
    """
    at = written(points(docs), "shard-points")
    run = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(RUNS)).cast("int")
    # rows are numbered in runs of a shard
    placed = written(tree(at, shards).select("doc_id", "size", "text_crc32", "digest", F.col("node").alias("shard"), run.alias("run")), "shard-places")
    starts = placed.groupBy("shard", "run").agg(F.count("*").alias("n")).select("shard", "run", (F.sum("n").over(Window.partitionBy("shard").orderBy("run")) - F.col("n")).alias("start"))
    # shards * RUNS rows at most
    numbered = placed.withColumn("_i", F.row_number().over(Window.partitionBy("shard", "run").orderBy("doc_id", "digest")) - 1)
    return numbered.join(F.broadcast(starts), ["shard", "run"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), (F.col("start") + F.col("_i")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
