"""What the corpus operators share: words, reading tables, coins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshqa.sources.scratch import new_path, shared_folder, written  # noqa: F401

#: A word: a run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that no name of theirs can meet one of an operator's own."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def fraction(*parts: Column, at: int = 0) -> Column:
    """A number in [0, 1) from an MD5 of the parts; eight hex digits from place 1 + 8 * at. The same in any SQL engine."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]))
    return F.conv(F.substring(digest, 1 + 8 * at, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file, on the driver and on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)
