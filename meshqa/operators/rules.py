"""Rule classification: flags, tagging types, directions, protection, lengths and tag statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshqa.functions.predicates import any_of, matches


def lit_or_col(value, df: DataFrame) -> Column:
    """A setting that is either one value for all rows or the name of a column that holds it."""
    return F.col(value) if isinstance(value, str) and value in df.columns else F.lit(value)


def clean_names(df: DataFrame) -> DataFrame:
    """Column names in lower case with : as _. Names that would meet are an error."""
    names = [c.lower().replace(":", "_") for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"names meet: {sorted(n for n in set(names) if names.count(n) > 1)}")
    return df.toDF(*names)


def padded_index(df: DataFrame, column: str, width: int, name: str = "node_index") -> DataFrame:
    """An id as text of `width` digits; longer ids are an error, as lpad alone would cut them."""
    text = F.col(column).cast("string")
    return df.withColumn(name, F.when(F.length(text) > width, F.raise_error(F.concat(F.lit("id too long: "), text))).otherwise(F.lpad(text, width, "0")))


def flag(df: DataFrame, rules: dict[str, str], name: str = "bicycle_infrastructure") -> DataFrame:
    """`yes` if any rule matches, else `no`."""
    return df.withColumn(name, F.when(any_of(list(rules.values())), "yes").otherwise("no"))


def tagging_type(df: DataFrame, rules: dict[str, str], name: str = "tagging_type") -> DataFrame:
    """The keys of all matching rules in order, joined; empty if none matches."""
    return df.withColumn(name, F.concat_ws("", *[F.when(matches(r), F.lit(k)) for k, r in rules.items()]))


def direction_and_geometry(df: DataFrame, groups: dict[tuple[str, bool], list[str]]) -> DataFrame:
    """bicycle_geometries and bicycle_bidirectional from groups (geometry, both ways) -> rules; later groups prevail."""
    geometry, both = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for (g, b), rules in groups.items():
        hit = any_of(rules)
        geometry, both = F.when(hit, g).otherwise(geometry), F.when(hit, b).otherwise(both)
    return df.withColumns({"bicycle_geometries": geometry, "bicycle_bidirectional": both})


def protection(df: DataFrame, types: dict[str, list[str]], name: str = "protected") -> DataFrame:
    """The type whose rules match, `mixed` for several types, null for none."""
    hits = F.filter(F.array(*[F.when(any_of(r), F.lit(t)) for t, r in types.items()]), lambda t: t.isNotNull())
    return df.withColumn(name, F.when(F.size(hits) > 1, "mixed").otherwise(F.get(hits, F.lit(0))))


def infrastructure_length(df: DataFrame, length="length", geometry="bicycle_geometries", both="bicycle_bidirectional", present="bicycle_infrastructure", name: str = "infrastructure_length") -> DataFrame:
    """Twice the length of ways for both directions, once of others, null where there is no infrastructure. Geometry and
    direction are columns or one value for all."""
    known = (lit_or_col(present, df) == "yes") & lit_or_col(geometry, df).isin("true_geometries", "centerline")
    way = lit_or_col(both, df)
    return df.withColumn(name, F.when(known & way, 2 * F.col(length)).when(known & ~way, F.col(length)))


def existing_tags(df: DataFrame, attributes: dict[str, dict[str, list[str]]], geometry: str = "bicycle_geometries", length: str = "length") -> DataFrame:
    """attribute, count, length: per geometry type (or `all`), rows with any of its tags, and the length of rows with the
    first tag that is a column. One pass over the rows."""
    sums = []
    for name, kinds in attributes.items():
        count, total = F.lit(0).cast("long"), F.lit(0.0)
        for kind, tags in kinds.items():
            if there := [t for t in tags if t in df.columns]:
                of = F.lit(True) if kind == "all" else F.col(geometry).eqNullSafe(F.lit(kind))
                count = count + F.count(F.when(of & F.coalesce(*there).isNotNull(), 1))
                total = total + F.coalesce(F.sum(F.when(of & F.col(there[0]).isNotNull(), F.col(length))), F.lit(0.0))
        sums.append(F.struct(F.lit(name).alias("attribute"), count.alias("count"), total.alias("length")))
    return df.agg(F.array(*sums).alias("all")).select(F.inline("all"))


def incompatible_tags(df: DataFrame, pairs: list[tuple[str, str, str, str]], by: list[str] | None = None) -> DataFrame:
    """combination, count: rows in which column a has value x and column b value y, keyed by all four."""
    shown = [(f"{a}={x}/{b}={y}", (F.col(a) == x) & (F.col(b) == y)) for a, x, b, y in pairs if a in df.columns and b in df.columns]
    counts = [F.struct(F.lit(k).alias("combination"), F.count(F.when(hit, 1)).alias("count")) for k, hit in shown]
    return df.groupBy(*(by or [])).agg(F.array(*counts).alias("all")).select(*(by or []), F.inline("all"))


def incompatible_edges(df: DataFrame, pairs: list[tuple[str, str, str, str]], key: str = "id") -> DataFrame:
    """combination, key: the rows themselves."""
    hits = [F.when((F.col(a) == x) & (F.col(b) == y), f"{a}={x}/{b}={y}") for a, x, b, y in pairs]
    return df.select(key, F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("combination"))


def shares(df: DataFrame, column: str) -> DataFrame:
    """value, count, percent of all rows, two decimals."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))
    # one row
    total = df.agg(F.count("*").alias("_all"))
    return counts.join(F.broadcast(total)).withColumn("percent", F.round(100 * F.col("count") / F.col("_all"), 2)).drop("_all")


def multiedges(df: DataFrame) -> DataFrame:
    """u, v, parallel: how many edges run between two nodes besides the first, in this direction."""
    return df.groupBy("u", "v").agg((F.count("*") - 1).alias("parallel"))
