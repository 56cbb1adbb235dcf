"""Small shared steps of every ranking."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.storage import stage

SCORE_DIGITS = 9


def score_key(c: Column) -> Column:
    """Scores are compared after rounding, so the order of a distributed sum cannot break ties."""
    return F.round(c, SCORE_DIGITS)


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def placed(df: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """Like ``numbered``, for groups of any size: rows are sorted in range pieces, and a piece's numbers begin after those before it.

    A piece is sorted by the task that writes it, and its rows are numbered as they stand, so they are shuffled once.
    """
    by = [*[F.col(k) for k in keys], *order]
    cut = stage(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_piece": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}), "pieces")
    sizes = cut.groupBy(*keys, "_piece").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return cut.join(offsets, [*keys, "_piece"]).withColumn(name, F.col("_before") + F.col("_i") - F.col("_first") + 1).drop("_piece", "_i", "_first", "_before")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, limit: Column | None = None,
          name: str = "rank") -> DataFrame:
    """First k rows per group; the constant bound prunes before the shuffle, ``limit`` may tighten it per row."""
    out = numbered(df, keys, order, name).filter(F.col(name) <= F.lit(k))
    return out if limit is None else out.filter(F.col(name) <= limit)


def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by the order; partial aggregation keeps a hot key small."""
    rest = [c for c in df.columns if c not in keys]
    sort = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), sort).alias("_row"))
    return picked.select(*keys, "_row.*")


def positive_limit(value: Column, default: int) -> Column:
    """Text or number to a limit of at least 1; the default when it cannot be read."""
    return F.greatest(F.lit(1), F.coalesce(value.try_cast("int"), F.lit(default)))
