"""Row filters, work lists and defaults for cleaning a collection; nulls follow each function's docstring."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import genre_tokens, split_list


def without_classes(df: DataFrame, column: str, excluded: list[str], sep: str = ",") -> DataFrame:
    """Rows whose class list has none of the excluded classes; a null list has none."""
    listed = split_list(F.col(column), sep)
    return df.where(~F.coalesce(F.arrays_overlap(listed, F.array(*map(F.lit, excluded)).cast("array<string>")), F.lit(False)))


def without_value(df: DataFrame, column: str, value: str, sep: str = ",") -> DataFrame:
    """Rows whose list, trimmed, does not have the value; a null list stays."""
    return df.where(~F.coalesce(F.array_contains(split_list(F.col(column), sep), value), F.lit(False)))


def with_value(df: DataFrame, column: str, value: str, sep: str = ",") -> DataFrame:
    """Rows whose list has exactly this value, untrimmed; a null list goes."""
    return df.where(F.coalesce(F.array_contains(F.split(column, sep), value), F.lit(False)))


def blanks_for_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as strings, '' for null."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns})


def present(c: Column) -> Column:
    """Not null, not blank and not the literal 'nan'."""
    t = F.trim(c.cast("string"))
    return F.coalesce((t != "") & (F.lower(t) != "nan"), F.lit(False))


def work_list(df: DataFrame, id_col: str, filled: str, prefix: str = "", force: bool = False) -> DataFrame:
    """Rows still to be filled in: no value yet (all with `force`), and an id that begins with the prefix."""
    todo = F.lit(True) if force else ~present(F.col(filled))
    return df.where(todo & F.coalesce(F.startswith(F.col(id_col).cast("string"), F.lit(prefix)), F.lit(False)))


def existing_ids(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(id_col).where(F.col(id_col).isNotNull()).distinct()


def vectors_of_years(vectors: DataFrame, films: DataFrame, id_col: str, time_col: str, first: int, last: int) -> DataFrame:
    """The vectors of films of an inclusive range of years."""
    return vectors.join(films.where(F.col(time_col).between(first, last)).select(id_col).distinct(), id_col, "left_semi")


def names_of(ids: list, names: DataFrame, id_col: str, name_col: str, sep: str = "__") -> DataFrame:
    """One row `name`: the names of the ids in their order, the id where there is none. The ids are a short list."""
    asked = names.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], f"pos int, asked {names.schema[id_col].dataType.simpleString()}")
    found = names.where(F.col(id_col).isin(ids)).groupBy(F.col(id_col).alias("asked")).agg(F.min(name_col).alias("found"))
    parts = asked.join(F.broadcast(found), "asked", "left").select("pos", F.coalesce("found", F.col("asked").cast("string")).alias("x"))
    return parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]), sep).alias("name"))


def label_map(df: DataFrame, raw: str, cluster: str, order: str, labels: Mapping[str, str]) -> DataFrame:
    """(raw, label): raw values cleaned like list entries; the last row of a value wins; clusters without a label are
    called cluster_<number>."""
    name = F.coalesce(*[F.when(F.col(cluster).cast("string") == k, v) for k, v in labels.items()], F.concat(F.lit("cluster_"), F.col(cluster).cast("string")))
    cleaned = F.get(genre_tokens(F.col(raw)), F.lit(0))
    return df.select(cleaned.alias(raw), name.alias("label"), order).where(F.col(raw).isNotNull()).groupBy(raw).agg(F.max_by("label", order).alias("label"))


def post_processed(df: DataFrame, rules: Mapping[str, object]) -> DataFrame:
    """Each column through its rule (a function of a string column, or None), '' for null first."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.withColumns({c: f(blank(c)) if f else blank(c) for c, f in rules.items()})


def ranked_below(df: DataFrame, rank: str, deprecated: str = "deprecated") -> DataFrame:
    """Statements whose rank is not the deprecated one; no rank counts as a usual one."""
    return df.where(F.coalesce(F.lower(rank) != deprecated, F.lit(True)))


def only_place(df: DataFrame, keys: list[str], place: str, wanted) -> DataFrame:
    """Rows of the keys that have no row with another place than the wanted one; a null place is no place."""
    other = df.where(F.col(place).isNotNull() & (F.col(place) != F.lit(wanted))).select(*keys).distinct()
    return df.join(other, keys, "left_anti")


def head_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group in an explicit order."""
    from pyspark.sql import Window as W

    return df.withColumn("__at", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__at") <= n).drop("__at")


def discovered(df: DataFrame, columns: list[str], score: str, n: int) -> DataFrame:
    """Distinct rows by descending score, n at most, ties by the columns."""
    return df.select(*columns, score).distinct().orderBy(F.desc(score), *columns).limit(n)


def class_list(spark, path: str) -> DataFrame:
    """(value) of a JSON file that holds a list of texts."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("x"))
    return whole.select(F.explode("x").alias("value")).where("value IS NOT NULL").distinct()


def clean_collection(df: DataFrame, id_col: str, text: str, classes: str, genres: str, wrong: DataFrame, lookup: DataFrame, removed: list[str], entropy: float, longest: int, blanks: list[str], sep: str = ",") -> DataFrame:
    """The cleaning job in order: rows without a text go; rows with a class among `wrong` (value) go; genres that occur once
    in the whole table are taken out; texts over `longest` characters go; plot_length, n_tokens, n_distinct and entropy are
    added and entropies below the bound go; genres become clusters by `lookup` (raw, cluster, label; unmapped ones are
    dropped, nothing mapped is null) as cluster_ids and cluster_names, joined by commas in order; rows with a removed
    cluster go; nulls in `blanks` become empty texts. Ids are distinct."""
    from quillon.operators.relational import drop_single_values, token_features

    rows = df.where(present(F.col(text)))
    values = F.transform(F.split(F.coalesce(classes, F.lit("")), sep), lambda x: F.trim(x))
    bad = rows.select(F.col(id_col).alias("__id"), F.explode(values).alias("v")).join(wrong.select("value").distinct(), F.col("v") == F.col("value"), "left_semi").select("__id").distinct()
    rows = rows.join(bad, F.col(id_col) == F.col("__id"), "left_anti")
    often = drop_single_values(rows, id_col, genres, sep).select(F.col(id_col).alias("__id"), F.col(genres).alias("__genres"))
    rows = rows.join(often, F.col(id_col) == F.col("__id"), "left").drop("__id", genres).withColumnRenamed("__genres", genres)
    rows = rows.withColumn("plot_length", F.length(text).cast("long")).where(F.col("plot_length") <= longest)
    facts = token_features(rows, id_col, text).withColumnRenamed(id_col, "__id").where(F.round("entropy", 6) >= entropy)
    rows = rows.join(facts, F.col(id_col) == F.col("__id")).drop("__id")
    each = rows.select(F.col(id_col).alias("__id"), F.explode(F.split(F.coalesce(genres, F.lit("")), sep)).alias("raw")).withColumn("raw", F.trim("raw"))
    found = each.join(lookup, "raw").groupBy("__id").agg(F.array_sort(F.collect_set(F.struct("cluster", "label"))).alias("x"))
    found = found.select("__id", F.array_join("x.cluster", sep).alias("cluster_ids"), F.array_join("x.label", sep).alias("cluster_names"), F.arrays_overlap("x.cluster", F.array(*map(F.lit, removed))).alias("__gone"))
    rows = rows.join(found, F.col(id_col) == F.col("__id"), "left").where("__gone IS NULL OR NOT __gone").drop("__id", "__gone")
    return blanks_for_nulls(rows, blanks)
