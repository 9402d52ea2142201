"""Search in a space of concepts: a table idx (long, distinct), word, vec. All scores are cosines."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.kept import keep
from quillon.functions.vectors import dot, doubles, mean_vectors, norm, unit
from quillon.operators import linalg
from quillon.operators.blocks import Nearest, build, points, scan


def _width(df: DataFrame, vector: str) -> int | None:
    row = df.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    return row and row[0]


def search(space: DataFrame, queries: DataFrame, id_col: str, k: int, vector: str = "embedding") -> DataFrame:
    """(id, rank, idx, word, score): the k best concepts of every query row, many to many; ties go to the smaller idx.

    Queries and concepts are packed into blocks; a task holds one block of queries, what each has found (a list of k) and
    one block of concepts at a time. A zero or null vector has no rows, another width is an error. Repeated ids are
    queries of their own; empty tables give no rows."""
    if k < 1:
        raise ValueError("k must be at least 1")
    some = queries.where(F.col(vector).isNotNull() & (norm(doubles(vector)) > 0))
    known = space.where(F.col("vec").isNotNull())
    widths = {_width(some, vector), _width(known, "vec")} - {None}
    if len(widths) > 1:
        raise ValueError(f"vectors of {sorted(widths)} components")
    left, right = build(some, id_col, vector), build(known, "idx", "vec")
    kernel = Nearest(k, same=False)
    found = scan(left, right, kernel, kernel.schema()).select("p", F.posexplode("found").alias("pos", "f"))
    rows = points(left).join(found.withColumnRenamed("p", "__p"), F.col("p") == F.col("__p")).select("id", (F.col("pos") + 1).alias("rank"), F.col("f.q").alias("__q"), F.col("f.cosine").alias("score"))
    named = rows.join(space.select("idx", "word"), F.col("__q") == F.col("idx"))
    return named.select(F.col("id").alias(id_col), "rank", "idx", "word", "score")


def hashed_lemmas(df: DataFrame, key: str, tokens: str, n: int) -> DataFrame:
    """(key, word, weight): how often the rows' tokens (array of strings) fall on each of n words w0, w1, ... by the first 32
    bits of their MD5. Counted row by row where the rows are, so nothing is shuffled; repeated keys give rows of their own."""

    def run(batches):
        for b in batches:
            lists = b.column(1)
            coded = pc.fill_null(lists, pa.scalar([], lists.type)).flatten().dictionary_encode()
            of = np.fromiter((int(md5(t.encode()).hexdigest()[:8], 16) % n for t in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            cells, counts = np.unique(np.repeat(np.arange(b.num_rows), sizes) * n + of[coded.indices.to_numpy(zero_copy_only=False)], return_counts=True)
            words = pa.DictionaryArray.from_arrays(pa.array(cells % n), pa.array([f"w{i}" for i in range(n)])).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cells // n)), words, pa.array(counts.astype(np.int64))], names=[key, "word", "weight"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.filter(tokens, lambda t: t.isNotNull()).alias(tokens)).mapInArrow(run, f"`{key}` {kind}, word string, weight long")


def map_lemmas(weights: DataFrame, space: DataFrame, vectors: DataFrame, key: str, k: int = 10) -> DataFrame:
    """(key, rank, word, score): each key's words (key, word, weight) mapped to concepts, the k heaviest of which stay.

    Weights are divided by their sum over the key. A word of the space is its own concept; any other goes to the nearest
    concept of its vector (vectors: word, vec), each such word searched once; words without a vector, and with a zero
    one, are lost. Scores of 0 or less are left out; ties (to 9 places) go to the smaller idx. Null words and weights are ignored."""
    w = weights.where(F.col("word").isNotNull() & F.col("weight").isNotNull()).select(F.col(key).alias("key"), F.col("word").alias("lemma"), F.col("weight").cast("double").alias("weight"))
    w = keep(w, "lemma-weights")  # read twice, not what it comes from
    asked = keep(w.select("lemma").distinct(), "lemmas")
    words = space.groupBy(F.col("word").alias("name")).agg(F.min("idx").alias("concept"))
    known = asked.join(words, F.col("lemma") == F.col("name")).select("name", "concept")
    unknown = asked.join(words.select("name"), F.col("lemma") == F.col("name"), "left_anti")
    found = vectors.select(F.col("word").alias("__w"), "vec").join(unknown, F.col("lemma") == F.col("__w")).groupBy("lemma").agg(F.first("vec").alias("vec"))
    nearest = search(space, keep(found, "lemma-vectors"), "lemma", 1, "vec").select(F.col("lemma").alias("name"), F.col("idx").alias("concept"))
    concept_of = keep(known.unionByName(nearest), "lemma-concepts")  # a row for each word that occurs
    names = keep(concept_of.select(F.col("concept").alias("__i")).distinct().join(space.select("idx", "word"), F.col("__i") == F.col("idx")).select("__i", "word"), "lemma-names")
    # words that are lost count in the total; both groupings stand on the one shuffle by key
    mapped = w.join(concept_of, F.col("lemma") == F.col("name"), "left").select("key", "concept", "weight").repartition("key")
    sums = mapped.groupBy("key", "concept").agg(F.sum("weight").alias("weight")).groupBy("key")
    sums = sums.agg(F.sum("weight").alias("total"), F.collect_list(F.when(F.col("concept").isNotNull(), F.struct("concept", "weight"))).alias("all"))  # a key's concepts: its distinct words at most
    score = lambda c: c["weight"] / F.col("total")  # noqa: E731 - divided once: whole weights add up exactly
    best = F.array_sort(F.transform(F.filter("all", lambda c: score(c) > 0), lambda c: F.struct((-F.round(score(c), 9)).alias("s"), c["concept"].alias("concept"), score(c).alias("score"))))
    top = sums.where("total <> 0").select("key", F.posexplode(F.slice(best, 1, k)).alias("pos", "b"))
    named = top.join(names, F.col("b.concept") == F.col("__i"))
    return named.select(F.col("key").alias(key), (F.col("pos") + 1).alias("rank"), "word", F.col("b.score").alias("score"))


def relevant(space: DataFrame, df: DataFrame, k: int = 30, vector: str = "embedding") -> DataFrame:
    """(rank, idx, word, score): the k concepts nearest to the mean vector; none if that is zero. A top-k report."""
    mean = mean_vectors(df, [], vector).select(unit(F.col("centroid")).alias("m")).where(norm(F.col("m")) > 0)
    scored = space.where(F.col("vec").isNotNull()).join(F.broadcast(mean)).select("idx", "word", "vec", dot(unit(doubles("vec")), F.col("m")).alias("score"))  # one row
    top = scored.orderBy(F.desc("score"), "idx").limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "idx"))).select("rank", "idx", "word", "vec", "score")


def project(space: DataFrame, df: DataFrame, dimensions: int, k: int = 30, each: int = 10, vector: str = "embedding") -> DataFrame:
    """(dimension, positive, rank, word, projection): of the k relevant concepts the each // 2 with the largest and with the
    smallest projection on each of the first principal directions of the rows; ties go to the smaller idx."""
    _, _, cov = linalg.moments(df.where(F.col(vector).isNotNull()), vector)
    axes = linalg.eigen(cov)[1][:, :dimensions]
    words = relevant(space, df, k, vector)
    y = linalg.apply_affine(words, np.zeros(len(axes)), axes, "vec", out="y").select("idx", "word", F.posexplode("y").alias("dimension", "projection"))
    place = lambda o: F.row_number().over(W.partitionBy("dimension").orderBy(o, "idx"))  # noqa: E731 - k rows a dimension
    ranked = y.withColumns({"a": place(F.desc("projection")), "b": place(F.asc("projection"))})
    sides = [ranked.where(F.col(c) <= each // 2).select("dimension", F.lit(c == "a").alias("positive"), F.col(c).alias("rank"), "word", "projection") for c in "ab"]
    return sides[0].unionByName(sides[1])
