"""Exact nearest neighbours, searches by context, concepts and learning path, and fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from . import ranks
from .lineage import cut

#: Queries that may be broadcast, and rows of a block where there are more.
QUERY_BLOCK = 4096
#: Queries and rows that a task compares at once.
TILE = (256, 4096)


def within(rows: DataFrame, query: list[float], id_col: str, vector_col: str, least: float) -> DataFrame:
    """All rows at least so much like one vector."""
    score = vectors.cosine(F.col(vector_col), F.array(*(F.lit(float(x)) for x in query)))
    return rows.select(id_col, F.round(score, 6).alias("score")).where(F.col("score") >= least)


def nearest(rows: DataFrame, query: list[float], id_col: str, vector_col: str, k: int, least: float = -1.0, where: Column | None = None) -> DataFrame:
    """The k rows most like one vector, filtered before the cut: one scan and a top-k, no shuffle of vectors."""
    chosen = rows if where is None else rows.where(where)
    score = vectors.cosine(F.col(vector_col), F.array(*(F.lit(float(x)) for x in query)))
    return chosen.select(id_col, F.round(score, 6).alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), id_col).limit(k)


def _top(found: pd.DataFrame, k: int) -> pd.DataFrame:
    return found.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id").head(k)


def _compared(queries: tuple[np.ndarray, np.ndarray], rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k rows (id, v) most like each query, of queries (ids, unit vectors), a tile of both at a time."""
    names, matrix = queries
    best = []
    for r in range(0, len(rows), TILE[1]):
        ids, units = _units(rows.iloc[r : r + TILE[1]], "id")
        for q in range(0, len(names), TILE[0]):
            asked = names[q : q + TILE[0]]
            score = np.round(matrix[q : q + TILE[0]] @ units.T, 6)
            score[asked[:, None] == ids] = -2
            n = min(k, len(ids))
            a, b = np.nonzero(score >= np.partition(score, len(ids) - n, axis=1)[:, -n][:, None])
            found = pd.DataFrame({"query_id": asked[a], "id": ids[b], "score": score[a, b]})
            best.append(_top(found[found["score"] > -2], k))
    return _top(pd.concat(best), k)


def _units(rows: pd.DataFrame, name: str = "q") -> tuple[np.ndarray, np.ndarray]:
    matrix = np.stack(rows["v"].to_numpy()).astype(np.float64)
    size = np.linalg.norm(matrix, axis=1)
    return rows[name].to_numpy(), matrix / np.where(size == 0, 1, size)[:, None]


def batch_nearest(rows: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """query_id, id, score: the k rows most like each query, itself excluded.

    Up to QUERY_BLOCK queries are broadcast, and every task keeps its k best.  More of them meet the rows in a grid: both sides are
    dealt to blocks, each pair of blocks is compared by a task, and only the best are shuffled.
    """
    spark = rows.sparkSession
    asked = queries.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("q"), F.col(vector_col).alias("v"))
    rows = rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    held = asked.limit(QUERY_BLOCK + 1).toPandas()
    if not len(held):
        return spark.createDataFrame([], "query_id long, id long, score double")
    if len(held) <= QUERY_BLOCK:
        sent = spark.sparkContext.broadcast(_units(held))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            top = None
            for some in batches:
                if len(some):
                    got = _compared(sent.value, some, k)
                    top = got if top is None else _top(pd.concat([top, got]), k)
            if top is not None:
                yield top

        found = rows.mapInPandas(best, "query_id long, id long, score double")
    else:
        ahead, down = (-(-side.count() // QUERY_BLOCK) for side in (asked, rows))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        left = asked.withColumn("a", block("q", ahead)).withColumn("b", every(down))
        right = rows.withColumn("b", block("id", down)).withColumn("a", every(ahead))

        def meet(asked: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(some):
                return pd.DataFrame({"query_id": [], "id": [], "score": []})
            return _compared(_units(asked), some, k)

        found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(meet, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", rank).where(F.col("place") <= k).select("query_id", "id", "score")


#: Columns of a table of ratings that may become the dimensions of vectors.
MOST_DIMENSIONS = 4096


def most_alike(ratings: DataFrame, row: str, column: str, value: str, k: int) -> DataFrame:
    """row, other, similarity: the k rows with most similar values above 0, by the cosine over the columns that both have.

    Rows become vectors that are compared in a grid of blocks: pairs stay in the tasks, and only the best are shuffled.  Beyond MOST_DIMENSIONS
    columns, products meet on columns instead, which a row has few of.  Repeated pairs of row and column, and null values, are not for this.
    """
    held = cut(ratings.select(F.col(row).cast("long").alias("row"), F.col(column).alias("column"), F.col(value).cast("double").alias("value")).where("row IS NOT NULL AND column IS NOT NULL AND value IS NOT NULL"))
    columns = held.select("column").distinct()
    d = columns.count()
    if d <= MOST_DIMENSIONS:
        placed = held.join(ranks.numbered(columns, "column", "i"), "column")
        entries = F.map_from_entries(F.collect_list(F.struct(F.col("i").cast("int"), "value")))
        rows = placed.groupBy("row").agg(entries.alias("m")).select("row", F.transform(F.sequence(F.lit(1), F.lit(max(d, 1))), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("v"))
        rows = cut(rows)
        found = batch_nearest(rows, rows, "row", "v", k).select(F.col("query_id").alias("row"), F.col("id").alias("other"), F.col("score").alias("similarity"))
    else:
        norms = held.groupBy("row").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
        other = held.select(F.col("row").alias("other"), "column", F.col("value").alias("w"))
        dots = held.join(other, "column").where("row <> other").groupBy("row", "other").agg(F.sum(F.col("value") * F.col("w")).alias("dot"))
        both = dots.join(norms, "row").join(norms.select(F.col("row").alias("other"), F.col("norm").alias("n2")), "other")
        scored = both.select("row", "other", F.round(F.try_divide("dot", F.col("norm") * F.col("n2")), 6).alias("similarity"))
        place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("similarity"), "other"))
        found = scored.withColumn("place", place).where(F.col("place") <= k).drop("place")
    return found.where("similarity > 0").select(F.col("row").alias(row), "other", "similarity")


def fuse(lists: list[tuple[DataFrame, float]], id_col: str = "id", score_col: str = "score") -> DataFrame:
    """Weighted mean of the scores that an id has in the lists."""
    every = None
    for rows, weight in lists:
        part = rows.select(F.col(id_col).alias("id"), (F.col(score_col) * weight).alias("weighted"), F.lit(weight).alias("weight"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("id").agg(F.round(F.sum("weighted") / F.sum("weight"), 6).alias("score"), F.count("*").alias("lists"))


#: Searches take no chunk of less similarity, but those that concepts or a path lead to.
LEAST_SCORE = 0.5
#: Weights of the semantic, contextual, conceptual and path lists in a hybrid search.
WEIGHTS = (0.4, 0.2, 0.3, 0.1)


def _raised(found: DataFrame, chunks: DataFrame, query: list[float], boost: Column) -> DataFrame:
    """id and score of found chunks that have a vector: their similarity times `boost`, 1 at most."""
    score = vectors.cosine(F.col("vector"), F.array(*(F.lit(float(x)) for x in query)))
    held = found.join(chunks.select("id", "vector").where(F.col("vector").isNotNull()), "id")
    return held.select("id", F.round(F.least(F.lit(1.0), score * boost), 6).alias("score"))


def contextual(chunks: DataFrame, query: list[float], k: int, current: int | None, least: float = LEAST_SCORE) -> DataFrame:
    """The k nearest chunks, raised where they share the section or else the chapter of the current one."""
    base = nearest(chunks, query, "id", "vector", k, least)
    own = chunks.where(F.col("id") == F.lit(current)).select(F.col("section").alias("own_section"), F.col("chapter").alias("own_chapter")).limit(1)
    boost = F.when(F.col("section") == F.col("own_section"), 1.3).when(F.col("chapter") == F.col("own_chapter"), 1.15).otherwise(1.0)
    rows = base.join(chunks.select("id", "section", "chapter"), "id").join(F.broadcast(own), F.lit(True), "left")
    return rows.select("id", F.round(F.least(F.lit(1.0), F.col("score") * boost), 6).alias("score"))


def conceptual(chunks: DataFrame, mentions: DataFrame, query: list[float], k: int, least: float = LEAST_SCORE) -> DataFrame:
    """The k / 2 nearest chunks, and as many others that mention two or more concepts of the first five."""
    base = nearest(chunks, query, "id", "vector", k // 2, least)
    concepts = mentions.join(base.orderBy(F.desc("score"), "id").limit(5), "id").select("concept").distinct()
    others = mentions.join(concepts, "concept").join(base, "id", "left_anti").groupBy("id").agg(F.countDistinct("concept").alias("n"))
    found = others.where("n >= 2").orderBy(F.desc("n"), "id").limit(k // 2)
    return base.unionByName(_raised(found, chunks, query, 1 + 0.1 * F.col("n")))


def learning_path(chunks: DataFrame, steps: DataFrame, query: list[float], k: int, history: list[int], least: float = LEAST_SCORE) -> DataFrame:
    """The k / 2 nearest chunks, and as many others that lie one to three steps (src, dst) after the last ten of the history."""
    base = nearest(chunks, query, "id", "vector", k // 2, least)
    steps = steps.select("src", "dst").distinct()
    reached = steps.where(F.col("src").isin(history[-10:])).select(F.col("src").alias("learned"), F.col("dst").alias("id"))
    every = reached
    for _ in range(2):
        reached = reached.join(steps, F.col("id") == F.col("src")).select("learned", F.col("dst").alias("id")).distinct()
        every = every.unionByName(reached)
    others = every.where(~F.col("id").isin(history)).join(base, "id", "left_anti").groupBy("id").agg(F.countDistinct("learned").alias("n"))
    return base.unionByName(_raised(others.orderBy(F.desc("n"), "id").limit(k // 2), chunks, query, F.lit(1.2)))


def hybrid(chunks: DataFrame, mentions: DataFrame, steps: DataFrame, query: list[float], k: int, current: int | None = None, history: list[int] | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """id, score and number of lists: the semantic, contextual, conceptual and, with a history, path lists, fused.

    Chunks are (id, vector, section, chapter), mentions (id, concept), steps (src, dst).
    """
    lists = [nearest(chunks, query, "id", "vector", k, least), contextual(chunks, query, k, current, least), conceptual(chunks, mentions, query, k, least)]
    if history:
        lists.append(learning_path(chunks, steps, query, k, history, least))
    return fuse(list(zip(lists, WEIGHTS, strict=False)))
