"""An inverted-file index of vectors by cosine: lists around centroids, residuals as product codes, exact scores for what the codes choose.

Fitting reads a bounded sample: k-means gives the centroids of lists and, for each stretch of dimensions, 256 codewords of
residuals; the same sample tells how many lists a query must probe to meet most of its neighbours.  Every row goes into the index: files
for each list and piece of a list (a list with most rows has many) hold ids, codes and vectors.  A search sends each query to
the pieces of its nearest lists, whose tasks read their own files, and only scores are shuffled.

Null vectors and vectors of another dimension are not indexed; a vector without length has the score 0 with every other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors that fitting looks at, codewords of a stretch, rows of a piece, queries that a task answers at once.
SAMPLE, WORDS, PIECE_ROWS, QUERIES_AT_ONCE = 20_000, 256, 20_000, 2000
#: Lists at most: their centroids go to every task.
MOST_LISTS = 65_536
#: Share of the sample's nearest neighbours that the probed lists hold.
TARGET = 0.97


@dataclass
class Index:
    """Where the files are, centroids (lists, dimensions), codewords (stretches, words, dimensions of one), lists to probe, and sizes of lists."""

    folder: str
    centroids: np.ndarray
    words: np.ndarray
    probes: int
    sizes: dict[int, int]


def _unit(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1)
    return (matrix / np.where(length == 0, 1, length)[:, None]).astype(np.float32)


def _matrix(column: pd.Series, dimensions: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, dimensions))


def k_means(points: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """k centroids; those that lose all their points move to points far from theirs."""
    rng = np.random.default_rng(seed)
    centroids = points[rng.choice(len(points), k, replace=len(points) < k)].astype(np.float64)
    for _ in range(rounds):
        distance = (centroids**2).sum(axis=1) - 2 * points @ centroids.T
        own = distance.argmin(axis=1)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        centroids = sums / np.maximum(counts, 1)[:, None]
        far = np.argsort(-distance[np.arange(len(points)), own], kind="stable")
        empty = np.flatnonzero(counts == 0)
        centroids[empty] = points[far[: len(empty)]] if len(far) >= len(empty) else centroids[empty]
    return centroids.astype(np.float32)


def _probes(points: np.ndarray, centroids: np.ndarray, k: int, target: float) -> int:
    """How many lists, nearest first, hold the target share of the k nearest neighbours of some sampled points."""
    some = points[: min(len(points), 400)]
    score = some @ points.T
    score[np.arange(len(some)), np.arange(len(some))] = -2
    k = min(k, len(points) - 1)
    if k < 1:
        return len(centroids)
    nearest = np.argpartition(-score, k - 1, axis=1)[:, :k]
    rank = np.empty((len(some), len(centroids)), np.int64)
    np.put_along_axis(rank, np.argsort(-(some @ centroids.T), axis=1, kind="stable"), np.arange(len(centroids))[None, :], axis=1)
    lists = _lists_of(points, centroids)
    return int(np.quantile(np.take_along_axis(rank, lists[nearest], axis=1), target, method="higher")) + 1


def _lists_of(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1) - 2 * points @ centroids.T).argmin(axis=1)


def _codes(points: np.ndarray, lists: np.ndarray, centroids: np.ndarray, words: np.ndarray) -> np.ndarray:
    rest = (points - centroids[lists]).reshape(len(points), words.shape[0], words.shape[2])
    out = np.empty((len(points), len(words)), np.uint8)
    for j, book in enumerate(words):
        out[:, j] = ((book**2).sum(axis=1) - 2 * rest[:, j] @ book.T).argmin(axis=1)
    return out


def build(rows: DataFrame, id_col: str, vector_col: str, folder: str, k: int = 10, lists: int | None = None, stretch: int = 4, sample: int = SAMPLE, target: float = TARGET) -> Index:
    """Fits and writes an index of all rows in a folder that the driver and all executors share.

    About `sample` vectors come to the driver, twice as many at most.  Lists are as many as the root of the number of rows unless given.
    """
    spark = rows.sparkSession
    held = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    facts = held.agg(F.count("*").alias("n"), F.mode(F.size("v")).alias("d")).first()
    n, d = facts["n"], facts["d"] or 1
    held = held.where(F.size("v") == d)
    share = int(min(1.0, sample / max(n, 1)) * 1_000_000)
    chosen = held.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < max(share, 1)).limit(2 * sample).toPandas().sort_values("id")
    points = _unit(_matrix(chosen["v"], d))
    points = points if len(points) else np.zeros((1, d), np.float32)
    lists = min(lists or max(1, round(math.sqrt(n))), MOST_LISTS, len(points))
    stretch = next(s for s in range(min(stretch, d), 0, -1) if d % s == 0)
    centroids = k_means(points, lists)
    rest = (points - centroids[_lists_of(points, centroids)]).reshape(len(points), d // stretch, stretch)
    words = np.stack([k_means(rest[:, j], min(WORDS, len(points)), seed=2 + j) for j in range(d // stretch)])
    sent = spark.sparkContext.broadcast((centroids, words))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, words = sent.value
        for rows in batches:
            points = _unit(_matrix(rows["v"], centroids.shape[1]))
            own = _lists_of(points, centroids) if len(rows) else np.zeros(0, np.int64)
            yield pd.DataFrame({"id": rows["id"], "v": rows["v"], "list": own, "code": [c.tobytes() for c in _codes(points, own, centroids, words)]})

    coded = held.mapInPandas(assign, "id long, v array<float>, list int, code binary")
    # Pieces by the size that lists have on average; a larger list gets more of them when its size is known.
    spread = folder.rstrip("/") + "/coded"
    coded.write.parquet(spread)
    coded = spark.read.parquet(spread)
    sizes = {r["list"]: r["n"] for r in coded.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row for each list
    large = {k: -(-n // PIECE_ROWS) for k, n in sizes.items() if n > PIECE_ROWS}
    pieces = F.coalesce(F.element_at(_map(large), F.col("list")), F.lit(1)) if large else F.lit(1)
    coded.withColumn("piece", F.pmod(F.xxhash64("id"), pieces).cast("int")).repartition("list", "piece").write.partitionBy("list", "piece").parquet(folder.rstrip("/") + "/lists")
    return Index(folder.rstrip("/") + "/lists", centroids, words, _probes(points, centroids, k, target), sizes)


def _map(values: dict[int, int]) -> Column:
    return F.map_from_entries(F.array(*(F.struct(F.lit(k), F.lit(v)) for k, v in sorted(values.items()))))


def _piece(folder: str, number: int, piece: int, columns: list[str]) -> pd.DataFrame:
    system, path = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
    return pq.read_table(f"{path}/list={number}/piece={piece}", columns=columns, filesystem=system, partitioning=None).to_pandas()


def search(index: Index, queries: DataFrame, id_col: str, vector_col: str, k: int, probes: int | None = None, rerank: int | None = None) -> DataFrame:
    """query_id, id, score: the k rows most like each query among the lists probed, itself excluded; scores are exact.

    Codes choose `rerank` rows of a piece (twenty times k unless given), whose vectors are then compared.
    """
    spark, d = queries.sparkSession, index.centroids.shape[1]
    sent = spark.sparkContext.broadcast(index)
    probes, rerank = min(probes or index.probes, len(index.centroids)), rerank or 20 * k

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = sent.value
        for rows in batches:
            if not len(rows):
                continue
            near = np.argsort(-(_unit(_matrix(rows["v"], d)) @ index.centroids.T), axis=1, kind="stable")[:, :probes]
            found = pd.DataFrame({"q": np.repeat(rows["q"].to_numpy(), near.shape[1]), "v": np.repeat(rows["v"].to_numpy(), near.shape[1]), "list": near.ravel().astype(np.int32)})
            found["pieces"] = [-(-index.sizes.get(x, 0) // PIECE_ROWS) for x in found["list"]]
            yield found[found["pieces"] > 0]

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        index, out = sent.value, []
        number, piece = int(rows["list"].iloc[0]), int(rows["piece"].iloc[0])
        held = _piece(index.folder, number, piece, ["id", "code"])
        codes = np.frombuffer(b"".join(held["code"]), np.uint8).reshape(len(held), -1)
        ids, vectors = held["id"].to_numpy(), None
        for begin in range(0, len(rows), QUERIES_AT_ONCE):
            some = rows.iloc[begin : begin + QUERIES_AT_ONCE]
            asked = _matrix(some["v"], d)
            unit = _unit(asked)
            chosen = np.ones((len(some), len(ids)), bool)
            if rerank < len(ids):
                guess = np.zeros((len(some), len(ids)), np.float32)
                for j, book in enumerate(index.words):
                    guess += (unit[:, j * book.shape[1] : (j + 1) * book.shape[1]] @ book.T)[:, codes[:, j]]
                chosen[:] = False
                np.put_along_axis(chosen, np.argpartition(-guess, rerank, axis=1)[:, :rerank], True, axis=1)
            if vectors is None:
                vectors = _matrix(_piece(index.folder, number, piece, ["v"])["v"], d)
                size = np.linalg.norm(vectors, axis=1)
            q, r = np.nonzero(chosen)
            lengths = np.linalg.norm(asked, axis=1)[q] * size[r]
            score = np.round(np.einsum("ij,ij->i", asked[q], vectors[r]) / np.where(lengths == 0, 1, lengths), 6)
            out.append(pd.DataFrame({"query_id": some["q"].to_numpy()[q], "id": ids[r], "score": score}))
        found = pd.concat(out)
        found = found[found["query_id"] != found["id"]].sort_values(["query_id", "score", "id"], ascending=[True, False, True])
        return found.groupby("query_id").head(k)

    asked = queries.where(F.col(id_col).isNotNull() & (F.size(vector_col) == d)).select(F.col(id_col).cast("long").alias("q"), F.col(vector_col).cast("array<float>").alias("v"))
    routed = asked.mapInPandas(route, "q long, v array<float>, list int, pieces int").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    # A list that most queries come to is answered by several tasks.
    routed = routed.withColumn("turn", F.pmod(F.xxhash64("q"), F.lit(16)))
    found = routed.groupBy("list", "piece", "turn").applyInPandas(answer, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", rank).where(F.col("place") <= k).select("query_id", "id", "score")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """queries, neighbours and recall: the share of the exact neighbours (query_id, id, score) that were found, or others as near."""
    last = exact.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    hits = found.join(last, "query_id").where(F.col("score") >= F.col("least")).groupBy("query_id").agg(F.count("*").alias("hits"))
    rows = last.join(hits, "query_id", "left").select("n", F.least("n", F.coalesce("hits", F.lit(0))).alias("hits"))
    return rows.agg(F.count("*").alias("queries"), F.sum("n").alias("neighbours"), (F.sum("hits") / F.sum("n")).alias("recall"))


def status(spark: SparkSession, index: Index) -> DataFrame:
    """list, rows and pieces of an index, as its files have them."""
    rows = spark.read.parquet(index.folder)
    return rows.groupBy("list").agg(F.count("*").alias("rows"), F.count_distinct("piece").alias("pieces"))
