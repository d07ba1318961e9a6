"""Nearest vectors by dot product: exact search in blocks, and an inverted file.

Both come down to lists of vectors that queries are held against. A list is dealt to
blocks of about ``BLOCK_ROWS`` vectors and ``BLOCK_QUERIES`` queries, whatever share
of the rows it holds; a block is one matrix product, of which each query's best k
go on. Null vectors are neither found nor asked; equal dots, rounded to six places,
are in the order of ids; a vector is not its own neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut

BLOCK_ROWS = 4_096
BLOCK_QUERIES = 1_024
#: Rows at most that an inverted file is fitted on, those with the smallest hashes of ids.
FIT_ROWS = 20_000
MOST_CELLS = 1_024
#: Sampled queries on which the number of probes is chosen, and the recall that it must reach there.
FIT_QUERIES = 400
FIT_RECALL = 0.95


def _best(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """Each query's best k of the vectors."""
    ids = vectors["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, table = ids[order], np.stack(vectors["v"].to_numpy()[order]).astype(np.float64)
    asked = queries["query_id"].to_numpy()
    dots = np.stack(queries["q"].to_numpy()).astype(np.float64) @ table.T
    rounded = np.floor(dots * 1e6 + 0.5)
    rounded[asked[:, None] == ids[None, :]] = -np.inf
    first = np.argsort(-rounded, axis=1, kind="stable")[:, :k]
    found = pd.DataFrame({"query_id": np.repeat(asked, first.shape[1]), "vec_id": ids[first].ravel(), "dot": np.take_along_axis(dots, first, 1).ravel()})
    return found[np.isfinite(np.take_along_axis(rounded, first, 1).ravel())]


def nearest_in_lists(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, dot``: the best k of each query in all lists (``cell``) that it asks.

    ``vectors`` has cell, vec_id and v, ``queries`` has cell, query_id and q.
    """
    sizes = vectors.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
    asked = queries.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("heaps"))
    shape = cut(sizes.join(asked, "cell"))  # a row for each list
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda i, n: F.pmod(F.xxhash64(i), F.col(n)).cast("int")
    table = vectors.join(shape, "cell").select("cell", own("vec_id", "parts").alias("part"), every("heaps").alias("heap"), "vec_id", "v")
    heaps = queries.join(shape, "cell").select("cell", every("parts").alias("part"), own("query_id", "heaps").alias("heap"), "query_id", "q")
    block = ["cell", "part", "heap"]

    def meet(asked: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(table):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "dot": pd.Series(dtype="float64")})
        return _best(asked, table, k)

    found = heaps.groupBy(*block).cogroup(table.groupBy(*block)).applyInPandas(meet, "query_id long, vec_id long, dot double")
    found = found.withColumn("dot", F.round("dot", 6))
    # Of a query's blocks some are looked at together first, so that very many do not meet in one task.
    order = [F.col("dot").desc(), F.col("vec_id")]
    heap = Window.partitionBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy(*order)
    first = found.withColumn("rn", F.row_number().over(heap)).where(F.col("rn") <= k)
    best = first.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rn") <= k)
    return best.select("query_id", "vec_id", "dot")


def _columns(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest of all vectors for each query, exactly: everything is one list."""
    table = _columns(vectors, id_col, vector_col).withColumn("cell", F.lit(0))
    asked = _columns(queries, id_col, vector_col).select(F.lit(0).alias("cell"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return nearest_in_lists(table, asked, k)


@dataclass(frozen=True)
class InvertedFile:
    """Centres of cells, and how many cells a query looks into."""

    centres: np.ndarray
    probes: int
    recall: float  # of the queries that were held out, among the sampled vectors

    def cells(self, v: np.ndarray) -> np.ndarray:
        return np.argmax(v @ self.centres.T - (self.centres**2).sum(axis=1) / 2, axis=1)

    def probed(self, q: np.ndarray, probes: int | None = None) -> np.ndarray:
        return np.argsort(-(q @ self.centres.T), axis=1, kind="stable")[:, : probes or self.probes]


def _centres(x: np.ndarray, n: int, rounds: int = 15) -> np.ndarray:
    """Lloyd's centres from evenly chosen rows; a centre that loses its rows stays."""
    centres = x[np.linspace(0, len(x) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        cell = InvertedFile(centres, 1, 0.0).cells(x)
        total = np.zeros_like(centres)
        np.add.at(total, cell, x)
        count = np.bincount(cell, minlength=n)[:, None]
        centres = np.where(count > 0, total / np.maximum(count, 1), centres)
    return centres


def fit(vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> InvertedFile:
    """An inverted file fitted on at most ``FIT_ROWS`` vectors.

    The sample are the vectors whose ids have the smallest hashes, the same however the
    table is split. Centres are fitted without the first ``FIT_QUERIES`` of them (a fifth
    at most), for which the number of probes is chosen: the least that finds
    ``FIT_RECALL`` of their best k among the others.
    """
    sample = _columns(vectors, id_col, vector_col).orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).toPandas()
    if not len(sample):
        return InvertedFile(np.zeros((1, 1)), 1, 1.0)
    x = np.stack(sample["v"]).astype(np.float64)
    held = min(FIT_QUERIES, len(x) // 5)
    asked, x = x[:held], x[held:]
    n = min(MOST_CELLS, max(1, 2 * int(len(x) ** 0.5)))
    made = InvertedFile(_centres(x, n), n, 1.0)
    if not held:
        return made
    best = np.argsort(-(asked @ x.T), axis=1)[:, :k]
    cell, order = made.cells(x), made.probed(asked)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n)[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, cell[best], axis=1).ravel()) + 1  # probes after which a neighbour is found
    probes = int(needed[int(np.ceil(FIT_RECALL * len(needed))) - 1])
    return InvertedFile(made.centres, probes, float((needed <= probes).mean()))


def assigned(vectors: DataFrame, index: InvertedFile, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``cell, vec_id, v`` of every vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)  # at most MOST_CELLS centres

    @F.pandas_udf("int")
    def cell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield pd.Series(shared.value.cells(np.stack(v).astype(np.float64)) if len(v) else [], dtype="int32")

    return _columns(vectors, id_col, vector_col).select(cell("v").alias("cell"), "vec_id", "v")


def search(index: InvertedFile, table: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, vec_id, dot``: the best k that each query finds in the cells it looks into, ranked exactly."""
    shared = queries.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("array<int>")
    def probes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for q in batches:
            yield pd.Series(list(shared.value.probed(np.stack(q).astype(np.float64)).astype(np.int32)) if len(q) else [], dtype=object)

    asked = _columns(queries, id_col, vector_col).select(F.explode(probes("v")).alias("cell"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return nearest_in_lists(table, asked, k)
