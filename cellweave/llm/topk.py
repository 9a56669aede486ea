"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors become whole numbers, floor(scale * x). Every task sorts its candidates by each dimension. A query goes down
the lists side by side (from the largest value where its own component is positive, from the smallest where it is
negative), scores each candidate that it meets, and stops when even a candidate with the last seen value in every list
could not reach the kth best score, or when every candidate has been met in some list. The tasks' best are merged for each query.

Queries are met in blocks of about `block` of them, each sent to all tasks and written before the next, so no set of
queries is held whole.

Defined results: a vector that is null, empty, or holds a null or a non-finite component takes no part, nor does a row
whose id is null; rows of one id are rows of their own, and a query leaves out just one row that equals it; vectors of
different lengths are not compared; ties go to the smaller id; an empty table gives an empty table; other columns are
ignored, whatever their names. Scores are 64-bit: a vector that could score beyond them with its like is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_path

BLOCK, FIRST_STEP = 2_048, 16


class Lists:
    """Candidates of one task, sorted by every dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[by_id], vectors[by_id]
        self.up = np.argsort(self.x, axis=0, kind="stable").astype(np.int32)
        self.down = np.argsort(-self.x, axis=0, kind="stable").astype(np.int32)

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (in id order) and scores of the k best, ties to the smaller id."""
        n = len(self.ids)
        dims = np.flatnonzero(q)
        positive, weights = q[dims] > 0, q[dims]
        at, step, met = 0, FIRST_STEP, 0
        seen = np.zeros(n, bool)
        best, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        while at < n and len(dims):
            part = np.where(positive, self.down[at : at + step, dims], self.up[at : at + step, dims])
            new = np.zeros(n, bool)
            new[part.ravel()] = True
            new &= ~seen
            seen |= new
            rows = np.flatnonzero(new)
            best = np.concatenate((best, rows))
            scores = np.concatenate((scores, self.x[rows] @ q))
            keep = np.lexsort((best, -scores))[:k]
            best, scores = best[keep], scores[keep]
            bound = int((self.x[part[-1], dims] * weights).sum())
            met += len(rows)
            if met == n or (len(best) == k and scores[-1] > bound):
                return best, scores
            at, step = at + step, step * 2
        rest = np.flatnonzero(~seen)  # only of a query without a component that counts: all scores are 0
        best, scores = np.concatenate((best, rest)), np.concatenate((scores, np.zeros(len(rest), np.int64)))
        keep = np.lexsort((best, -scores))[:k]
        return best[keep], scores[keep]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """The rows that take part, as id and v."""
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return own.where(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def whole(v: list[float], scale: float) -> np.ndarray:
    """A vector in whole numbers. Any two that pass have an inner product of 64 bits."""
    x = np.floor(scale * np.asarray(v, float))
    if len(x) * float(np.abs(x).max()) ** 2 >= 2.0**63:
        raise ValueError(f"a vector with the component {v[int(np.abs(x).argmax())]} is too large for 64-bit scores")
    return x.astype(np.int64)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of every query's k best rows of vectors, its own row left out."""
    spark = vectors.sparkSession
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    blocks = max(1, -(-asked.count() // block))
    path = shared_path(spark, "topk")
    for b in range(blocks):
        own = [(r.id, whole(r.v, scale)) for r in asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").collect()]

        def run(batches: Iterator[pa.RecordBatch], own: list = own) -> Iterator[pa.RecordBatch]:
            for batch in batches:  # of bounded rows: their lists are sorted, searched and dropped
                found, ids = [whole(v, scale) for v in batch["v"].to_pylist()], np.asarray(batch["id"].to_pylist(), np.int64)
                by_length: dict[int, list[int]] = {}
                for j, v in enumerate(found):
                    by_length.setdefault(len(v), []).append(j)
                lists = {n: Lists(ids[js], np.array([found[j] for j in js])) for n, js in by_length.items()}
                out: list[tuple] = []
                for n, (query_id, q) in enumerate(own):
                    if (mine := lists.get(len(q))) is None:
                        continue
                    for j, s in zip(*mine.search(q, k + 1), strict=True):
                        out.append((n, query_id, int(mine.ids[j]), int(s), bool(mine.ids[j] == query_id and (mine.x[j] == q).all())))
                cols = list(zip(*out, strict=True)) or [()] * 5
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["q", "query_id", "vec_id", "score", "same"])

        hits = rows.mapInArrow(run, "q int, query_id long, vec_id long, score long, same boolean")
        hits = hits.withColumn("copy", F.row_number().over(Window.partitionBy("q", "same").orderBy(F.desc("score"), "vec_id"))).where(~F.col("same") | (F.col("copy") > 1))
        ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        ranked.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)
