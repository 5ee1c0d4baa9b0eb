"""Nearest neighbours by largest inner product, with randomly rotated one-bit codes.

A unit vector is rotated at random and each coordinate's sign kept: D packed bits, with the
inner product of the code and the vector as a correction scalar.  The code's inner product with a
rotated query, divided by that scalar, estimates the vector's; the error is bounded, but for a
small chance set by SURE, by sqrt((1 - s^2) / s^2) * SURE / sqrt(D - 1).  Vectors whose upper bound
reaches a query's threshold are reranked by exact products in double precision.

Vectors stand in coarse lists (centres fitted on at most SAMPLE rows).  A query first meets its
own list, which gives its threshold; then every list in which a product may reach it: the product
with the centre plus the query's length times the list's radius.  No list is left out by a count of
probes, so the bound on the codes' error is all that may lose a neighbour.  Lists and queries are
dealt in blocks, so that no task holds a whole list or all queries.

Edge cases: see ``usable_vectors``; only vectors of the query's dimension are candidates; equal
scores go to the smaller vec_id; a query with fewer candidates than ``top`` gets them all; without
usable rows there are none; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm import vectors
from spindrift.sources.stage import Stages

SAMPLE, SEED = 8192, 5
#: Standard deviations that an estimate may be off.
SURE = 4.0
#: Vectors and queries of a block, about.
BLOCK, QUERIES = 4096, 1024


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same for every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed bits, correction scalars, lengths) of the rows of x."""
    length = np.linalg.norm(x, axis=1)
    turned = (x / length[:, None]) @ rotation(x.shape[1])
    bits = turned > 0
    return np.packbits(bits, axis=1), np.abs(turned).sum(1) / np.sqrt(x.shape[1]), length


def estimate(queries: np.ndarray, codes: np.ndarray, scale: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimates, errors) of inner products, a row for each query."""
    dim = queries.shape[1]
    turned = (queries @ rotation(dim)).astype(np.float32)
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    value = (turned @ signs.T) / np.sqrt(dim) * (length / scale).astype(np.float32)
    spread = np.sqrt(np.maximum(1 - scale**2, 0)) / scale * length * SURE / np.sqrt(max(dim - 1, 1))
    return value, np.linalg.norm(queries, axis=1)[:, None] * spread[None, :].astype(np.float32)


def block_top(top: int):
    """A block of queries against a block of vectors: each query's ``top`` best that may beat its threshold."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = []
        if len(left) and len(right):
            dim = int(left["dim"].iloc[0])
            q, x = vectors.matrix(left["vec"].tolist(), dim), vectors.matrix(right["vec"].tolist(), dim)
            codes = np.frombuffer(b"".join(right["code"]), dtype=np.uint8).reshape(len(right), -1)
            ids, own = right["vec_id"].to_numpy(), left["query_id"].to_numpy()
            scale, length, floor = right["scale"].to_numpy(), right["length"].to_numpy(), left["floor"].to_numpy()
            for a in range(0, len(q), 256):
                part = slice(a, a + 256)
                value, error = estimate(q[part], codes, scale, length)
                value[own[part][:, None] == ids[None, :]] = -np.inf
                lower = value - error
                sure = np.partition(lower, len(x) - top, axis=1)[:, len(x) - top] if len(x) > top else np.full(len(lower), -np.inf)
                need = np.maximum(sure, floor[part])
                maybe = (value + error >= need[:, None]) & (value > -np.inf)
                if maybe.sum() * 16 > maybe.size:  # many to rerank: one matrix product is cheaper than rows one by one
                    exact = np.where(maybe, q[part] @ x.T, -np.inf)
                else:
                    row, col = np.nonzero(maybe)
                    exact = np.full(maybe.shape, -np.inf)
                    exact[row, col] = np.einsum("ij,ij->i", q[part][row], x[col])
                last = np.partition(exact, len(x) - top, axis=1)[:, len(x) - top] if len(x) > top else np.full(len(exact), -np.inf)
                row, col = np.nonzero((exact >= last[:, None]) & maybe)
                exact = exact[row, col]
                order = np.lexsort((ids[col], -exact, row))
                row, col, exact = row[order], col[order], exact[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                kept = place < top
                out.append((own[part][row[kept]], ids[col[kept]], exact[kept]))
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), [np.concatenate(c) for c in zip(none, *out, strict=True)], strict=True)))

    return run


def search(embeddings: DataFrame, every: int = 100, top: int = 20, stages: Stages | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by ``every`` its ``top`` nearest of all other rows."""
    spark = embeddings.sparkSession
    stages = stages or Stages(spark, "ann")
    usable = stages.save(vectors.usable_vectors(embeddings), "usable")
    sizes = {r["dim"]: r["n"] for r in usable.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    centres = {d: vectors.cluster(vectors.sample_matrix(usable, d, SAMPLE, SEED), int(min(4096, max(1, np.sqrt(n) / 8))), SEED) for d, n in sizes.items()}
    shared = spark.sparkContext.broadcast(centres)

    def index(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == d)))
                x = vectors.matrix(part.column("vec").to_pylist(), int(d))
                own, square = vectors.nearest(x, shared.value[int(d)])
                codes, scale, length = encode(x)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("dim"), part.column("vec"), pa.array(own, pa.int32()), pa.array(np.sqrt(square[np.arange(len(x)), own])), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(length)],
                    names=["vec_id", "dim", "vec", "list", "far", "code", "scale", "length"],
                )

    indexed = stages.save(usable.mapInArrow(index, "vec_id long, dim int, vec binary, list int, far double, code binary, scale double, length double"), "index")
    asked = F.col("vec_id") % every == 0
    # One row for each list: at most 4096 a dimension.
    lists = indexed.groupBy("dim", "list").agg(F.max("far").alias("radius"), F.count("*").alias("n"), F.count_if(asked).alias("own_queries"))
    rows = lists.collect()
    radius = {(r["dim"], r["list"]): r["radius"] for r in rows}
    blocks = lists.select("dim", "list", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    members = indexed.join(blocks, ["dim", "list"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    queries = indexed.where(asked).select(F.col("vec_id").alias("query_id"), "dim", "vec", "list")
    result = "query_id long, vec_id long, score double"
    key = ["dim", "list", "block", "part"]

    def met(asking: DataFrame, asked_lists: DataFrame) -> DataFrame:
        """Queries (with list and floor) against the blocks of their lists; a list that ``n`` queries probe is met by as many parts as they fill."""
        parts = asked_lists.select("dim", "list", F.ceil(F.col("n") / QUERIES).cast("int").alias("parts"))
        left = asking.toDF(*asking.columns).join(blocks, ["dim", "list"]).join(parts, ["dim", "list"]).withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
        left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("query_id", "vec", "floor", *key)
        right = members.join(parts, ["dim", "list"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("vec_id", "vec", "code", "scale", "length", *key)
        right = right.toDF(*[f"r_{c}" if c in key else c for c in right.columns])
        return left.groupBy(*key).cogroup(right.groupBy(*[f"r_{c}" for c in key])).applyInPandas(block_top(top), result)

    first = stages.save(met(queries.withColumn("floor", F.lit(float("-inf"))), lists.where("own_queries > 0").select("dim", "list", F.col("own_queries").alias("n"))), "first")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = first.withColumn("r", F.row_number().over(best)).where(F.col("r") == top).select("query_id", F.col("score").alias("floor"))

    def probes(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            own, floor = batch.column("list").to_numpy(), batch.column("floor").to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                q = vectors.matrix([batch.column("vec")[int(i)].as_py() for i in at], int(d))
                c = shared.value[int(d)]
                reach = np.array([radius.get((int(d), j), -np.inf) for j in range(len(c))])
                bound = q @ c.T + np.linalg.norm(q, axis=1)[:, None] * reach[None, :] + 1e-9
                bound[np.arange(len(at)), own[at]] = -np.inf
                row, lst = np.nonzero((bound >= floor[at][:, None]) & (bound > -np.inf))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id").take(pa.array(at[row])), batch.column("dim").take(pa.array(at[row])), batch.column("vec").take(pa.array(at[row])), pa.array(lst, pa.int32()), pa.array(floor[at][row])],
                    names=["query_id", "dim", "vec", "list", "floor"],
                )

    wider = queries.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    wider = stages.save(wider.mapInArrow(probes, "query_id long, dim int, vec binary, list int, floor double"), "wider")
    second = met(wider, wider.groupBy("dim", "list").agg(F.count("*").alias("n")))
    found = reduce(DataFrame.union, [first, second])
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
