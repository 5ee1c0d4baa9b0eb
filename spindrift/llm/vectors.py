"""Reading vectors: usable rows as packed doubles, and clustering of a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_vectors(embeddings: DataFrame, *more: str) -> DataFrame:
    """(vec_id, dim, vec, then ``more``): vectors that are not null, not zero and hold finite numbers only.

    ``vec`` is the vector's doubles as bytes.  Rows without a vec_id take no part; rows that
    repeat a vec_id count once, with the smallest vector.
    """
    columns = [F.col("embedding").cast("array<double>").alias("embedding"), *more]
    plain = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), *columns).where("vec_id is not null and embedding is not null")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    once = plain.where(fine).groupBy("vec_id").agg(F.min(F.struct("embedding", *more)).alias("r")).select("vec_id", "r.*")
    kinds = dict(once.dtypes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            offsets = column.offsets.to_numpy()
            values = np.ascontiguousarray(column.values.to_numpy(zero_copy_only=False), dtype=np.float64)
            raw = [values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(np.diff(offsets), pa.int32()), pa.array(raw, pa.binary()), *[batch.column(c) for c in more]], names=["vec_id", "dim", "vec", *more]
            )

    return once.mapInArrow(pack, "vec_id long, dim int, vec binary" + "".join(f", `{c}` {kinds[c]}" for c in more))


def matrix(column: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(-1, dim)


def sample_matrix(vectors: DataFrame, dim: int, rows: int, seed: int) -> np.ndarray:
    """The first ``rows`` vectors by a hash of their id: what an index is fitted on."""
    got = vectors.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(rows).select("vec").toArrow()
    return matrix(got.column("vec").to_pylist(), dim)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest centre, squared distances to all) for each row."""
    d = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)
    return d.argmin(axis=1), np.maximum(d, 0)


def cluster(x: np.ndarray, k: int, seed: int, turns: int = 10) -> np.ndarray:
    """k-means centres of the rows of x (k at most, as many as there are distinct rows)."""
    random = np.random.default_rng(seed)
    x = x[random.permutation(len(x))]
    centres = np.unique(x[: max(k, 1)], axis=0)
    for _ in range(turns):
        own, _ = nearest(x, centres)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres
