"""Embedding near-dedup with product quantisation.

Unit vectors stand in coarse inverted lists; residuals are cut into SUBSPACES parts, each coded by
its nearest of at most WORDS code words.  A vector probes every list that can hold a linked one:
linked vectors are within e = sqrt(2 - 2 * least) of each other, so the other one's list lies on
this side of, or within e beyond, the plane between that list's centre and the own one.  These
probes are sufficient; none is cut off by a count.  In a list, table lookups sum the asymmetric
distance to each code; as the code is off by a stored error, no linked vector is farther than
e plus that error.  What remains is reranked by exact cosine in double precision.

Centres and code words are fitted on at most SAMPLE rows; every row is indexed.  Lists and the
vectors that probe them are dealt in blocks.  A block of near copies gives counts and a spanning
forest of its links, never all of its pairs.

Edge cases: see ``usable_vectors`` (others link with nothing); a null label links with nothing;
vectors of different dimensions are not linked; rows that repeat a vec_id are one vector; a null
vec_id gives n_links 0 and no component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import vectors
from spindrift.llm.components import connected_components
from spindrift.sources.stage import Stages

SAMPLE, SEED = 8192, 17
SUBSPACES, WORDS = 8, 64
BLOCK = 1024
#: Rows whose distances to all centres are held at once.
CHUNK = 512


class Codebook:
    """Coarse centres and the code words of each subspace, of one dimension."""

    def __init__(self, x: np.ndarray, lists: int):
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        self.centres = vectors.cluster(unit, lists, SEED)
        rest = unit - self.centres[vectors.nearest(unit, self.centres)[0]]
        self.cuts = np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1]))
        self.words = [vectors.cluster(rest[:, c], WORDS, SEED) for c in self.cuts]

    def encode(self, unit: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, errors) of unit vectors in their lists."""
        rest = unit - self.centres[own]
        codes = np.stack([vectors.nearest(rest[:, c], w)[0] for c, w in zip(self.cuts, self.words, strict=True)], axis=1).astype(np.uint8)
        back = np.concatenate([w[codes[:, i]] for i, w in enumerate(self.words)], axis=1)
        return codes, np.linalg.norm(rest[:, np.concatenate(self.cuts)] - back, axis=1)

    def tables(self, unit: np.ndarray, lst: int) -> list[np.ndarray]:
        """For each subspace the squared distances of residual queries to its code words."""
        rest = unit - self.centres[lst]
        return [vectors.nearest(rest[:, c], w)[1] for c, w in zip(self.cuts, self.words, strict=True)]


def _block_links(shared, least: float, reach: float):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Per probing vector its number of links in the block, and the edges of a spanning forest."""
        if not len(left) or not len(right):
            return pd.DataFrame({"vec_id": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "to": np.zeros(0, np.int64)})
        dim, lst = int(left["dim"].iloc[0]), int(left["list"].iloc[0])
        book = shared.value[dim]
        q, x = vectors.matrix(left["vec"].tolist(), dim), vectors.matrix(right["vec"].tolist(), dim)
        qn, xn = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
        codes = np.frombuffer(b"".join(right["code"]), dtype=np.uint8).reshape(len(right), -1)
        limit = (reach + right["error"].to_numpy() + 1e-7) ** 2
        qid, xid = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        counts = np.zeros(len(q), dtype=np.int64)
        # Labels of the forest: the smallest id met so far, by node of the block.
        nodes = np.unique(np.concatenate([qid, xid]))
        parent = np.arange(len(nodes))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        edges: list[tuple[int, int]] = []
        xat, qat = np.searchsorted(nodes, xid), np.searchsorted(nodes, qid)
        for a in range(0, len(q), 256):
            part = slice(a, min(a + 256, len(q)))
            tables = book.tables(q[part] / qn[part, None], lst)
            near = sum(t[:, codes[:, i]] for i, t in enumerate(tables)) <= limit[None, :]
            near &= qid[part][:, None] != xid[None, :]
            rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            if not len(rows):
                continue
            exact = (q[part][rows] @ x[cols].T) / (qn[part][rows][:, None] * xn[cols][None, :])
            linked = near[np.ix_(rows, cols)] & (exact >= least)
            counts[a + rows] = linked.sum(axis=1)
            for i, row in zip(rows, linked, strict=True):
                hits = xat[cols[row]]
                if not len(hits):
                    continue
                me = root(int(qat[a + i]))
                # Only nodes that are not in this tree yet give an edge.
                for j in hits[parent[hits] != me].tolist():
                    other = root(j)
                    if other != me:
                        parent[other] = me
                        edges.append((int(qid[a + i]), int(nodes[j])))
                parent[hits] = me
        some = np.flatnonzero(counts)
        return pd.DataFrame(
            {
                "vec_id": np.concatenate([qid[some], np.array([e[0] for e in edges], np.int64)]),
                "n": np.concatenate([counts[some], np.zeros(len(edges), np.int64)]),
                "to": np.concatenate([qid[some], np.array([e[1] for e in edges], np.int64)]),
            }
        )

    return run


def near_duplicates(embeddings: DataFrame, least: float = 0.98, label: str = "label", stages: Stages | None = None) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept."""
    spark = embeddings.sparkSession
    stages = stages or Stages(spark, "pq")
    reach = float(np.sqrt(max(0.0, 2 - 2 * least)))
    labelled = embeddings.where(F.col(label).isNotNull()).select("vec_id", "embedding", F.col(label).alias("label"))
    usable = stages.save(vectors.usable_vectors(labelled, "label"), "usable")
    kind = dict(usable.dtypes)["label"]
    sizes = {r["dim"]: r["n"] for r in usable.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    books = {d: Codebook(vectors.sample_matrix(usable, d, SAMPLE, SEED), int(min(4096, max(1, np.sqrt(n) / 4)))) for d, n in sizes.items()}
    shared = spark.sparkContext.broadcast(books)

    def index(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for part, d in [(batch.take(pa.array(rows[a : a + CHUNK])), d) for d in np.unique(dims) for rows in [np.flatnonzero(dims == d)] for a in range(0, len(rows), CHUNK)]:
                book = shared.value[int(d)]
                x = vectors.matrix(part.column("vec").to_pylist(), int(d))
                unit = x / np.linalg.norm(x, axis=1)[:, None]
                own, square = vectors.nearest(unit, book.centres)
                codes, errors = book.encode(unit, own)
                # Distance to the plane between the own centre and each other one.
                homes, home = np.unique(own, return_inverse=True)
                lengths = (book.centres**2).sum(axis=1)
                apart = np.sqrt(np.maximum(lengths[homes][:, None] + lengths[None, :] - 2 * book.centres[homes] @ book.centres.T, 0))[home]
                beyond = (square - square[np.arange(len(x)), own][:, None]) / np.maximum(2 * apart, 1e-12)
                probe = (beyond <= reach + 1e-6) | (apart < 1e-3)
                probe[np.arange(len(x)), own] = True
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("vec_id", "dim", "vec", "label")]
                    + [pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors), pa.array([np.flatnonzero(p).astype(np.int32) for p in probe], pa.list_(pa.int32()))],
                    names=["vec_id", "dim", "vec", "label", "list", "code", "error", "probes"],
                )

    indexed = stages.save(usable.mapInArrow(index, f"vec_id long, dim int, vec binary, label {kind}, list int, code binary, error double, probes array<int>"), "index")
    cell = ["dim", "label", "list"]
    probing = indexed.select("vec_id", "dim", "label", F.explode("probes").alias("list"))
    held = indexed.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    asked = probing.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    cells = stages.save(held.join(asked, cell), "cells")
    right = indexed.join(cells, cell).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = indexed.select("vec_id", "dim", "vec", "label", F.explode("probes").alias("list")).join(cells, cell)
    left = left.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = [*cell, "block", "part"]
    left, right = left.select("vec_id", "vec", *key), right.select("vec_id", "vec", "code", "error", *key)
    right = right.toDF(*[f"r_{c}" if c in key else c for c in right.columns])
    found = left.groupBy(*key).cogroup(right.groupBy(*[f"r_{c}" for c in key])).applyInPandas(_block_links(shared, least, reach), "vec_id long, n long, to long")
    found = stages.save(found, "found")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    comps = connected_components(found.where("vec_id <> to").select(F.col("vec_id").alias("a"), F.col("to").alias("b")), stages)
    out = embeddings.select(F.col("vec_id").cast("long").alias("vec_id")).join(counts, "vec_id", "left").join(comps.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("comp", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))
