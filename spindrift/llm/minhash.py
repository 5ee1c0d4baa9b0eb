"""MinHash near-dedup with bottom-k sketches from one hash function.

1. Each text's word shingles are hashed once; its sketch is the K smallest hashes of the set.
   Texts with equal sets form one class (digest of the whole set), and classes go on alone.
2. Inverted lists of the retained values generate overlaps.  A list belongs to RUN values that
   follow each other in a sketch: of the union's K values, s shared ones and K - s others leave
   2 s - K - 1 pairs of neighbours at least that both sketches hold, and texts that are no copies
   seldom share one, so lists stay short as a corpus grows.  Keys are ordered from the rarest: two
   sketches that share enough of them share one among the first few of each (prefix filter), and
   keys that no other sketch holds count as misses at once.
3. A list is not expanded into pairs.  Each one has a centre (its smallest class), and all members
   are compared with it; links are contracted to components.  Then members outside the centre's
   component are compared with the whole list.  In lists of at most SHORT members these pairs are
   formed; longer ones are taken together by centre and compared block by block, a growing number
   of outside members a round.  A pair within one component needs no comparison: its link could
   join nothing new.
4. In all of these the union of two sketches estimates the similarity; pairs that are below the
   threshold by more than SIGMAS standard deviations go.
5. The rest is verified on full sets.

Edge cases: null and white texts have an empty set and are linked with nothing; a null doc_id is
linked with nothing (component_id null, kept); rows that repeat a doc_id are one node, whose links
are those of all of its texts (n_shingles is each row's own); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm import hashing
from spindrift.llm.components import connected_components
from spindrift.sources.stage import Stages

#: Retained values of a sketch, and how many standard deviations an estimate may be off.
K, SIGMAS = 64, 5.0
#: Members of a list whose pairs are formed, at most.
SHORT = 32
#: Rows of four numbers that are sent to every task, at most.
SENT = 1 << 17
#: Members outside a centre's component that are compared with a whole list in the first such round.
PIVOTS = 256
#: And in any later one; rounds go on until all have met their list.
MOST_PIVOTS = 1 << 14
#: Of those, and of a list's members, in a block.
PIVOT_BLOCK, MEMBER_BLOCK = 512, 2048


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    sizes = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=sizes[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat.astype(np.int64, copy=False)))


def shingle_sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(a, b, sets) for runs of a batch's texts; sets are sorted as signed numbers."""
    data, offsets = hashing.buffers(batch.column("text"))
    for a, b in hashing.chunks(offsets):
        part = offsets[a : b + 1] - offsets[a]
        hashes, _, _, first = hashing.words(data[offsets[a] : offsets[b]], part)
        yield a, b, [np.sort(_as_long(s)) for s in hashing.word_shingles(hashes, first, width)]


def _digests(sets: list[np.ndarray]) -> tuple[list[int | None], list[int | None]]:
    """A sum and an exclusive or over each set: equal for equal sets; null for an empty one."""
    with np.errstate(over="ignore"):
        d1 = [int(s.sum(dtype=np.int64)) if len(s) else None for s in sets]
        d2 = [int(np.bitwise_xor.reduce(hashing.mix(s.view(np.uint64) * np.uint64(3))).view(np.int64)) if len(s) else None for s in sets]
    return d1, d2


def _sketch(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in shingle_sets(batch, width):
                sizes = [len(s) for s in sets]
                d1, d2 = _digests(sets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), _lists([s[:k] for s in sets])],
                    names=["doc_id", "n_shingles", "d1", "d2", "sketch"],
                )

    return run


def _full(width: int):
    """Full sets of the texts that are their class's; another text of the same doc_id goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want1, want2 = batch.column("d1").to_numpy(), batch.column("d2").to_numpy()
            for a, b, sets in shingle_sets(batch, width):
                d1, d2 = _digests(sets)
                own = [i for i in range(b - a) if d1[i] == want1[a + i] and d2[i] == want2[a + i]]
                rep = batch.column("rep").take(pa.array([a + i for i in own], pa.int64()))
                yield pa.RecordBatch.from_arrays([rep, _lists([sets[i] for i in own])], names=["rep", "items"])

    return run


def _verify(share: int, of: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            lo, ro = left.offsets.to_numpy(), right.offsets.to_numpy()
            lv, rv = left.values.to_numpy(), right.values.to_numpy()
            ok = np.zeros(len(left), dtype=bool)
            for i in range(len(left)):
                x, y = lv[lo[i] : lo[i + 1]], rv[ro[i] : ro[i + 1]]
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                ok[i] = of * both >= share * (len(x) + len(y) - both)
            kept = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(kept), batch.column("b").take(kept)], names=["a", "b"])

    return run


def estimated(own: np.ndarray, flat: np.ndarray, at: np.ndarray, k: int, share: int, of: int) -> np.ndarray:
    """Does the union sketch of ``own`` and each of the sets flat[at[i]:at[i + 1]] (all sorted) leave room for the threshold?"""
    first, n = own[:k], np.minimum(np.diff(at), k)
    begin = np.concatenate([[0], np.cumsum(n)])
    rank = np.arange(begin[-1]) - np.repeat(begin[:-1], n)
    value = flat[np.repeat(at[:-1], n) + rank]
    near = np.searchsorted(first, value)
    hit = first[np.minimum(near, len(first) - 1)] == value
    shared = np.concatenate([[0], np.cumsum(hit)])
    before = shared[:-1] - np.repeat(shared[begin[:-1]], n)
    # A value's place in the union: those below it on both sides, shared ones once.
    both = np.diff(np.concatenate([[0], np.cumsum(hit & (near + rank - before < k))])[begin])
    size = len(first) + n - np.diff(shared[begin])
    return both >= np.where(size < k, np.ceil(size * (share / of) - 1e-9), _slack(k, share, of))


def _block_links(k: int, share: int, of: int):
    """Rows sorted by block, its pivots before its members: links between a pivot and members of other components, one for two components and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        pivots: list[tuple[int, int, np.ndarray]] = []
        joined: set[tuple[int, int]] = set()
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("centre", "block", "part", "kind")], axis=1)
            rep, comp = batch.column("rep").to_numpy(), batch.column("comp").to_numpy()
            items = batch.column("items")
            offsets, values = items.offsets.to_numpy().astype(np.int64), items.values.to_numpy()
            edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            found: list[tuple[int, int]] = []
            for a, b in zip(edge.tolist(), np.append(edge[1:], len(key)).tolist(), strict=True):
                if tuple(key[a, :3]) != last:
                    last, pivots, joined = tuple(key[a, :3]), [], set()
                if key[a, 3] == 0:
                    pivots += [(int(rep[i]), int(comp[i]), values[offsets[i] : offsets[i + 1]].copy()) for i in range(a, b)]
                    continue
                flat, at = values[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                for p_rep, p_comp, own in pivots:
                    for i in np.flatnonzero(estimated(own, flat, at, k, share, of) & (comp[a:b] != p_comp)).tolist():
                        two = (p_comp, int(comp[a + i]))
                        if two in joined:
                            continue
                        other = flat[at[i] : at[i + 1]]
                        near = np.minimum(np.searchsorted(own, other), len(own) - 1)
                        both = int((own[near] == other).sum())
                        if of * both >= share * (len(own) + len(other) - both):
                            found.append((p_rep, int(rep[a + i])))
                            joined.add(two)
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    return run


def _slack(k: int, share: int, of: int) -> int:
    """Fewest values that two sketches of k share when the sets' similarity is share / of (SIGMAS below the mean)."""
    p = share / of
    return max(1, math.floor(k * p - SIGMAS * math.sqrt(k * p * (1 - p))))


def least_shared(k: int, share: int, of: int) -> tuple[int, int]:
    """(run, least): how many values in a row are a key, and the keys that two sketches of k share at least.

    Of a union's k values ``_slack`` are shared or more.  The others part them into runs, at most one
    more than they are, so the pairs of neighbours among the shared ones have a least number too.
    Sets whose union is under k values share exact counts: 2 p u - u - 1 such pairs of u values.
    """
    pairs = 2 * _slack(k, share, of) - k - 1
    # Sets that are not equal have a union of 1 / (1 - p) values at least, which must leave a pair as well.
    return (2, pairs) if pairs >= 1 and 3 * share > 2 * of else (1, _slack(k, share, of))


class _Links:
    """Candidate pairs to verified links: the sketches, and the full sets of what their estimate leaves."""

    def __init__(self, sketches: DataFrame, texts: DataFrame, classes: DataFrame, width: int, k: int, share: int, of: int, stages: Stages):
        self.sketches, self.texts, self.classes, self.width = sketches, texts, classes, width
        self.k, self.share, self.of, self.stages = k, share, of, stages

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(rep, items) of the classes in ``wanted``; texts are shuffled, and only the wanted ones go on."""
        named = self.classes.join(wanted, "rep", "left_semi").select("rep", F.col("first_id").alias("doc_id"), "d1", "d2")
        named = self.stages.save(named, "named")
        # Few classes are sent to the texts; beyond that both sides are shuffled.
        named = F.broadcast(named) if named.count() <= SENT else named
        own = self.texts.join(named, "doc_id").select("rep", "text", "d1", "d2").mapInArrow(_full(self.width), "rep long, items array<long>")
        return self.stages.save(own, "sets")

    def estimate(self, pairs: DataFrame) -> DataFrame:
        left = self.sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"))
        right = self.sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"))
        union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, self.k)
        both = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
        p = self.share / self.of
        size = F.size(union)
        # A union of fewer than k values is the whole union: its count is exact.
        least = F.when(size < self.k, F.ceil(size * p - 1e-9)).otherwise(_slack(self.k, self.share, self.of))
        return self.stages.save(pairs.join(left, "a").join(right, "b").where(both >= least).select("a", "b"), "near")

    def __call__(self, pairs: DataFrame) -> DataFrame:
        near = self.estimate(pairs)
        sets = self.sets(near.select(F.col("a").alias("rep")).union(near.select(F.col("b").alias("rep"))).distinct())
        full = near.join(sets.select(F.col("rep").alias("a"), F.col("items").alias("left")), "a")
        full = full.join(sets.select(F.col("rep").alias("b"), F.col("items").alias("right")), "b")
        links = full.select("a", "b", "left", "right").mapInArrow(_verify(self.share, self.of), "a long, b long")
        links = self.stages.save(links, "links")
        self.stages.drop(near, sets)
        return links


def near_duplicates(documents: DataFrame, width: int = 5, share: int = 80, of: int = 100, k: int = K, stages: Stages | None = None) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_shingles, component_id, kept.

    Two documents are linked when of * |intersection| >= share * |union| of their shingle sets.
    """
    spark = documents.sparkSession
    stages = stages or Stages(spark, "minhash")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    feat = texts.mapInArrow(_sketch(width, k), "doc_id long, n_shingles long, d1 long, d2 long, sketch array<long>")
    feat = stages.save(feat.withColumn("row", F.monotonically_increasing_id()), "sketches")

    # Classes of equal sets, named by a row of theirs (an id may repeat with other texts).
    key = ["n_shingles", "d1", "d2"]
    usable = feat.where("d1 is not null and doc_id is not null")
    classes = usable.groupBy(*key).agg(F.min(F.struct("doc_id", "row")).alias("r"))
    classes = stages.save(classes.select(F.col("r.row").alias("rep"), F.col("r.doc_id").alias("first_id"), *key), "classes")
    reps = feat.join(classes.select(F.col("rep").alias("row")), "row", "left_semi").select(F.col("row").alias("rep"), "n_shingles", "sketch")
    reps = stages.save(reps, "reps")
    ids = stages.save(feat.select("doc_id", *key), "ids")
    stages.drop(feat)

    # Keys that two classes or more hold, from the rarest; how many of them a partner must meet.
    run, least_keys = least_shared(k, share, of)
    if run == 2:
        n = F.size("sketch") - 1
        values = reps.where("size(sketch) > 1").select("rep", F.inline(F.arrays_zip(F.slice("sketch", F.lit(1), n).alias("x"), F.slice("sketch", F.lit(2), n).alias("y"))))
        values = values.select("rep", F.xxhash64("x", "y").alias("h"))
    else:
        values = reps.select("rep", F.explode("sketch").alias("h"))
    held = values.groupBy("h").agg(F.count("*").cast("int").alias("df")).where("df > 1")
    # Tables of their own, so that a frequent value's partition of the join can be split.
    held = stages.save(held, "held")
    shared = values.join(held, "h").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("order"))
    shared = shared.join(reps.select("rep", "n_shingles"), "rep")
    p = share / of
    # Sets that can only have partners whose sketch is the whole set share an exact number of values.
    exact = F.col("n_shingles") * p if run == 1 else F.col("n_shingles") * (2 * p - 1) - 1
    least = F.when(F.col("n_shingles") <= F.floor(F.lit(k * p)), F.greatest(F.ceil(exact - 1e-9), F.lit(1))).otherwise(least_keys)
    # Keys that no other class holds are misses, so of a class's other keys all but ``least - 1`` are tried.
    reach = F.greatest(F.lit(0), F.size("order") - least + 1)
    prefix = shared.select("rep", "n_shingles", F.explode(F.slice("order", F.lit(1), reach.cast("int"))["h"]).alias("h"))
    prefix = stages.save(prefix, "prefix")
    lists = prefix.groupBy("h").agg(F.count("*").alias("df"), F.min(F.struct("rep", "n_shingles")).alias("c")).where("df > 1")
    lists = stages.save(lists.select("h", "df", F.col("c.rep").alias("centre"), F.col("c.n_shingles").alias("n_centre")), "lists")
    listed = stages.save(prefix.join(lists, "h").select("h", "df", "centre", "n_centre", "rep", "n_shingles"), "listed")
    stages.drop(prefix, lists, held)
    wanted = stages.save(listed.select("rep").distinct(), "wanted")
    members = stages.save(listed.where(F.col("df") > SHORT).select("centre", "rep", "n_shingles").distinct(), "members")
    sketches = stages.save(reps.join(wanted, "rep", "left_semi").select("rep", "sketch"), "wanted_sketches")
    stages.drop(reps)
    linked = _Links(sketches, texts, classes, width, k, share, of, stages)

    def can_link(x: str, y: str):
        return (F.col(x) * of >= F.col(y) * share) & (F.col(y) * of >= F.col(x) * share)

    # Texts of one id are one node.
    nodes = ids.join(classes, key).select("doc_id", "rep")
    twice = nodes.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a")
    links = stages.save(nodes.join(twice, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b")), "same_id")

    first = listed.where((F.col("rep") != F.col("centre")) & can_link("n_shingles", "n_centre"))
    links = links.union(linked(first.select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()))
    comps = connected_components(links, stages)

    def with_components(df: DataFrame) -> DataFrame:
        """``comp`` of rep and ``c_comp`` of centre beside the columns of ``df``."""
        own = comps.toDF("node", "comp")
        other = comps.toDF("c_node", "c_comp")
        out = df.join(own, F.col("rep") == F.col("node"), "left").join(other, F.col("centre") == F.col("c_node"), "left")
        return out.select(*df.columns, F.coalesce("comp", "rep").alias("comp"), F.coalesce("c_comp", "centre").alias("c_comp"))

    # Short lists: outside members against all members of other components.
    short = stages.save(with_components(listed.where(F.col("df") <= SHORT).select("h", "rep", "centre", "n_shingles")), "short")
    outside = short.where("comp <> c_comp").select("h", F.col("rep").alias("other"), F.col("n_shingles").alias("n_other"), F.col("comp").alias("o_comp"))
    met = short.select("h", "rep", "n_shingles", "comp").join(outside, "h").where((F.col("comp") != F.col("o_comp")) & can_link("n_shingles", "n_other"))
    fresh = linked(met.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct())
    stages.drop(short, listed)
    if fresh.limit(1).count():
        links = links.union(fresh)
        comps = connected_components(links, stages)

    done, sets, pivots = None, None, PIVOTS
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        # Members with their components; lists whose centres are linked are one, called by the centres' component.
        now = stages.save(with_components(members), "now")
        met = now.select(F.col("c_comp").alias("centre"), "rep", "n_shingles", "comp").distinct()
        # Those outside the centre's component that have not met the whole list yet.
        outside = now.where("comp <> c_comp")
        if done is not None:
            outside = outside.join(done, ["centre", "rep"], "left_anti")
        slot = F.pmod(F.xxhash64("rep", F.lit(pivots)), F.lit(pivots))
        picked = outside.groupBy(F.col("c_comp").alias("centre"), slot.alias("slot")).agg(F.min(F.struct("rep", "comp", "n_shingles")).alias("p"))
        # Blocks of pivots of like size, which few sizes can be linked with; a centre has at most ``pivots`` of them here.
        by_size = F.row_number().over(Window.partitionBy("centre").orderBy("n_shingles", "rep")) - 1
        picked = picked.select("centre", "p.rep", "p.comp", "p.n_shingles").withColumn("block", F.floor(by_size / PIVOT_BLOCK))
        picked = stages.save(picked, "pivots")
        if not picked.limit(1).count():
            break
        met = met.join(picked.select("centre").distinct(), "centre", "left_semi")
        if sets is None:
            # Only lists that have members outside of their centre's component come back here.
            sets = linked.sets(met.select("rep").distinct())
        blocks = picked.groupBy("centre", "block").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
        fits = (F.col("n_shingles") * of >= F.col("low") * share) & (F.col("high") * of >= F.col("n_shingles") * share)
        asked = stages.save(met.join(blocks, "centre").where(fits).select("centre", "block", "rep", "comp"), "asked")
        parts = stages.save(asked.groupBy("centre", "block").agg(F.ceil(F.count("*") / MEMBER_BLOCK).alias("parts")), "parts")
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        asking = picked.join(parts, ["centre", "block"]).select("centre", "block", each.alias("part"), F.lit(0).cast("long").alias("kind"), "rep", "comp")
        asked = asked.join(parts, ["centre", "block"]).select("centre", "block", F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part"), F.lit(1).cast("long").alias("kind"), "rep", "comp")
        rows = asking.union(asked).join(sets, "rep").repartition(n_parts, "centre", "block", "part").sortWithinPartitions("centre", "block", "part", "kind", "rep")
        fresh = stages.save(rows.select("centre", "block", "part", "kind", "rep", "comp", "items").mapInArrow(_block_links(k, share, of), "a long, b long"), "links")
        # A pivot has met each list that was taken together here.
        seen = now.join(picked.select(F.col("centre").alias("c_comp"), "rep"), ["c_comp", "rep"], "left_semi").select("centre", "rep")
        done = seen if done is None else done.union(seen)
        if fresh.limit(1).count():
            links = links.union(fresh)
            comps = connected_components(links, stages)
        pivots = min(pivots * 4, MOST_PIVOTS)
    # What only the rounds read; the result needs the classes, ids and components.
    stages.drop(members, sketches, now, picked, *([sets] if sets is not None else []))
    # The smallest doc_id of a component is the smallest first id of its classes.
    met = classes.join(comps.toDF("rep", "comp"), "rep")
    smallest = met.groupBy("comp").agg(F.min("first_id").alias("smallest"))
    found = classes.join(met.select("rep", "comp").join(smallest, "comp").select("rep", "smallest"), "rep", "left")
    f, c = ids.alias("f"), found.select(*key, F.coalesce("smallest", "first_id").alias("smallest")).alias("c")
    same = (F.col("f.n_shingles") == F.col("c.n_shingles")) & (F.col("f.d1") == F.col("c.d1")) & (F.col("f.d2") == F.col("c.d2"))
    out = f.join(c, same, "left").select("f.doc_id", "f.n_shingles", F.when(F.col("f.doc_id").isNotNull(), F.coalesce("c.smallest", "f.doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
