"""Language-model scoring with Brown classes.

1. Training tokens are counted, all of them.  The FREQUENT most frequent words (a bound, not a
   sample: it only decides what is sent to the tasks) are looked up there; counts of the others
   come by a join on the word's hash.
2. Exchange clustering assigns the CLUSTERED most frequent words to classes, whose number grows
   with the cube root of the vocabulary (CLASSES at least).  Each round counts, over all training
   tokens, every word's neighbours by class (at most CLUSTERED times the classes, twice) and then
   moves each word to the class with the greatest gain in the likelihood of the class bigrams.
3. Every other training word goes, in one distributed pass over its own neighbour counts, to the
   class with the greatest gain by the same measure.  The end is a class of its own, and so are
   unseen words; class bigrams are counted again over all training tokens.
4. P(token | history) = P(class | class before) * P(token | class): transitions smoothed towards
   the classes' shares, emissions by counts, with half a count for each word and, in each class,
   for an unseen one.

Edge cases: null and empty texts are one end token; with no training documents every count is 0
and all scores are finite; a null doc_id counts as training; rows that repeat count and are
scored one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import hashing
from spindrift.llm.quality import fold
from spindrift.sources.stage import Stages

FREQUENT, CLUSTERED, CLASSES, ROUNDS = 1 << 19, 8192, 64, 4
#: Words up to which there are CLASSES classes.
SMALL = 1 << 16
#: Neighbour counts that are weighed at once.
WEIGHED = 8192
#: Weight of the classes' shares in a transition.
SHARE = 5.0
#: The fold that no statistic sees.
HELD = 1
#: Distinct words that a task gathers before it hands them on.
FLUSH = 1 << 20


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts, pending = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        h, n = np.concatenate(keys), np.concatenate(counts)
        u, inverse = np.unique(h, return_inverse=True)
        return u, np.bincount(inverse, weights=n).astype(np.int64)

    def out(h: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(h), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(h[a : a + (1 << 16)].view(np.int64)), pa.array(n[a : a + (1 << 16)])], names=["h", "n"])

    for batch in batches:
        data, offsets = hashing.buffers(batch.column("text"))
        for a, b in hashing.chunks(offsets):
            h = hashing.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[0]
            u, n = np.unique(h, return_counts=True)
            keys.append(u)
            counts.append(n)
            pending += len(u)
            if pending > FLUSH:
                u, n = merged()
                keys, counts, pending = [u], [n], len(u)
                if pending > FLUSH // 2:
                    yield from out(u, n)
                    keys, counts, pending = [], [], 0
    if keys:
        yield from out(*merged())


def n_classes(words: int) -> int:
    """Classes for so many distinct words."""
    return max(CLASSES, int(CLASSES * (words / SMALL) ** (1 / 3)))


def _tokens(shared):
    """Texts to token rows: places of frequent words by count (-1 for others), sums over them, hashes of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs, place, end_log = shared.value
        for batch in batches:
            data, offsets = hashing.buffers(batch.column("text"))
            for a, b in hashing.chunks(offsets):
                h, _, _, first = hashing.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                hit = known[at] == h if len(known) else np.zeros(len(h), dtype=bool)
                value = np.where(hit, logs[at], 0.0) if len(known) else np.zeros(len(h))
                ids = np.where(hit, place[at], -1) if len(known) else np.full(len(h), -1)
                sums = np.concatenate([[0.0], np.cumsum(value)])
                rare = np.concatenate([[0], np.cumsum(~hit)])
                n = b - a
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, n),
                        batch.column("held_out").slice(a, n),
                        pa.array(np.diff(first) + 1, pa.int64()),
                        pa.array(sums[first[1:]] - sums[first[:-1]] + end_log),
                        pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(rare[first], pa.int32()), pa.array(h[~hit].view(np.int64))),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "logs", "ids", "rare"],
                )

    return run


TOKENS = "doc_id {kind}, held_out boolean, n_tokens long, logs double, ids array<int>, rare array<long>"


def _flat(column: pa.ListArray) -> np.ndarray:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.int64)


def _ended(column: pa.ListArray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, starts) of lists, each with ``end`` behind."""
    offsets = column.offsets.to_numpy().astype(np.int64) if len(column) else np.zeros(1, np.int64)
    ends = offsets[1:] - offsets[0] + np.arange(len(column))
    flat = _flat(column)
    out = np.full(len(flat) + len(column), end, dtype=np.int64)
    inner = np.ones(len(out), dtype=bool)
    inner[ends] = False
    out[inner] = flat
    return out, np.concatenate([[0], ends + 1])[:-1]


def _sequences(batch: pa.RecordBatch, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, classes, starts) of a batch, each text with its end token behind; words outside of the clustering are one."""
    ids, starts = _ended(batch.column("ids"), -2)
    words = np.where(ids == -2, CLUSTERED + 1, np.where((ids < 0) | (ids >= CLUSTERED), CLUSTERED, ids))
    return words, classes[words], starts


def _before(cls: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    out = np.concatenate([[end], cls[:-1]]) if len(cls) else cls.copy()
    out[starts] = end
    return out


def _neighbours(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, width = shared.value
        total = np.zeros((CLUSTERED + 2) * 2 * width, dtype=np.int64)
        for batch in batches:
            words, cls, starts = _sequences(batch, classes)
            if not len(words):
                continue
            before = _before(cls, starts, width - 1)
            total += np.bincount((words * 2 + 1) * width + before, minlength=len(total))
            # The word before each token, where it is in the same text.
            inside = np.ones(len(words), dtype=bool)
            inside[starts] = False
            at = np.flatnonzero(inside)
            total += np.bincount(words[at - 1] * 2 * width + cls[at], minlength=len(total))
        at = np.flatnonzero(total)
        for a in range(0, len(at), 1 << 16):
            part = at[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(total[part])], names=["cell", "n"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(right: np.ndarray, left: np.ndarray, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """One sweep: each word, by falling frequency, goes to the class that gains most.

    right[w, c] and left[w, c] count the neighbours of word w by class; only the first
    ``len(classes)`` words may move, only to the first ``n_classes`` classes.
    """
    classes = classes.copy()
    width = right.shape[1]
    table = np.zeros((width, width))
    movable = len(classes)
    np.add.at(table, classes, right[:movable])
    for extra in range(movable, len(right)):  # the class of the remaining words, and the end
        table[n_classes + extra - movable] += right[extra]
    for w in range(movable):
        r, l_ = right[w], left[w]
        if not r.any() and not l_.any():
            continue
        g = classes[w]
        table[g] = np.maximum(table[g] - r, 0)
        table[:, g] = np.maximum(table[:, g] - l_, 0)
        rows, cols = table[:n_classes], table[:, :n_classes]
        on, up = np.flatnonzero(r), np.flatnonzero(l_)
        gain = (_xlogx(rows[:, on] + r[on]) - _xlogx(rows[:, on])).sum(axis=1) + (_xlogx(cols[up] + l_[up, None]) - _xlogx(cols[up])).sum(axis=0)
        row_sum, col_sum = rows.sum(axis=1), cols.sum(axis=0)
        gain -= _xlogx(row_sum + r.sum()) - _xlogx(row_sum) + _xlogx(col_sum + l_.sum()) - _xlogx(col_sum)
        g = int(gain.argmax())
        classes[w] = g
        table[g] += r
        table[:, g] += l_
    return classes


def _tail(shared):
    """Neighbour counts (word's hash, side and class, count) of the words outside of the clustering."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, width, by_place = shared.value
        parts: list[tuple[np.ndarray, ...]] = []
        pending = 0

        def merged() -> tuple[np.ndarray, ...]:
            h, cell, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((cell, h))
            h, cell, n = h[order], cell[order], n[order]
            cut = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (cell[1:] != cell[:-1])])
            return h[cut], cell[cut], np.add.reduceat(n, cut)

        def out(h: np.ndarray, cell: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(h), 1 << 16):
                b = a + (1 << 16)
                yield pa.RecordBatch.from_arrays([pa.array(h[a:b]), pa.array(cell[a:b] << 40 | n[a:b])], names=["h", "packed"])

        for batch in batches:
            ids, starts = _ended(batch.column("ids"), -2)
            _, cls, _ = _sequences(batch, classes)
            h = np.zeros(len(ids), dtype=np.int64)
            h[ids >= 0] = by_place[ids[ids >= 0]]
            h[ids == -1] = _flat(batch.column("rare"))
            at = np.flatnonzero((ids == -1) | (ids >= CLUSTERED))
            if not len(at):
                continue
            # An end stands behind every word of a text.
            parts.append((np.r_[h[at], h[at]], np.r_[cls[at + 1], width + _before(cls, starts, width - 1)[at]], np.ones(2 * len(at), dtype=np.int64)))
            pending += 2 * len(at)
            # Rare words seldom repeat in a task: little is gained by holding more.
            if pending > FLUSH // 4:
                yield from out(*merged())
                parts, pending = [], 0
        if parts:
            yield from out(*merged())

    return run


def assign(word: np.ndarray, cell: np.ndarray, n: np.ndarray, n_words: int, table: np.ndarray, k: int) -> np.ndarray:
    """The class that gains most for each word of the remaining words' class ``k``, from its counts by side and class.

    ``word`` is in order and every word has counts; ``table`` holds the class bigrams with all these words in class ``k``.
    """
    width = len(table)
    best = np.zeros(n_words, dtype=np.int64)
    bounds = np.searchsorted(word, np.arange(n_words + 1))
    sums = np.stack([table[:k].sum(axis=1), table[:, :k].sum(axis=0)])
    # By side and the neighbour's class: the counts of each class with it.
    base = np.stack([table[:k].T, table[:, :k]])
    logs, sum_logs = _xlogx(base), _xlogx(sums)
    one = _xlogx(base + 1) - logs
    a = 0
    while a < n_words:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + WEIGHED, side="right")) - 1)
        part = slice(bounds[a], bounds[b])
        w, (side, c), m = word[part] - a, np.divmod(cell[part], width), n[part].astype(float)
        more = one[side, c]
        many = np.flatnonzero(m > 1)
        more[many] = _xlogx(base[side[many], c[many]] + m[many, None]) - logs[side[many], c[many]]
        gain = np.add.reduceat(more, bounds[a:b] - bounds[a], axis=0)
        total, rest = np.zeros((2, b - a)), np.zeros((2, b - a))
        np.add.at(total, (side, w), m)
        rest[side[c == k], w[c == k]] = m[c == k]
        for s in (0, 1):
            kinds, which = np.unique(total[s], return_inverse=True)
            gain -= (_xlogx(sums[s] + kinds[:, None]) - sum_logs[s])[which]
        # The word itself is not in the class of the remaining words while it is weighed: less in its neighbours' classes.
        near = np.flatnonzero(c < k)
        other, w, c, m = 1 - side[near], w[near], c[near], m[near]
        for had, add, sign in ((base[other, k, c], rest[other, w], 1), (sums[other, c], total[other, w], -1)):
            less = np.maximum(had - m, 0)
            np.add.at(gain, (w, c), sign * (_xlogx(less + add) - _xlogx(less) - _xlogx(had + add) + _xlogx(had)))
        best[a:b] = gain.argmax(axis=1)
        a = b
    return best


def _assigned(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, k = shared.value
        cells = 2 * len(table)
        for whole in batches:
            for a in range(0, len(whole), 4096):
                batch = whole.slice(a, 4096)
                packed = _flat(batch.column("packed"))
                key = np.repeat(np.arange(len(batch)), np.diff(batch.column("packed").offsets.to_numpy())) * cells + (packed >> 40)
                key, inverse = np.unique(key, return_inverse=True)
                n = np.bincount(inverse, weights=packed & (1 << 40) - 1).astype(np.int64)
                word, cell = np.divmod(key, cells)
                # Each token has one token (or end) before it.
                count = np.bincount(word, weights=np.where(cell >= cells // 2, n, 0), minlength=len(batch)).astype(np.int64)
                best = assign(word, cell, n, len(batch), table, k)
                yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(best.astype(np.int16)), pa.array(count)], names=["h", "class", "c"])

    return run


def _sure(shared):
    """Token rows with the class of each word that is sent to the tasks, -1 for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_place = np.append(shared.value, np.int16(-1))
        for batch in batches:
            column = batch.column("ids")
            offsets = pa.array(column.offsets.to_numpy() - column.offsets[0].as_py(), pa.int32())
            kept = ["row", "doc_id", "held_out", "n_tokens", "logs", "n_rare"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.ListArray.from_arrays(offsets, pa.array(by_place[_flat(column)]))], names=[*kept, "classes"])

    return run


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token rows with the class of each token; ``rare_classes`` are those of the words that are not sent to the tasks."""
    for batch in batches:
        column = batch.column("classes")
        cls = _flat(column).astype(np.int16)
        cls[cls < 0] = _flat(batch.column("rare_classes")) & 65535
        offsets = pa.array(column.offsets.to_numpy() - column.offsets[0].as_py(), pa.int32())
        kept = ["doc_id", "held_out", "n_tokens", "logs", "n_rare", "rare_logs", "rare_known"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.ListArray.from_arrays(offsets, pa.array(cls))], names=[*kept, "classes"])


CLASSED = "doc_id {kind}, held_out boolean, n_tokens long, logs double, n_rare long, rare_logs double, rare_known long"


def _bigrams(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width, dtype=np.int64)
        for batch in batches:
            cls, starts = _ended(batch.column("classes"), width - 1)
            total += np.bincount(_before(cls, starts, width - 1) * width + cls, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["cell", "n"])

    return run


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shared.value
        end = len(value) - 1
        for batch in batches:
            cls, starts = _ended(batch.column("classes"), end)
            sums = np.concatenate([[0.0], np.cumsum(value[_before(cls, starts, end), cls])])
            ends = np.append(starts[1:], len(cls))[: len(batch)]
            kept = [c for c in batch.schema.names if c != "classes"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sums[ends] - sums[starts])], names=[*kept, "inner"])

    return run


def score_documents(documents: DataFrame, stages: Stages | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = documents.sparkSession
    stages = stages or Stages(spark, "brown")
    send = spark.sparkContext.broadcast
    held = F.coalesce(fold(F.col("doc_id")) == HELD, F.lit(False))
    texts = documents.select("doc_id", held.alias("held_out"), F.col("text").cast("string").alias("text"))

    counted = texts.where("not held_out").select("text").mapInArrow(_count_words, "h long, n long")
    vocabulary = stages.save(counted.groupBy("h").agg(F.sum("n").alias("c")), "vocabulary")
    n_words, n_seen = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_ends = texts.where("not held_out").count()
    total, distinct = n_words + n_ends, n_seen + (n_ends > 0)

    # The least count of a frequent word, from a histogram whose size does not depend on the input.
    bucket = F.when(F.col("c") < 1024, F.col("c")).otherwise(1024 + F.floor(F.log2("c") * 64)).cast("long")
    steps = sorted(((b, n) for b, n in vocabulary.groupBy(bucket.alias("b")).count().collect()), reverse=True)
    room, least = FREQUENT, None
    for b, n in steps:
        if n > room:
            break
        room, least = room - n, b
    frequent = vocabulary.where(bucket >= least) if least is not None else vocabulary.limit(0)
    got = frequent.toArrow()
    h, c = got.column("h").to_numpy().view(np.uint64), got.column("c").to_numpy().astype(np.int64)
    by_count = np.lexsort((h, -c))
    place = np.empty(len(h), dtype=np.int64)
    place[by_count] = np.arange(len(h))
    order = np.argsort(h)
    end_log = float(np.log10(n_ends + 0.5))
    known = send((h[order], np.log10(c + 0.5)[order], place[order], end_log))

    kind = dict(texts.dtypes)["doc_id"]
    tokens = texts.mapInArrow(_tokens(known), TOKENS.format(kind=kind)).withColumn("row", F.monotonically_increasing_id())
    tokens = stages.save(tokens, "tokens")
    training = tokens.where("not held_out").select("ids", "rare")

    def neighbours(classes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        cells = training.select("ids").mapInArrow(_neighbours(send((classes, width))), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        full = np.zeros((CLUSTERED + 2) * 2 * width)
        full[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
        full = full.reshape(CLUSTERED + 2, 2, width)
        return full[:, 0], full[:, 1]

    k = n_classes(n_seen)
    n_movable, width = min(len(h), CLUSTERED), k + 2
    # At first the most frequent words are classes of their own, and the rest of the words follow their neighbours.
    classes = np.full(CLUSTERED + 2, k, dtype=np.int64)
    classes[: min(k, n_movable)] = np.arange(min(k, n_movable))
    classes[k:n_movable] = np.arange(max(0, n_movable - k)) % k
    classes[CLUSTERED + 1] = k + 1
    start = classes.copy()
    start[k:n_movable] = k
    for turn in range(ROUNDS):
        right, left = neighbours(start if turn == 0 else classes, width)
        keep = np.r_[0:n_movable, CLUSTERED, CLUSTERED + 1]
        for _ in range(3 if turn == 0 else 1):
            classes[:n_movable] = exchange(right[keep], left[keep], classes[:n_movable], k)
    _, left = neighbours(classes, width)
    # Class bigrams by the class before each token; a text's first token follows an end.
    table = np.zeros((width, width))
    np.add.at(table.T, classes, left)

    # All other training words go to classes by their own neighbours.
    by_place = h[by_count].view(np.int64)
    near = training.mapInArrow(_tail(send((classes, width, by_place))), "h long, packed long")
    # A cell and its count share a long, as lists of structs take four times the room.
    near = near.groupBy("h").agg(F.collect_list("packed").alias("packed"))
    assigned = stages.save(near.mapInArrow(_assigned(send((table, k))), "h long, class smallint, c long"), "assigned")
    sent = assigned.where(bucket >= least).select("h", "class").toArrow() if least is not None else None
    class_by_place = np.full(len(h), k, dtype=np.int16)
    class_by_place[:n_movable] = classes[:n_movable]
    if sent is not None and sent.num_rows:
        at = np.searchsorted(h[order], sent.column("h").to_numpy().view(np.uint64))
        class_by_place[place[order][at]] = sent.column("class").to_numpy()

    rare = tokens.select("row", F.posexplode("rare").alias("pos", "h")).join(assigned, "h", "left")
    rare = rare.groupBy("row").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("rare_logs"),
        F.count("c").alias("rare_known"),
        F.sort_array(F.collect_list(F.col("pos").cast("long") * 65536 + F.coalesce("class", F.lit(k)))).alias("rare_classes"),
    )
    # The classes that are known go through the join, two bytes a token.
    fields = "row long, doc_id {kind}, held_out boolean, n_tokens long, logs double, n_rare long".format(kind=kind)
    sure = tokens.withColumn("n_rare", F.size("rare").cast("long")).drop("rare").mapInArrow(_sure(send(class_by_place)), f"{fields}, classes array<smallint>")
    whole = sure.join(rare, "row", "left").select(
        *["doc_id", "held_out", "n_tokens", "logs", "n_rare", "classes"],
        F.coalesce("rare_logs", F.lit(0.0)).alias("rare_logs"),
        F.coalesce("rare_known", F.lit(0)).cast("long").alias("rare_known"),
        F.coalesce("rare_classes", F.array().cast("array<long>")).alias("rare_classes"),
    )
    fields = CLASSED.format(kind=kind)
    classed = stages.save(whole.mapInArrow(_classed, f"{fields}, classes array<smallint>"), "classed")

    cells = classed.where("not held_out").select("classes").mapInArrow(_bigrams(width), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(width * width)
    table[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    table = table.reshape(width, width)
    class_total = table.sum(axis=0)
    shares = (class_total + 0.5) / (class_total.sum() + 0.5 * width)
    transition = (table + SHARE * shares) / (table.sum(axis=1, keepdims=True) + SHARE)
    members = np.bincount(classes[:n_movable], minlength=width)
    for g, m in assigned.groupBy("class").count().collect():
        members[g] += m
    norm_in = class_total[:k] + 0.5 * (members[:k] + 1)
    # By the class before and the class: known words less their log10(c + 0.5), unseen ones (from any class), the end.
    value = np.log10(transition)
    value[:, :k] -= np.log10(norm_in)
    value[:, k] = np.log10(transition[:, k] + (transition[:, :k] * 0.5 / norm_in).sum(axis=1))

    out = classed.mapInArrow(_score(send(value)), f"{fields}, inner double")
    norm = float(np.log10(total + 0.5 * (distinct + 1)))
    unseen = F.col("n_rare") - F.col("rare_known")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_tokens") - unseen - F.lit(0 if n_ends else 1)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("rare_logs") - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("inner") + F.col("logs") - F.lit(end_log) + F.col("rare_logs") - unseen * float(np.log10(0.5))).alias("score"),
    )
