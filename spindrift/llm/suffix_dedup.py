"""Suffix-array dedup of byte strings that occur more than once anywhere in a corpus.

A string of LENGTH bytes holds WINDOW grams of GRAM bytes; the one with the smallest hash (the
rightmost among equal) is its anchor.  The anchor depends on the string's bytes alone, so equal
strings have equal anchors at equal places, and the strings of a text fall into runs that share
an anchor occurrence.  Of these runs only hashes are shuffled:

1. Anchors that occur once end here.  Runs whose whole context is equal are equal string by string.
2. Anchors whose occurrences differ in context need the bytes.  One context of each kind goes to a
   shard of its anchor; there a suffix order to depth LENGTH over the concatenated contexts gives,
   for each string, the previous and the next smaller position and so its longest previous factor
   (and, from behind, whether it comes again).
3. An anchor with more than SHARD kinds of context is dealt to several shards.  Each shard hands on
   the first of its equal strings, and these are compared across shards by hash: STEP strings at
   neighbouring places first by the bytes that all of them hold, and one by one only where that
   core comes again.

The same is done over words in place of bytes for ``passages``: the words of a text that strings of
so many words cover which come again.  A passage of over 50 words may have under LENGTH bytes (half
of such strings have 321 or less in `check_s`); it is counted there and not removed.

``keep_first`` removes later copies only (first by doc_id, then by the text's hash, then by place);
else every copy goes.

Edge cases: null text is empty; texts under LENGTH bytes stay whole; matches never cross texts;
overlapping copies within a text count; rows that repeat (same id and text) are copies of each
other and treated alike; a null doc_id is an id like others; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import hashing, suffixes
from spindrift.sources.stage import Stages

LENGTH, GRAM = 400, 200
#: Words of a passage, at least.
PASSAGE = 51
#: Kinds of context of one anchor in a shard, and bytes of contexts that one suffix order spans, about.
SHARD, BUFFER = 256, 1 << 21
STEP = 16
PLACE = np.uint64((1 << 24) - 1)
SEGMENT = 1 << 22


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i+width]) for each i, by running minima of blocks from both sides."""
    n = len(x)
    if n < width:
        return x[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, lo, hi, anchor hash, context hash) of each run: its strings start at lo..hi (inclusive) of the data."""
    n = len(data)
    window = length - gram + 1
    out: list[tuple[np.ndarray, ...]] = []
    if n >= length:
        pre = hashing.prefix(data)
        limit = np.repeat(offsets[1:], np.diff(offsets)) - length  # the last start within the text
        for base in range(0, n - length + 1, SEGMENT):
            stop = min(base + SEGMENT, n - length + 1)
            at = np.arange(base, stop + window - 1)
            keys = hashing.range_hash(pre, at, at + gram)
            keys = (keys & ~PLACE) | (PLACE - (at - base).astype(np.uint64))
            least = sliding_min(keys, window)
            starts = np.flatnonzero(limit[base:stop] >= np.arange(base, stop))
            if not len(starts):
                continue
            anchor = (PLACE - (least[starts] & PLACE)).astype(np.int64) + base
            starts = starts + base
            fresh = np.ones(len(starts), dtype=bool)
            fresh[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
            first = np.flatnonzero(fresh)
            lo, hi = starts[first], starts[np.append(first[1:], len(starts)) - 1]
            p = anchor[first]
            context = hashing.mix(hashing.range_hash(pre, lo, hi + length) + (p - lo).astype(np.uint64))
            out.append((np.searchsorted(offsets, lo, side="right") - 1, lo, hi, hashing.range_hash(pre, p, p + gram), context))
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _units(data: np.ndarray, offsets: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """What strings are made of, bytes or the hashes of words, and where each text's begin."""
    if not words:
        return data, offsets
    hashes, _, _, first = hashing.words(data, offsets, lower=False)
    return hashes, first


def _runs(length: int, gram: int, words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = hashing.buffers(batch.column("text"))
            for a, b in hashing.chunks(offsets):
                units, part = _units(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                text, lo, hi, h, context = anchor_runs(units, part, length, gram)
                own = pa.array(text + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(own), batch.column("k").take(own), pa.array((lo - part[text]).astype(np.int32)), pa.array((hi - part[text]).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(context.view(np.int64))],
                    names=["doc_id", "k", "lo", "hi", "h", "context"],
                )

    return run


def _cut_contexts(length: int, words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = hashing.buffers(batch.column("text"))
            wanted, keys = batch.column("wanted").to_pylist(), list(zip(batch.column("doc_id").to_pylist(), batch.column("k").to_pylist(), strict=True))
            rows: list[tuple] = []
            for a, b in hashing.chunks(offsets):
                units, at = _units(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                for i in range(a, b):
                    for w in wanted[i]:
                        piece = units[at[i - a] + w["lo"] : at[i - a] + w["hi"] + length].tobytes()
                        rows.append((*keys[i], w["lo"], w["h"], w["n"], w["kinds"], piece))
            for a in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows[a : a + 2000], strict=True), (batch.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                    names=["doc_id", "k", "lo", "h", "n", "kinds", "piece"],
                )

    return run


def _shard_matches(length: int, gram: int, keep_first: bool, words: bool):
    """Contexts, by anchor and shard and in order of position, to the strings that have a match in their shard."""

    window = length - gram + 1
    stride = min(STEP, max(1, length // 2))

    def work(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        sizes = np.array([len(r[6]) for r in rows], dtype=np.int64) // (8 if words else 1)
        # A symbol of its own after each context keeps strings from crossing.
        begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        symbols = np.zeros(int((sizes + 1).sum()), dtype=np.int64)
        data = np.frombuffer(b"".join(r[6] for r in rows), dtype=np.uint64 if words else np.uint8)
        inside = np.ones(len(symbols), dtype=bool)
        inside[begins + sizes] = False
        symbols[inside] = np.unique(data, return_inverse=True)[1] if words else data
        symbols[begins + sizes] = symbols.max() + 1 + np.arange(len(rows))
        counts = sizes - length + 1
        owner = np.repeat(np.arange(len(rows)), counts)
        place = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        starts = begins[owner] + place
        earlier, later = suffixes.factor_matches(symbols, length, starts)
        found = earlier if keep_first else earlier | later
        pre = hashing.prefix(data)
        flat_begin = begins - np.arange(len(rows))
        flat = flat_begin[owner] + place
        hashes = hashing.range_hash(pre, flat, flat + length).view(np.int64)
        cut = np.concatenate([[0], np.cumsum(counts)])
        spans, groups = [], []
        for i, (_, _, lo, _, n, kinds, *_) in enumerate(rows):
            own = found[cut[i] : cut[i + 1]]
            if n > 1 and not keep_first:
                own = np.ones(len(own), dtype=bool)
            edge = np.flatnonzero(np.diff(np.r_[False, own, False]))
            spans.append([{"a": lo + int(x), "b": lo + int(y) - 1 + length} for x, y in zip(edge[::2], edge[1::2], strict=True)])
            mine = []
            if kinds > SHARD:
                begin = int(flat_begin[i])
                grams = hashing.range_hash(pre, begin + np.arange(window), begin + np.arange(window) + gram) & ~PLACE
                anchor = window - 1 - int(grams[::-1].argmin())
                first = np.flatnonzero(~earlier[cut[i] : cut[i + 1]])
                step = (anchor - first) // stride
                for b in np.unique(step):
                    part = first[step == b]
                    # Starts anchor - stride * b - (0 .. stride - 1): what all of these strings hold.
                    left, right = begin + anchor - stride * b, begin + anchor - stride * (b + 1) + 1 + length
                    core = hashing.range_hash(pre, np.array([left]), np.array([right])).view(np.int64)[0]
                    mine.append({"core": int(core) ^ int(b), "at": (part + lo).tolist(), "windows": hashes[cut[i] + part].tolist(), "done": own[part].tolist()})
            groups.append(mine)
        span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        group = pa.list_(pa.struct([("core", pa.int64()), ("at", pa.list_(pa.int32())), ("windows", pa.list_(pa.int64())), ("done", pa.list_(pa.bool_()))]))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array(spans, span), pa.array(groups, group)],
            names=["doc_id", "k", "h", "spans", "groups"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last, kind = 0, None, pa.int64()
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for r in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "k", "lo", "h", "n", "kinds", "piece", "shard")], strict=True):
                if (r[3], r[7]) != last and size > BUFFER:
                    yield work(rows, kind)
                    rows, size = [], 0
                last = (r[3], r[7])
                rows.append(r)
                size += len(r[6])
        if rows:
            yield work(rows, kind)

    return run


def _covered(spans: list[dict] | None, n: int) -> np.ndarray:
    """Which of n places the spans (from a, before b) cover."""
    cover = np.zeros(n + 1, dtype=np.int32)
    np.add.at(cover, [x["a"] for x in spans or ()], 1)
    np.add.at(cover, [x["b"] for x in spans or ()], -1)
    return np.cumsum(cover[:-1]) > 0


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = hashing.buffers(batch.column("text"))
        sizes, removed, runs, digests, kept, passages = [], [], [], [], [], []
        for i, (spans, words) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("words").to_pylist(), strict=True)):
            own = data[offsets[i] : offsets[i + 1]]
            sizes.append(len(own))
            if not spans:
                rest, n, gone = own.tobytes(), 0, 0
            else:
                lost = _covered(spans, len(own))
                rest, gone = own[~lost].tobytes(), int(lost.sum())
                n = int((np.diff(np.r_[False, lost]) & lost).sum())
            removed.append(gone)
            runs.append(n)
            kept.append(rest)
            digests.append(hashlib.sha256(rest).hexdigest())
            passages.append(int(_covered(words, max(x["b"] for x in words)).sum()) if words else 0)
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())],
                *[pa.array(passages, pa.int64()), pa.array(kept, pa.binary())],
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "kept"],
        )


def repeated_spans(texts: DataFrame, length: int, gram: int, keep_first: bool, words: bool, stages: Stages) -> DataFrame:
    """(doc_id, k, spans) of the texts (doc_id, k, text) that hold a string of ``length`` bytes (or words) which comes again."""
    spark = texts.sparkSession
    kind = dict(texts.dtypes)["doc_id"]
    # So many words have a space less than twice as many bytes.
    long = F.octet_length("text") >= (2 * length - 1 if words else length)
    runs = texts.where(long).select("doc_id", "k", "text").mapInArrow(_runs(length, gram, words), f"doc_id {kind}, k long, lo int, hi int, h long, context long")
    runs = stages.save(runs, "runs")

    again_ = runs.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h")
    # A table of its own, so that a hot anchor's partition of the join can be split.
    again_ = stages.save(again_, "again")
    repeated = stages.save(runs.join(again_, "h"), "repeated")
    stages.drop(runs)
    kinds = repeated.groupBy("h", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "k", "lo", "hi")).alias("r"))
    kinds = stages.save(kinds.select("h", "context", "n", "r.*"), "kinds")

    # Equal contexts: every string of the run comes again.
    whole = repeated.join(kinds.where("n > 1").select("h", "context", F.struct("doc_id", "k", "lo").alias("first")), ["h", "context"])
    if keep_first:
        whole = whole.where(F.struct("doc_id", "k", "lo") != F.col("first"))
    whole = whole.select("doc_id", "k", F.col("lo").alias("a"), (F.col("hi") + length).alias("b"))

    # Anchors with several kinds of context.
    mixed = kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = kinds.join(mixed, "h").groupBy("doc_id", "k").agg(F.collect_list(F.struct("lo", "hi", "h", "n", "kinds")).alias("wanted"))
    t, w = texts.alias("t"), wanted.alias("w")
    same = F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.k") == F.col("w.k"))
    # Rows that repeat are met once: their context is one kind.
    cut = t.join(w, same).select("t.doc_id", "t.k", "t.text", "w.wanted").mapInArrow(_cut_contexts(length, words), f"doc_id {kind}, k long, lo int, h long, n long, kinds long, piece binary")
    shards = F.ceil(F.col("kinds") / SHARD).cast("long")
    cut = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "k", "lo"), shards))
    # By number, as suffix orders take long for their few bytes and small partitions would be put together.
    n_parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = cut.repartition(n_parts, "h", "shard").sortWithinPartitions("h", "shard", "doc_id", "k", "lo")
    matched = cut.select("doc_id", "k", "lo", "h", "n", "kinds", "piece", "shard").mapInArrow(
        _shard_matches(length, gram, keep_first, words), f"doc_id {kind}, k long, h long, spans array<struct<a:int,b:int>>, groups array<struct<core:long,at:array<int>,windows:array<long>,done:array<boolean>>>"
    )
    matched = stages.save(matched, "matched")
    inner = matched.select("doc_id", "k", F.explode("spans").alias("s")).select("doc_id", "k", "s.a", "s.b")

    # First strings of the shards of one anchor, across its shards.
    cores = matched.select("doc_id", "k", "h", F.explode("groups").alias("g")).select("doc_id", "k", "h", "g.*")
    again = cores.groupBy("h", "core").agg(F.count("*").alias("n")).where("n > 1").select("h", "core")
    firsts = cores.join(again, ["h", "core"]).select("doc_id", "k", "h", F.explode(F.arrays_zip("at", "windows", "done")).alias("x")).select("doc_id", "k", "h", "x.*")
    firsts = stages.save(firsts, "firsts")
    shared = firsts.groupBy("h", "windows").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "k", "at")).alias("first")).where("n > 1")
    across = firsts.where("not done").join(shared, ["h", "windows"])
    if keep_first:
        across = across.where(F.struct("doc_id", "k", "at") != F.col("first"))
    across = across.select("doc_id", "k", F.col("at").alias("a"), (F.col("at") + length).alias("b"))

    spans = whole.union(inner).union(across).groupBy("doc_id", "k").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    spans = stages.save(spans, "spans")
    stages.drop(again_, repeated, kinds, matched, firsts)
    return spans


def remove_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False, passages: int = PASSAGE, stages: Stages | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words, kept (the remaining bytes)."""
    stages = stages or Stages(documents.sparkSession, "suffixes")
    texts = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("k", F.xxhash64("doc_id", "text"))
    kind = dict(texts.dtypes)["doc_id"]
    gone = repeated_spans(texts, length, gram, keep_first, False, stages)
    again = repeated_spans(texts, passages, (passages + 1) // 2, keep_first, True, stages).withColumnRenamed("spans", "words")
    both = gone.withColumn("words", F.lit(None).cast(again.schema["words"].dataType)).unionByName(again.withColumn("spans", F.lit(None).cast(gone.schema["spans"].dataType)))
    # A text has one row on either side at most.
    both = both.groupBy("doc_id", "k").agg(F.first("spans", ignorenulls=True).alias("spans"), F.first("words", ignorenulls=True).alias("words"))
    t, g = texts.alias("t"), both.alias("g")
    out = t.join(g, F.col("t.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("t.k") == F.col("g.k")), "left")
    fields = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, kept binary"
    return out.select("t.doc_id", "t.text", "g.spans", "g.words").mapInArrow(_remove, fields)
