"""Secret scan with corpus-wide ownership frequency.

DataFrame operations only.  Three base kinds are matched in whole texts, leftmost and without
overlap; positions come from the lengths of the pieces between matches.  Wider candidates (long
mixed tokens) are judged by how widely their value is owned: candidate hashes are aggregated by
distinct repositories (documents) and owners (sources).  A value that many owners or many
documents hold is a copied example; one that few hold and that looks random is a live credential,
and its spans are added.  The base spans are always kept.

Edge cases: null text is empty (no spans, the digest of the empty string); a null source counts
as one owner; rows that repeat are scanned one by one and share their owner; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.sources.stage import Stages

# The patterns of the base kinds, in the order in which they are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Wider candidates: runs of token characters; they must hold a digit and a letter.
WIDE = r"[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "owner")
#: Values held by more owners than this are copied examples.
EXAMPLE_OWNERS = 2
#: Values in more distinct documents than this are copied examples, whoever owns them.
EXAMPLE_REPOSITORIES = 8
#: Distinct characters that a random-looking value has at least.
DISTINCT_CHARS = 8

SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def spans_of(text: Column, pattern: str, kind: int, value_group: int = 0, least: int = 0) -> Column:
    """Array of (start, kind, end, value), by start; matches whose value is under ``least`` characters are dropped.

    Splitting by the pattern gives the pieces around the matches, so a running sum of lengths
    gives each match's place in code points.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["piece"])
        end = begin + F.length(pair["hit"])
        value = F.regexp_extract(pair["hit"], pattern, value_group) if value_group else pair["hit"]
        one = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value")))
        kept = F.when(pair["hit"].isNotNull() & (F.length(value) >= least), F.concat(acc["out"], one.cast(SPANS))).otherwise(acc["out"])
        return F.struct(F.coalesce(end, begin).alias("at"), kept.alias("out"))

    pairs = F.arrays_zip(pieces.alias("piece"), found.alias("hit"))
    every = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), every).otherwise(F.array().cast(SPANS))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _random_looking(value: Column) -> Column:
    chars = F.size(F.array_distinct(F.split(value, "")))
    return (chars >= DISTINCT_CHARS) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, repositories, owners): distinct documents and distinct sources that hold a value."""
    once = candidates.groupBy("hash", "owner", "doc_id").agg(F.lit(1).alias("one"))
    per = once.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return per.groupBy("hash").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))


def scan_secrets(documents: DataFrame, keep: tuple[str, ...] = (), stages: Stages | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base (array of spans), spans (all, by start), n_live, then ``keep``.

    ``n_live`` counts those of ``spans`` whose value few owners and few documents hold.
    """
    if clash := {"doc_id", "n_assign", "n_access", "n_hex", "base", "spans", "n_live"} & set(keep):
        raise ValueError(f"keep names output columns: {sorted(clash)}")
    stages = stages or Stages(documents.sparkSession, "secrets")
    text = F.coalesce(F.col("text"), F.lit(""))
    wide = F.filter(spans_of(F.col("t"), WIDE, 3), lambda s: _random_looking(s["value"]))
    found = (
        documents.select("doc_id", "source", text.alias("t"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])
        .withColumn("assign", spans_of(F.col("t"), ASSIGN, 0, value_group=2, least=6))
        .withColumn("access", spans_of(F.col("t"), ACCESS, 1))
        .withColumn("hexes", spans_of(F.col("t"), HEX, 2))
        .withColumn("wide", wide)
        .select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("owner"), "assign", "access", "hexes", "wide", *[f"keep_{i}" for i in range(len(keep))])
        .withColumn("row", F.monotonically_increasing_id())
    )
    found = stages.save(found, "found")

    # Spans with a value: what may be judged by ownership; the base ones keep their place whatever the verdict.
    every = found.where("size(assign) + size(access) + size(hexes) + size(wide) > 0").select("row", "doc_id", "owner", F.explode(F.concat("assign", "access", "hexes", "wide")).alias("s"))
    every = every.select("row", "doc_id", "owner", "s", F.xxhash64("s.value").alias("hash"))
    # A table of its own, so that a frequent value's partition of the join can be split.
    owned = stages.save(ownership(every.select("hash", "owner", "doc_id")), "owned")
    judged = every.join(owned, "hash").withColumn("live", (F.col("owners") <= EXAMPLE_OWNERS) & (F.col("repositories") <= EXAMPLE_REPOSITORIES))
    judged = judged.groupBy("row").agg(
        F.count_if(F.col("live") & (F.col("s.kind") < 3)).alias("n_live"), F.collect_list(F.when(F.col("live") & (F.col("s.kind") == 3), F.col("s"))).alias("added")
    )

    out = found.alias("f").join(judged.alias("j"), F.col("f.row") == F.col("j.row"), "left")
    base = F.concat("f.assign", "f.access", "f.hexes")
    added = F.coalesce(F.col("j.added"), F.array().cast(SPANS))
    # A wide candidate inside a base span tells nothing new.
    fresh = F.filter(added, lambda a: ~F.exists(base, lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])))
    return out.select(
        "f.doc_id",
        F.size("f.assign").cast("long").alias("n_assign"),
        F.size("f.access").cast("long").alias("n_access"),
        F.size("f.hexes").cast("long").alias("n_hex"),
        base.alias("base"),
        F.array_sort(F.concat(base, fresh)).alias("spans"),
        (F.coalesce(F.col("j.n_live"), F.lit(0)) + F.size(fresh)).cast("long").alias("n_live"),
        *[F.col(f"f.keep_{i}").alias(c) for i, c in enumerate(keep)],
    )


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span of ``spans`` (by start) replaced; overlapping spans give one mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], before, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, step)
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)
