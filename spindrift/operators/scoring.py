"""Models behind vectorised functions: language identification, scorers, encoder, and the cache-aware plan around them.

The defaults are deterministic stand-ins that need no model files; they have the interface of the
real ones and no claim to their quality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import masks, text

BATCH = 32
FAILED = -1.0

# Frequent words by language, for the stand-in detector.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "was", "on", "this", "are", "be", "not"),
    "pt": ("de", "que", "não", "em", "um", "uma", "para", "com", "os", "por", "mais", "muito", "jogo", "você", "é", "bom"),
    "es": ("de", "que", "el", "la", "en", "los", "una", "por", "con", "para", "las", "del", "es", "muy", "pero", "y"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "une", "que", "est", "pour", "qui", "dans", "sur", "pas"),
    "de": ("der", "die", "und", "das", "in", "den", "ist", "von", "zu", "mit", "nicht", "ein", "eine", "auf", "für", "im"),
}


def common_word_detector(texts: pd.Series) -> pd.DataFrame:
    """(lang, confidence): the language whose frequent words are the largest share of the words."""
    names = sorted(COMMON)
    tongues: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        for w in set(COMMON[name]):
            tongues.setdefault(w, []).append(i)
    frequent, rows = tongues.__contains__, []
    for t in texts:
        words = t.lower().split()
        n = [0] * len(names)
        for w in filter(frequent, words):
            for i in tongues[w]:
                n[i] += 1
        most = max(n)
        rows.append((names[n.index(most)], most / len(words)) if most else (masks.UNDETERMINED, 0.0))
    return pd.DataFrame(rows, columns=["lang", "confidence"])


def detect_language(column: Column, detector: Callable[[pd.Series], pd.DataFrame] = common_word_detector, least: int = text.DETECT_LEAST) -> Column:
    """struct(lang, confidence) of a text; und and 0 below the length gate, on failure, and without a candidate."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for cleaned in batches:
            out = pd.DataFrame({"lang": masks.UNDETERMINED, "confidence": 0.0}, index=range(len(cleaned)))
            usable = np.flatnonzero(cleaned.fillna("").str.len().to_numpy() >= least)
            if len(usable):
                try:
                    got = detector(cleaned.iloc[usable])
                    out.loc[usable, ["lang", "confidence"]] = got[["lang", "confidence"]].to_numpy()
                except Exception:  # a failing model is an outcome here, not an error
                    pass
            yield out.astype({"confidence": "float64"})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "lang string, confidence double")(text.clean_for_detection(column))


def with_language(df: DataFrame, column: str = "review_text", **options) -> DataFrame:
    out = df.withColumn("_d", detect_language(F.col(column), **options))
    return out.withColumn("review_lang", F.col("_d.lang")).withColumn("detection_confidence", F.col("_d.confidence")).drop("_d")


def revalidate_language(df: DataFrame, declared: str = "perspective_declared_language", **options) -> DataFrame:
    """review_url, declared_language, detected_language, detection_confidence."""
    out = df.select("review_url", F.col(declared).alias("declared_language"), detect_language(F.col("review_text"), **options).alias("d"))
    return out.select("review_url", "declared_language", F.col("d.lang").alias("detected_language"), F.col("d.confidence").alias("detection_confidence"))


def hash_scorer(texts: Sequence[str]) -> list[float]:
    """Stand-in toxicity: a number in [0, 1] from the text."""
    import zlib

    return [(zlib.crc32(t.encode()) % 10_000) / 9_999.0 for t in texts]


def star_scorer(texts: Sequence[str]) -> list[float]:
    """Stand-in sentiment: expected stars over a softmax of five numbers from the text."""
    import zlib

    out = []
    for t in texts:
        logits = np.array([(zlib.crc32(f"{i}{t}".encode()) % 1000) / 250.0 for i in range(5)])
        p = np.exp(logits - logits.max())
        out.append(float((p / p.sum()) @ np.arange(1, 6)))
    return out


def score_texts(column: Column, scorer: Callable[[Sequence[str]], Sequence[float]], batch: int = BATCH) -> Column:
    """Scores in batches; every row of a failing batch gets -1; null texts stay null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = np.full(len(texts), np.nan)
            at = np.flatnonzero(texts.notna().to_numpy())
            for a in range(0, len(at), batch):
                part = at[a : a + batch]
                try:
                    out[part] = list(scorer(texts.iloc[part].tolist()))
                except Exception:  # a failing batch is an outcome here, not an error
                    out[part] = FAILED
            yield pd.Series(out).astype("Float64").where(texts.notna().reset_index(drop=True), None)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(column)


def split_by_cache(df: DataFrame, cache: DataFrame | None, column: str, key: str = "review_url", exclude: str | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(rows with their cached score, rows to be scored).  Rows whose text matches ``exclude`` are scored anew."""
    if cache is None:
        return None, df
    usable = F.lit(True) if exclude is None else ~F.coalesce(F.col("review_text").rlike(f"(?iu){exclude}"), F.lit(False))
    known = cache.select(key, column).where(F.col(column).isNotNull()).groupBy(key).agg(F.first(column).alias(column))
    hits = df.where(usable).join(known, key)
    return hits, df.join(hits.select(key), key, "left_anti")


def score_reviews(df: DataFrame, languages: Sequence[str], column: str, scorer: Callable[[Sequence[str]], Sequence[float]], cache: DataFrame | None = None, exclude: str | None = None) -> DataFrame:
    """Agreeing reviews with a score, from the cache where it has one: one plan, all columns kept."""
    rows = df.where(masks.agrees(languages)).drop(column)
    hits, misses = split_by_cache(rows, cache, column, exclude=exclude)
    fresh = misses.withColumn(column, score_texts(text.clean_for_scoring(F.col("review_text")), scorer))
    return fresh if hits is None else hits.select(*fresh.columns).unionByName(fresh)


def hash_encoder(size: int = 384) -> Callable[[Sequence[str]], np.ndarray]:
    """Stand-in encoder: signed hashed words, scaled to length 1."""

    def encode(texts: Sequence[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), size), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in t.split():
                h = zlib.crc32(w.encode())
                out[i, h % size] += 1.0 if h & 0x10000 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return encode


def encode_texts(column: Column, encoder: Callable[[Sequence[str]], np.ndarray] | None = None) -> Column:
    """array<float> of each text; null for null."""
    encoder = encoder or hash_encoder()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            at = np.flatnonzero(texts.notna().to_numpy())
            out: list[object] = [None] * len(texts)
            if len(at):
                for i, v in zip(at, encoder(texts.iloc[at].tolist()), strict=True):
                    out[i] = v.tolist()
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")(column)


# The labeller's categories.
TAXONOMY = ("generic_insult", "violence_threat", "sexual_content", "identity_hate", "nationality_xenophobia", "product_complaint", "humor_sarcasm", "copypasta_repetition", "other")
# The rule of the stand-in labeller, from the most to the least telling.
KEYWORDS = {
    "violence_threat": {"kill", "die", "shoot", "murder", "matar", "morrer"}, "nationality_xenophobia": {"chinese", "russian", "american", "foreigners", "chineses", "gringos"},
    "identity_hate": {"race", "religion", "gender", "racist", "raça"}, "sexual_content": {"sex", "porn", "nude", "sexo"}, "product_complaint": {"refund", "crash", "lag", "bug", "price", "devs", "update", "fps"},
    "humor_sarcasm": {"lol", "haha", "joke", "kkkk"}, "generic_insult": {"stupid", "trash", "idiot", "garbage", "lixo", "burro"},
}


def label_topics(topics: DataFrame, labeller: Callable[[str], str] | None = None) -> DataFrame:
    """topic, label, description, category, copypasta_suspected, copypasta_evidence.

    The outliers and topics without data have fixed answers, others the labeller's JSON or a rule:
    keywords give the category, and examples that repeat make a topic suspect of copypasta.
    """
    out = topics.withColumn("prompt", text.prompt(F.col("share"), F.col("words"), F.col("examples")))
    rule = F.lit("other")
    repeats = F.size("examples") - F.size(F.array_distinct("examples"))
    suspected = repeats * 2 >= F.greatest(F.size("examples"), F.lit(1))
    for name in reversed(list(KEYWORDS)):
        rule = F.when(F.arrays_overlap("words", F.array(*[F.lit(w) for w in sorted(KEYWORDS[name])])), name).otherwise(rule)
    label, category = F.array_join(F.slice("words", 1, 3), " "), F.when(suspected, "copypasta_repetition").otherwise(rule)
    description = F.concat(F.lit("Messages that share the words "), F.array_join(F.slice("words", 1, 5), ", "), F.lit("."))
    evidence = F.when(suspected, F.concat(repeats.cast("string"), F.lit(" of "), F.size("examples").cast("string"), F.lit(" examples repeat another")))
    if labeller is not None:

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for prompts in batches:
                yield prompts.map(lambda p: _quietly(labeller, p))

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        out = out.withColumn("a", text.json_object(F.pandas_udf(run, "string")(F.col("prompt")), "label string, description string, category string, copypasta_suspected boolean, copypasta_evidence string"))
        evidence = F.when(F.coalesce("a.copypasta_suspected", suspected), F.coalesce("a.copypasta_evidence", evidence))
        suspected = F.coalesce("a.copypasta_suspected", suspected)
        label, category = F.coalesce("a.label", label), F.when(F.col("a.category").isin(*TAXONOMY), F.col("a.category")).otherwise(category)
        description = F.coalesce("a.description", description)
    empty = F.size("words") == 0
    fixed = (F.col("topic") == -1) | empty
    label = F.when(F.col("topic") == -1, "outlier").when(empty, "no data").otherwise(label)
    return out.select(
        "topic",
        label.alias("label"),
        F.when(~fixed, description).alias("description"),
        F.when(fixed, "other").otherwise(category).alias("category"),
        (~fixed & suspected).alias("copypasta_suspected"),
        F.when(~fixed, evidence).alias("copypasta_evidence"),
    )


def _quietly(f: Callable[[str], str], x: str) -> str | None:
    try:
        return f(x)
    except Exception:  # a failing labeller falls back to the rule
        return None
