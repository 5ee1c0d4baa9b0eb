"""The rules that recur in every job, each one Column expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
FIRST_TOXIC, SECOND_TOXIC = 0.7, 0.9
DEFAULT_LANGUAGES = ("pt", "en")
UNDETERMINED = "und"


def score(column: str | Column) -> Column:
    """A score with NaN as null, so that comparisons follow SQL's three-valued logic."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(c), c)


def agrees(languages: Sequence[str] | None = None, detected: str = "review_lang", declared: str = "perspective_declared_language") -> Column:
    """Agreement mask: the detected language is the declared one (and among ``languages``)."""
    same = F.col(detected) == F.col(declared)
    return same if languages is None else F.col(detected).isin(*languages) & same


def declared_or_undetermined(detected: str = "detected_language", declared: str = "declared_language") -> Column:
    return (F.col(detected) == F.col(declared)) | (F.col(detected) == UNDETERMINED)


def valid(first: str = "perspective_score", second: str = "detoxify_score") -> Column:
    """Validity mask: both scores in [0, 1]; a null or NaN score is not valid."""
    return F.coalesce(score(first).between(0, 1) & score(second).between(0, 1), F.lit(False))


def toxic(first: float = FIRST_TOXIC, second: float = SECOND_TOXIC, first_score: str = "perspective_score", second_score: str = "detoxify_score") -> Column:
    """Union toxicity of the two scores."""
    return (score(first_score) >= first) | (score(second_score) >= second)


def venn_region(first: float = FIRST_TOXIC, second: float = SECOND_TOXIC) -> Column:
    """perspective_only, detoxify_only or both; null outside of all three."""
    a, b = score("perspective_score") >= first, score("detoxify_score") >= second
    return F.when(a & b, "both").when(a & ~b, "perspective_only").when(b & ~a, "detoxify_only")


def in_venn_region(region: str) -> Column:
    if region not in ("perspective_only", "detoxify_only", "both"):
        raise ValueError(f"unknown region {region!r}: perspective_only, detoxify_only or both")
    return venn_region() == region


def contains_literal(column: str, part: str) -> Column:
    """Substring test without regard to case; ``part`` is no pattern."""
    return F.lower(F.col(column)).contains(part.lower())


def has_tag(tags: Column, part: str) -> Column:
    """Any tag holds ``part``, without regard to case."""
    return F.exists(tags, lambda t: F.lower(t).contains(part.lower()))


def ascii_art(text: Column, least_share: float = 0.5, least_chars: int = 20) -> Column:
    from spindrift.functions.text import art_chars

    n = art_chars(text)
    return (n / F.greatest(F.length(text), F.lit(1)) >= least_share) & (n >= least_chars)
