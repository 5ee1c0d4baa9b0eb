"""Text normalisation: one cleaner with parameters, and the variants that the jobs use."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that a store adds to reviews, and the patterns around them.
BOILERPLATE = ("an[aá]lise de acesso antecipado", "produto recebido de gra[cç]a", "produto reembolsado")
BOILERPLATE_PATTERN = "(?iu)" + "|".join(BOILERPLATE)
URL_WIDE = r"http\S+|www\.\S+"
URL_STRICT = r"https?://\S+|www\.\S+"
# Box drawing, block elements, geometric shapes, Braille, arrows and squares, coloured squares.
ART_RANGES = ((0x2500, 0x257F), (0x2580, 0x259F), (0x25A0, 0x25FF), (0x2800, 0x28FF), (0x2B00, 0x2BFF), (0x1F780, 0x1F7FF))
ART_PATTERN = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ART_RANGES) + "]"
DETECT_CHARS, DETECT_LEAST, SCORE_CHARS, PREVIEW_CHARS, EXAMPLE_CHARS = 2000, 20, 1200, 80, 500
STOP_EXTRAS = {"en": ("game", "steam", "play", "playing", "games"), "pt": ("jogo", "game", "steam", "jogar", "pra", "jogos", "games")}
TOPIC_STOP_EXTRAS = {"en": ("game", "steam", "play", "playing", "games"), "pt": ("jogo", "jogar", "jogando", "jogos", "steam")}


def strip(text: Column) -> Column:
    """Without white space (of any script) at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def without_boilerplate(text: Column) -> Column:
    """Texts that hold no phrase's fixed part (letters that have one lower case only) skip the pattern."""
    low = F.lower(text)
    return F.when(low.contains("antec") | low.contains("produto"), F.regexp_replace(text, BOILERPLATE_PATTERN, " ")).otherwise(text)


def without_urls(text: Column, url: str) -> Column:
    """``url`` is one of the two patterns above; texts without http or www. skip it."""
    return F.when(text.contains("http") | text.contains("www."), F.regexp_replace(text, "(?U)" + url, " ")).otherwise(text)


def _fold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def fold_ascii(text: Column) -> Column:
    """Compatibility decomposition, then whatever is not ASCII goes; plain texts stay in the JVM."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.pandas_udf(_fold, "string")(text)).otherwise(text)


def clean_for_detection(text: Column) -> Column:
    """Cut to the detector's length, then letters only: no URLs, boilerplate, punctuation, digits or underscores."""
    out = F.coalesce(F.substring(text, 1, DETECT_CHARS), F.lit(""))
    return F.trim(F.regexp_replace(without_boilerplate(without_urls(out, URL_WIDE)), r"[[^\p{L}\p{N}][0-9]]+", " "))


def long_enough(cleaned: Column, least: int = DETECT_LEAST) -> Column:
    """The detection gate; spaces count."""
    return F.length(cleaned) >= least


def clean_for_scoring(text: Column) -> Column:
    """No boilerplate, stripped, cut to the scorers' length after that; inner white space stays."""
    return F.substring(strip(without_boilerplate(text)), 1, SCORE_CHARS)


def clean_for_examples(text: Column) -> Column:
    return strip(collapse(without_boilerplate(text)))


def clean_light(text: Column) -> Column:
    """For encoders: no URLs or boilerplate; case and accents stay."""
    return strip(collapse(without_boilerplate(without_urls(text, URL_STRICT))))


def clean_terms(text: Column, url: str = URL_STRICT) -> Column:
    """For topics and term weights: lower case, a-z only."""
    return F.trim(F.regexp_replace(fold_ascii(without_boilerplate(without_urls(F.lower(text), url))), "[^a-z]+", " "))


def art_chars(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(ART_PATTERN)), F.lit(0))


def art_share(text: Column) -> Column:
    return F.round(art_chars(text) / F.greatest(F.length(text), F.lit(1)), 4)


def preview(text: Column, n: int = PREVIEW_CHARS) -> Column:
    return F.substring(text, 1, n)


def tokens(text: Column) -> Column:
    """Split at white space; no token for an empty text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def bin_floor(label: Column) -> Column:
    """The lower bound in a label such as ``[0.9, 1.0)``; a label without one is an error."""
    found = F.regexp_extract(label, r"\[\s*([0-9.]+)\s*,", 1)
    return F.when(found != "", found.cast("double")).otherwise(F.raise_error(F.concat(F.lit("no lower bound in "), F.coalesce(label, F.lit("null")))).cast("double"))


def file_language(path: Column) -> Column:
    """The language tag that ends a file's stem: ``lexicon_en.csv`` gives en."""
    return F.regexp_extract(path, r"_([a-z]{2,3})\.[A-Za-z]+$", 1)


def json_object(answer: Column, schema: str) -> Column:
    """Parse a JSON object, whole or between the first { and the last } of a longer answer."""
    whole = F.from_json(F.trim(answer), schema)
    inner = F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), schema)
    return F.when(F.trim(answer).startswith("{") & F.trim(answer).endswith("}"), whole).otherwise(inner)


def prompt(share: Column, words: Column, examples: Column) -> Column:
    """A labelling prompt: share of reviews, keywords, numbered examples cut to 500 characters."""
    numbered = F.transform(examples, lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), F.substring(e, 1, EXAMPLE_CHARS)))
    return F.concat(F.format_string("Topic with %.2f%% of the reviews.\nKeywords: ", share), F.array_join(words, ", "), F.lit("\nExamples:\n"), F.array_join(numbered, "\n"))


def padded_length(n: Column, cap: int) -> Column:
    """The next power of two, at most ``cap``."""
    return F.least(F.lit(cap), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n, F.lit(1))))).cast("int"))


def stop_words(language: str, extras: dict[str, tuple[str, ...]] = STOP_EXTRAS) -> list[str]:
    """Spark ML's list for the language (not the same as other toolkits') and the domain's own, sorted."""
    from pyspark.ml.feature import StopWordsRemover

    names = {"en": "english", "pt": "portuguese", "fr": "french", "de": "german", "es": "spanish"}
    base = StopWordsRemover.loadDefaultStopWords(names[language]) if language in names else []
    return sorted({*base, *extras.get(language, ())})
