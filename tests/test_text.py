import pytest
from pyspark.sql import functions as F

from spindrift.functions import masks, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Visit HTTP://x.y now, www.a.b!", "Visit HTTP x y now"),
        ("see http://x.y?q=1 www.a.b end", "see end"),
        ("ANÁLISE DE ACESSO ANTECIPADO bom jogo", "bom jogo"),
        ("Produto recebido de graça ok", "ok"),
        ("a b  c_d 12 e", "a b c d e"),
        (None, ""),
        ("produto reembolsado", ""),
    ],
)
def test_clean_for_detection(spark, given, want):
    assert one(spark, given, text.clean_for_detection) == want


def test_detection_cuts_before_cleaning_and_gate_counts_spaces(spark):
    assert len(one(spark, "abc " * 1000, text.clean_for_detection)) == 1999
    for n, ok in ((19, False), (20, True), (21, True)):
        assert one(spark, "a" + " " * 0 + "b" * (n - 1), lambda c: text.long_enough(text.clean_for_detection(c))) is ok


def test_clean_for_scoring_keeps_inner_space_and_cuts_last(spark):
    assert one(spark, "  a  b produto reembolsado ", text.clean_for_scoring) == "a  b"
    assert len(one(spark, "produto reembolsado" + "x" * 2001, text.clean_for_scoring)) == 1200
    assert one(spark, None, text.clean_for_scoring) is None
    assert one(spark, " a  b  c ", text.clean_for_examples) == "a b c"


@pytest.mark.parametrize(("given", "want"), [("Ação ß ﬁm Ⅳ 9!", "acao fim iv"), ("été http://a.b c", "ete c"), ("https", "https"), (None, None), ("🙂", "")])
def test_clean_terms(spark, given, want):
    assert one(spark, given, text.clean_terms) == want


def test_url_variants(spark):
    assert one(spark, "httpfoo bar", lambda c: text.clean_terms(c, text.URL_WIDE)) == "bar"
    assert one(spark, "httpfoo bar", text.clean_terms) == "httpfoo bar"
    assert one(spark, "É https://a.b  Já", text.clean_light) == "É Já"


def test_art(spark):
    art = "⠿" * 12 + "█" * 6 + "🟨" * 2
    assert one(spark, art, text.art_chars) == 20
    assert one(spark, art, lambda c: masks.ascii_art(c)) is True
    assert one(spark, art[1:], lambda c: masks.ascii_art(c)) is False
    assert one(spark, "（。！）" * 10, text.art_chars) == 0
    assert one(spark, "", text.art_share) == 0


def test_bins_json_prompt_tokens(spark):
    assert one(spark, "[0.9, 1.0]", text.bin_floor) == 0.9
    with pytest.raises(Exception, match="no lower bound"):
        one(spark, "high", text.bin_floor)
    for answer in ('{"label":"x"}', 'Sure: {"label":"x"} done'):
        assert one(spark, answer, lambda c: text.json_object(c, "label string"))["label"] == "x"
    assert one(spark, " a b ", text.tokens) == ["a", "b"]
    assert one(spark, "lexicon_en.csv", text.file_language) == "en"
    got = one(spark, "x", lambda c: text.prompt(F.lit(12.5), F.array(F.lit("a"), F.lit("b")), F.array(F.lit("y" * 600))))
    assert "12.50%" in got and "a, b" in got and "1. " + "y" * 500 in got and "y" * 501 not in got
    assert [one(spark, n, lambda c: text.padded_length(c, 64), "int") for n in (1, 3, 64, 65)] == [1, 4, 64, 64]
    assert "the" in text.stop_words("en") and "steam" in text.stop_words("pt")


def test_masks(spark):
    rows = [(0.0, 0.0), (0.7, 0.0), (0.0, 0.9), (0.7, 0.9), (1.0001, 0.5), (-1.0, 0.5), (float("nan"), 0.95), (None, 0.1), (0.1, None)]
    df = spark.createDataFrame(rows, "perspective_score double, detoxify_score double").select(masks.valid().alias("v"), masks.toxic().alias("t"), masks.venn_region().alias("r"))
    got = [tuple(r) for r in df.collect()]
    assert [g[0] for g in got] == [True] * 4 + [False] * 5
    assert [g[1] for g in got] == [False, True, True, True, True, False, True, None, None]
    assert [g[2] for g in got][:4] == [None, "perspective_only", "detoxify_only", "both"]
    with pytest.raises(ValueError):
        masks.in_venn_region("none")
