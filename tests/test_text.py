"""Feature extraction: the reference's golden vectors and edge cases."""

import pytest
from pyspark.sql import functions as F

from tagstream.functions import text as TX
from tagstream.functions.porter import stem_terms
from tagstream.operators.aggregates import term_frequencies


def _tf(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "question_id long, body string")
    return {(r.question_id, r.term): r.freq for r in term_frequencies(df, "body", stem=True).collect()}


def test_golden_tokens(spark):
    got = _tf(spark, ["This is the First testing Document"])
    assert {t for (_, t) in got} == {"first", "document", "test"}
    assert sum(got.values()) == 3


def test_golden_frequencies(spark):
    got = _tf(spark, ["This is the First testing Document. The document is for testing purpose."])
    assert {t: n for (_, t), n in got.items()} == {"first": 1, "document": 2, "test": 2, "purpos": 1}


def test_two_documents_lower_no_stop(spark):
    got = _tf(spark, ["This is the First testing Document", "This is the Second testing Document"])
    terms = {t for (_, t) in got}
    assert all(t == t.lower() for t in terms)
    assert "testing" not in terms
    assert not terms & set(TX.ENGLISH_STOP_WORDS)
    assert {q for (q, _) in got} == {0, 1}


def test_empty_text_gives_no_tokens(spark):
    df = spark.createDataFrame([(0, "")], "question_id long, body string")
    assert df.select(F.size(TX.tokens("body"))).first()[0] == 0
    assert _tf(spark, [""]) == {}


def test_stop_words_keep_duplicates_and_order(spark):
    df = spark.createDataFrame([("b a b the c",)], "t string")
    assert df.select(TX.drop_stop(TX.tokens("t"))).first()[0] == ["b", "b", "c"]


VECTORS = [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"),
    ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"),
    ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
    ("relational", "relat"), ("valenci", "valenc"), ("digitizer", "digit"), ("vileli", "vile"),
    ("sensitiviti", "sensit"), ("triplicate", "triplic"), ("hopeful", "hope"), ("goodness", "good"),
    ("revival", "reviv"), ("allowance", "allow"), ("adoption", "adopt"), ("probate", "probat"),
    ("controll", "control"), ("roll", "roll"), ("purpose", "purpos"), ("testing", "test"),
]


@pytest.fixture(scope="module")
def stems(spark):
    """Stems of the vectors and of words whose y is now a vowel, now a consonant."""
    words = [w for w, _ in VECTORS] + ["yyying", "syzygy", "by", "ed", "sayyying", "toying", "été", "s", "ss", "ies", "eed", "ing", "agreement", "onion", "hissing", "fizzed"]
    return {r.term: r.stem for r in stem_terms(spark.createDataFrame([(w,) for w in words] + [(None,), ("cats",)], "term string")).collect()}


@pytest.mark.parametrize("word,expected", VECTORS)
def test_porter_vectors(stems, word, expected):
    assert stems[word] == expected


def test_porter_edges(stems):
    assert stems[None] is None and stems["by"] == "by" and stems["ed"] == "ed" and stems["ing"] == "ing" and stems["eed"] == "eed"
    assert stems["toying"] == "toi" and stems["hissing"] == "hiss" and stems["fizzed"] == "fizz" and stems["onion"] == "onion" and stems["agreement"] == "agreement"


def test_character_references(spark):
    text = "a &amp; b &#233;&#xE9;&#x1F600;&#0;&#xD800; &copy;&amp;lt; &nosuch; &nbsp;x&#160;y & z &CounterClockwiseContourIntegral;&NotEqualTilde;&"
    df = spark.createDataFrame([(text,), (None,), ("none",)], "t string")
    got = [r[0] for r in df.select(TX.decode_entities("t")).collect()]
    assert got == ["a & b éé\U0001f600\ufffd\ufffd ©&lt; &nosuch;  x y & z ∳≂̸&", None, "none"]


def test_html_text(spark):
    html = "<html><head><style>p{}</style><script>var x=1;</script></head><!-- c --><body><p>a &amp; b</p>\n<b>c</b></body></html>"
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(TX.html_text("h")).first()[0] == "a & b c"
