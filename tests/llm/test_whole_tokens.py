"""Personal-data features read whole tokens."""

from tagstream.llm import personal


def test_shape_and_word_before_are_whole():
    long = "http://x.org/" + "a/1" * 30
    assert personal._shape(long + "@b") != personal._shape(long + "+b") and personal._shape("ab12.c") == "a9.a"
    word = "w" * 40
    features = [personal.Document(f"{x}{word}  42", []).cols[6] for x in ("call", "mail")]
    assert features[0] != features[1]
    assert personal._word_before("a bcd \n 42", 8) == "bcd" and personal._word_before("42", 0) == ""
