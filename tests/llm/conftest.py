import pytest

AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog again and again.\nA second line of this text", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, "   \n\t\n  ", "de", "b"),
    (5, "The quick brown fox jumps over the lazy dog again and again.\nA second line of this text", "en", "a"),
    (6, "naïve Ünïcode 中文 🙂 text\r\nwith odd\x85 spaces ", "fr", "c"),
    (7, "word", "en", None),
    (8, "12345 67890 !!", "en", "b"),
    (9, "lorem ipsum dolor sit amet " * 4000, "en", "a"),
]


@pytest.fixture
def awkward(spark):
    """Nulls, empty and long texts, copies, repeated rows and columns whose names clash with results."""
    rows = [(*r, len(r[1] or ""), "clash", 0.5) for r in [*AWKWARD, AWKWARD[0]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, score double")


@pytest.fixture
def empty(awkward):
    return awkward.limit(0)
