import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use themselves.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, component_id string, tile int, `a.b` string, lang_pred string, copies int"
WORDS = ("the of and to in is that river stone cloud window garden letter simple yellow morning travel under paper bridge quiet " "forest silver orange castle market number winter summer people").split()


@pytest.fixture
def docs(spark):
    """docs((1, "text", "en", "s", 4), ...): missing trailing columns are null."""

    def make(*values, parts=3):
        filled = [tuple(v) + (None,) * (5 - len(v)) for v in values]
        return spark.createDataFrame(filled, DOCS).repartition(parts)

    return make


@pytest.fixture
def messy(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    long_text = " ".join(random.Random(3).choice(WORDS) for _ in range(30_000))
    base = [
        (1, "The river and the stone, the cloud of the garden.", "en", "a", 10),
        (1, "The river and the stone, the cloud of the garden.", "en", "a", 10),
        (2, "", "en", "a", 0),
        (3, None, None, None, None),
        (4, " \t\n\r\x0b\x0c ", "de", "b", 6),
        (None, "a row without an id in the table", "en", "b", 3),
        (None, None, None, None, None),
        (5, long_text, "en", "a", len(long_text)),
        (6, long_text, "en", None, len(long_text)),
        (7, "!!! ??? 123", "fr", "b", 11),
        (8, "ünïcödé wörds für ßen Øre\u00a0x ﬁne e\u0301 <|endoftext|> ©x x© 😀", "de", "c", 5),
        (9, "x" * 50_000, "en", "c", 50_000),
        (-7, "one", "en", "c", 3),
    ]
    return spark.createDataFrame([r + (0.5, 3, "x", 1, "y", "zz", 9) for r in base], CLASHING).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


def prose(seed, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 4))) for _ in range(words))
