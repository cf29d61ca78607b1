import pytest

#: Nulls, empty and blank texts, ties, repeated rows, long texts, odd characters.
TEXTS = [
    (0, "the cat sat on the mat and looked at the dog in the garden"),
    (1, "the cat sat on the mat and looked at the dog in the garden"),
    (2, None),
    (3, ""),
    (4, "   \n\t "),
    (5, "Don't 's  double  spaces\n\nand é ß 漢字 🎉 12½ <|endoftext|> end "),
    (6, "a" * 3000),
    (7, "word " * 4000),
    (8, "a shared line of some length\nown line number eight here\na shared line of some length"),
    (9, "A SHARED LINE OF SOME LENGTH \nown line number nine"),
    (9, "A SHARED LINE OF SOME LENGTH \nown line number nine"),
    (None, "a shared line of some length"),
    (10, "short\nshort\nReleased under the MIT License.\nfoo"),
    (11, "éé éé éé éé éé\r\nLicensed under the Apache License, Version 2.0."),
]


@pytest.fixture
def docs(spark):
    """Rows with clashing extra columns."""
    rows = [(i, t, "en", f"src{n % 2}", len(t or ""), "x", n) for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _text string, _id int")


@pytest.fixture
def empty(docs):
    return docs.limit(0)


def make(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
