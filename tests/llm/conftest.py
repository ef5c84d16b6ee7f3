import datetime

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, overlap int, _row int, n_lines_removed int, sign binary, seen date"
EXTRA = ("x", 0.5, 7, 3, 9, b"z", datetime.date(2024, 1, 1))
EN = "The quick brown fox jumps over the lazy dog and then the fox runs far away from that old house near the river bank"
FR = "Le renard brun saute par dessus le chien paresseux et puis le renard court loin de cette vieille maison pres de la rive"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [
        (1, EN, "en", "a", 10),
        (1, EN, "en", "a", 10),
        (2, FR, "fr", "b", None),
        (3, None, "en", "a", 5),
        (4, "", "en", None, 0),
        (5, "   \n\t ", None, "c", 3),
        (6, (EN + ". ") * 3000, "en", "a", 1),
        (7, "漢字" * 2000 + " 😀 \x00 end", None, None, 2),
        (8, "a" * 5000, "en", "d", 5000),
        (None, FR + " extra", "fr", "b", 2),
        (None, None, None, None, None),
        (9, "12345 $$$ %%%", "en", "e", 4),
        (10, EN + " indeed", "en", "f", 6),
    ]
    return spark.createDataFrame([r + EXTRA for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false").coalesce(1)
