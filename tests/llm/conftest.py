from __future__ import annotations

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(n: int, seed: int = 0) -> str:
    return " ".join(WORDS[(i * i * 7 + i * (seed + 3) + seed) % len(WORDS)] + str((i * seed) % 11) for i in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and columns named like internal ones."""
    rows = [
        (1, prose(40, 1), "en", 1, "x", None),
        (2, prose(40, 1), None, 2, "y", 5),
        (3, None, "en", None, None, None),
        (4, "", "de", 4, "z", 1),
        (5, prose(30_000, 2), "en", 5, "long", 2),
        (6, prose(60, 3), "en", 6, "twice", 3),
        (6, prose(60, 3), "en", 6, "twice", 3),
        (None, prose(45, 4), "fr", 7, "no id", 4),
        (8, "Ünïcode 日本語 🙂 text\twith\x0bspaces\nand lines", "xx", 8, "w", 9),
        (9, "one", "en", 9, "short", 9),
        (10, " \n\t ", "en", 10, "blank", 9),
    ]
    schema = "doc_id long, text string, lang string, kept int, _row string, _id int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
