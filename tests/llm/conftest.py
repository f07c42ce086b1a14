import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard int, slot string, epoch int, n int, key string, row string, h string"


def words(rng, n):
    return " ".join("".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 8))) for _ in range(n))


def hard_rows():
    """Nulls, empties, ties, copies, near copies, long texts and repeated rows."""
    rng = random.Random(3)
    long_text = "\n".join(words(rng, 200) for _ in range(40))
    near = words(rng, 120).split()
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three four"), (5, "one two three four"), (6, "ONE TWO three four"), (None, "no id here at all, friend"), (None, None), (7, long_text), (8, long_text), (9, long_text + "\nend")]
    rows += [(10, " ".join(near)), (11, " ".join(near[:-3] + ["x", "y", "z"])), (12, " ".join(["q"] * 3 + near[3:]))]
    rows += [(20 + i, words(rng, rng.randint(1, 150))) for i in range(40)] + [(80, "a " * 600), (81, "ba " * 700), (82, "é" * 500), (83, "\x00bell\x07 <|endoftext|> 日本語。"), (84, "a\r\nb c")]
    passage = words(rng, 90)
    rows += [(90 + i, f"{words(rng, 20)}\n{passage}\n{words(rng, 30)}") for i in range(6)]
    blanks = ["\u00a0", "\u3000", "\u0085", "\x1c", "\x1d", "\x1e\x1f", "\u2028"]
    rows += [(100 + i, f"{words(rng, 30)}\n{b}\n{words(rng, 30)}{b}\n{b} {b}") for i, b in enumerate(blanks)]
    return rows


@pytest.fixture(scope="session")
def hard(spark):
    rows = [(d, t, None if d == 2 else "en", None if d in (4, 5) else f"s{(d or 0) % 3}", None, "x", 1, "y", 2, 3, "k", "r", "h") for d, t in hard_rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark, hard):
    return hard.filter(F.lit(False))
