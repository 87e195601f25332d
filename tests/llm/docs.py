"""Small tables with the odd cases: nulls, blanks, long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row long, label int, token string, start long, id long, fp string, mark string, n int"


def table(spark, rows):
    """rows: (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), -1, -2, 9, "x", -3, -4, "y", "z", 0) for i, t, s in rows], SCHEMA)


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd(long=20_000):
    a, b = words(1, 120), words(2, 90)
    return [
        (1, a, "s1"), (2, a, "s2"), (3, a + " ", "s1"), (4, b, None), (4, b, None), (5, None, "s2"), (6, "", "s2"), (7, " \t\n", "s3"), (None, words(3, 60), "s1"), (None, a, None),
        (8, words(4, long), "s1"), (9, "One", "s4"), (10, "two words", "s4"), (11, a.upper(), "s1"), (12, b.replace("w1 ", "zz "), "s2"), (13, "naïve Ω €uro \U0001f600 end", "s3"),
    ]
