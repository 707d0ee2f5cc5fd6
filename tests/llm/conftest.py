import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, kept_text string, fp string, runs string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names clash; doc_ids are unique but for the end."""
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "Epsilon", "zeta,", "eta.", "thêta", "ñandú", "mu"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = say(60)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, base), (5, base), (6, base + " omega"), (7, base.upper()), (8, "\n".join([say(12)] * 5 + [say(9)])), (9, "one"), (10, "two words"), (11, say(20000))]
    rows += [(i, say(30) + "\nshared line of text\n" + say(5) + "\n\n  SHARED line of text \n") for i in range(12, 40)]
    rows += [(40, "€" * 30 + "\n" + "x" * 9 + "\n" + "x" * 10), (41, "x" * 9 + "\n" + "X" * 10 + "\n"), (42, "a\r\nb"), (43, " odd\x1c\x85space ")]
    rows += [(None, "no id at all, but some text"), (None, None)]
    return spark.createDataFrame([(i, t, None if i == 5 else "en", "s", None, "x", "y", "z", "w") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
