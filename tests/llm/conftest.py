import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, print long, pattern string, label double, `row` string, `a.b` int"


@pytest.fixture(scope="session")
def texts():
    """Some copies, near copies, shared passages, nulls, blanks, repeated rows, one long text."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    out = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "one two"), (None, "no id"), (None, None)]
    for i in range(5, 60):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(20, 120)))
        out.append((i, t if i % 5 else f"{t[:80]} {passage}\n{t[80:]}"))
    out += [(70 + k, out[12][1]) for k in range(6)]
    out += [(80 + k, out[14][1] + f" tail{k}") for k in range(6)]
    out += [out[20], out[20], (200, " ".join(rng.choice(words) for _ in range(30_000))), (201, "É à ﬁ 漢字 " * 30)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", None if i is None else f"s{i % 4}" if i % 11 else None, 0, 1, 2, "p", 0.5, "r", 3) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
