"""Merged sketches against exact figures, and against sketches of all rows."""

import random

from tessera.operators import summaries as s


def test_merged(spark):
    rng = random.Random(2)
    rows = []
    for k in range(1500):
        n = rng.randint(0, 40)
        rows.append((rng.choice(["a", "b", None]), k % 7, " ".join(f"w{rng.choice('xyz')}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(n)) if n else rng.choice([None, ""])))
    table = spark.createDataFrame(rows, "source string, day int, text string")
    parts = s.summarised(table, ["source", "day"]).cache()
    assert parts.count() == 21
    for by, pick in (([], lambda r: ()), (["source"], lambda r: (r[0],)), (["day"], lambda r: (r[1],))):
        got = {tuple(r[c] for c in by): r for r in s.figures(s.merged(parts, by), (0.25, 0.5, 0.99)).collect()}
        groups = {}
        for r in rows:
            groups.setdefault(pick(r), []).append(r[2] or "")
        assert got.keys() == groups.keys()
        for key, texts in groups.items():
            r = got[key]
            # digits part the words: w, and what follows
            words = [w for t in texts for w in t.split()]
            assert (r["n_texts"], r["n_words"], r["n_letters"]) == (len(texts), len(words), sum(map(len, texts)))
            assert abs(r["unique_words"] - len(set(words))) <= s.DISTINCT_ERROR * len(set(words)) + 1
            sizes = sorted(map(len, texts))
            for q in (0.25, 0.5, 0.99):
                v = r[f"length_{round(100 * q)}"]
                assert sum(x < v for x in sizes) / len(sizes) <= q + s.RANK_ERROR and sum(x <= v for x in sizes) / len(sizes) >= q - s.RANK_ERROR
    # parts merged in two steps are parts merged at once
    twice = s.figures(s.merged(s.merged(parts, ["source"]), [])).first()
    assert twice["unique_words"] == s.figures(s.merged(parts)).first()["unique_words"]
    assert s.figures(s.merged(s.summarised(table.limit(0), ["source"]), ["source"])).count() == 0
