"""Kept answers: nothing is asked twice, and a failed run leaves nothing."""

import os

import pandas as pd
import pytest

from tessera.operators import verdicts as v


def asker(folder, broken=False):
    """A model that notes what it was asked; it can't judge phrases with a question mark, and fails on "bad" if broken."""
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        for p in pdf["phrase"]:
            if broken and p == "bad":
                raise RuntimeError("no answer")
            with open(os.path.join(folder, "asked"), "a", encoding="utf-8") as out:
                out.write(p + "\n")
        ok = [None if "?" in p else len(p) % 2 == 0 for p in pdf["phrase"]]
        return pd.DataFrame({"phrase": pdf["phrase"], "is_valid": pd.array(ok, "boolean"), "confidence": [0.5] * len(ok), "reason": ["r"] * len(ok)})

    return f


def asked(folder):
    path = os.path.join(folder, "asked")
    got = sorted(open(path, encoding="utf-8").read().splitlines()) if os.path.exists(path) else []
    if got:
        os.remove(path)
    return got


def test_nothing_is_asked_twice(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(v, "CALL", 2)
    store = v.Store(spark, str(tmp_path / "kept"))
    rows = spark.createDataFrame([(1, "ab"), (2, "abc"), (3, "ab"), (4, "why?"), (5, None)], "id int, phrase string")
    got = sorted(map(tuple, v.told(rows, store, asker(tmp_path), "m", "1").collect()), key=lambda r: r[0])
    assert [(r[0], r[2]) for r in got] == [(1, True), (2, False), (3, True), (4, None), (5, True)]
    assert asked(tmp_path) == ["", "ab", "abc", "why?"]
    more = rows.unionByName(spark.createDataFrame([(6, "new")], "id int, phrase string"))
    again = v.told(more, store, asker(tmp_path), "m", "1").collect()
    assert asked(tmp_path) == ["new", "why?"] and len(again) == 6
    v.told(rows, store, asker(tmp_path), "m", "2").collect()
    assert asked(tmp_path) == ["", "ab", "abc", "why?"]
    before = sorted(map(tuple, store.answers().collect()))
    store.compact()
    assert len(store._runs()) == 1 and sorted(map(tuple, store.answers().collect())) == before


def test_a_failed_run_leaves_nothing(spark, tmp_path):
    store = v.Store(spark, str(tmp_path / "kept"))
    rows = spark.createDataFrame([("ab",), ("bad",), ("c",)], "phrase string").repartition(3)
    with pytest.raises(Exception, match="no answer"):
        v.told(rows, store, asker(tmp_path, broken=True), "m", "1")
    asked(tmp_path)
    assert store.answers().count() == 0
    v.told(rows, store, asker(tmp_path), "m", "1")
    assert asked(tmp_path) == ["ab", "bad", "c"] and store.answers().count() == 3


def test_two_answers_to_one_question(spark, tmp_path):
    """Runs at the same time may both ask; the earlier answer holds for all readers."""
    store = v.Store(spark, str(tmp_path / "kept"))
    answer = lambda ok: spark.createDataFrame([("k", ok, 0.5, "r"), ("n", None, None, "no")], "key string, is_valid boolean, confidence double, reason string")
    store.add(answer(True))
    store.add(answer(False))
    assert [tuple(r)[:2] for r in store.answers().collect()] == [("k", True)]
    store.compact()
    assert [tuple(r)[:2] for r in store.answers().collect()] == [("k", True)]
