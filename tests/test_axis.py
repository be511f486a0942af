"""Range joins against all pairs, and disambiguation against the step by step version of one report."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import scan
from tessera.operators import axis


@pytest.mark.parametrize("fold", [False, True])
def test_meeting(spark, fold):
    rng = random.Random(5)

    def rows(n):
        out = []
        for i in range(n):
            lo = rng.choice([None, *(float(rng.choice([0, 10, 50, 99.5, 100, 499, 500, 560, 590])) for _ in range(9))])
            out.append((rng.randrange(3), i, lo, None if lo is None else lo + rng.choice([0, 1, 25, 60, 300])))
        return out

    a, b = rows(60), rows(50)
    schema = "k int, i int, lo double, hi double"
    got = axis.meeting(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"], fold)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    put = lambda x: x % 100 if fold and x >= 500 else x
    meets = lambda p, q: None not in (p[2], q[2]) and put(p[2]) < put(q[3]) and put(q[2]) < put(p[3]) and abs(put(p[2]) - put(q[2])) <= 100
    want = sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and meets(p, q))
    assert sorted((r["i"], r["b_i"]) for r in got.collect()) == want and want


def test_disambiguation(spark):
    """Random reports: what stays is what the version of one report at a time leaves."""
    rng = random.Random(8)
    ranges = {f"{r}>{o}>{p}": (x, x + rng.choice([10, 40, 90])) for r, x0 in (("胸部", 100), ("腹部", 180), ("盆腔", 230), ("上肢", 590), ("脊柱", 150)) for o in "ab" for p in "cd" for x in [x0 + rng.randrange(60)]}
    ranges |= {p.rsplit(">", 1)[0]: (lo, hi + 20) for p, (lo, hi) in list(ranges.items())}
    paths = sorted(ranges)
    ents, exams, want = [], [], {}
    for report in range(120):
        items = []
        for k in range(rng.randint(1, 5)):
            mine = sorted(rng.sample(paths, rng.choice([1, 1, 2, 3])))
            sentence = rng.choice(["片状影", "椎体旁", "见结节"])
            ents += [(report, 0, k, p, *map(float, ranges[p]), sentence) for p in mine]
            items.append(scan.Entity("x", k, k + 1, [tuple(p.split(">")) for p in mine], [ranges[p] for p in mine], sentence=sentence))
        exam = [rng.choice(paths) for _ in range(rng.randint(0, 2))]
        exams += [(report, *map(float, ranges[p])) for p in exam]
        shown = [scan.Entity("e", 0, 1, [tuple(p.split(">"))], [ranges[p]]) for p in exam]
        for k, e in enumerate(items):
            left = scan.disambiguate(e, [x for x in items if x is not e], shown)
            want[report, k] = {(">".join(p), len(e.paths), len(left.paths)) for p in left.paths}
    e = spark.createDataFrame(ents, "report_id int, sentence_index int, start int, path string, lo double, hi double, sentence string").withColumn("n_before_", F.lit(1))
    out = axis.disambiguated(e, spark.createDataFrame(exams, "report_id int, lo double, hi double"), at=("sentence_index", "start"))
    got = {}
    for r in out.collect():
        got.setdefault((r["report_id"], r["start"]), set()).add((r["path"], r["n_before"], r["n_after"]))
    assert got == want


@pytest.mark.parametrize(
    ("pattern", "want"),
    [("ab|cd", {"ab", "cd"}), ("ab.*cde", {"cde"}), ("(ab|c)[^x]*de", {"de"}), ("a?bcd", {"bcd"}), ("[ab]", None), ("a*", None), ("(?i)ab", None), ("(abc)+d", {"abc"}), ("x|[ab]", None), ("(?:ab)?c", {"c"}), ("结节|肿块", {"结节", "肿块"})],
)
def test_required_literals(pattern, want):
    from tessera.operators.checks import required

    assert required(pattern) == want


def test_rule_hits(spark):
    """Literals, parts and patterns against trying every rule."""
    import re

    from tessera.operators.checks import rule_hits

    sentences = [("肺结节增大", "胸部>肺"), ("肝囊肿", "腹部>肝"), ("肺结节增大", "胸部"), ("x1y", "胸部>肺"), ("", "胸部")]
    rules = [(1, "结节|囊肿", "肺"), (2, "结节.*大", "胸部"), (3, "[0-9]", "肺"), (4, "囊肿", "肺"), (5, "(?i)X", "胸部"), (6, "大$", "肺"), (7, "^$", "胸部")]
    got = rule_hits(spark.createDataFrame(sentences, "sentence string, path string"), spark.createDataFrame(rules, "rule int, pattern string, part string")).collect()
    want = {(s, p, r) for s, path in sentences for p in path.split(">") for r, pattern, part in rules if part == p and re.search(pattern, s)}
    assert sorted((r["sentence"], r["part"], r["rule"]) for r in got) == sorted(want)
