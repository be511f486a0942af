"""Sound distance and its candidates against all pairs."""

import itertools
import random

import pytest

from tessera.operators import grammar, sounds
from tessera.sources import reports

SYLLABLES = ["jie", "zhang", "zan", "zang", "shi", "si", "lin", "ling", "nin", "rin", "lian", "liang", "tun", "tong", "fu", "hu", "a", "an", "gong"]


def test_cost():
    assert sounds.cost("jie", "jie") == 0 and sounds.cost("zhang", "zan") == 0.5 and sounds.cost("lian", "niang") == 0.5
    assert sounds.cost("nin", "rin") == 1 and sounds.cost("nin", "lin") == 0.5 and sounds.cost("jie", "jia") == 1 and sounds.cost("tun", "tong") == 0.5
    assert sounds.distance(["zhang", "jie"], ["zan"]) == 1.5 and sounds.distance([], ["a", "b"]) == 2
    assert sounds.split("shuang") == ("sh", "uang") and sounds.split("an") == ("", "an")


@pytest.mark.parametrize("most", [0.5, 1.0, 2.0])
def test_pairs(spark, most):
    rng = random.Random(4)
    chars = {chr(0x4E00 + k): rng.choice(SYLLABLES) for k in range(40)}
    words = sorted({"".join(rng.choice(list(chars)) for _ in range(rng.randint(1, 4))) for _ in range(70)})
    table = spark.createDataFrame([*chars.items(), ("一", "zzz")], "char string, syllable string")
    said = sounds.sounded(spark.createDataFrame([(w,) for w in [*words, "一x", ""]], "word string"), table)
    got = {(r["word"], r["other"]): r["distance"] for r in sounds.alike(said, said, most).collect()}
    of = lambda w: [min(chars[c], "zzz") for c in w]
    want = {(a, b): d for a, b in itertools.permutations(words, 2) if (d := sounds.distance(of(a), of(b))) <= most}
    assert got == want and want


def test_confusions_of_read_tables(spark, tmp_path):
    """Pairs from a read table of sounds, and variants from a read table of homophones, against doing so word by word."""
    path = tmp_path / "same.txt"
    path.write_text("结\t节洁结\n影\t应 迎\n节\t结\n", "utf-8")
    pairs = reports.read_homophones(spark, str(path))
    table = [(r["char"], r["homophone"]) for r in pairs.collect()]
    words = ["结影", "影像", "无关"]
    got = {(r["word"], r["variant"]) for r in grammar.variants(spark.createDataFrame([(w,) for w in words], "word string"), homophones=pairs).collect()}
    one = {(w, w[:i] + h + w[i + 1 :]) for w in words for i, c in enumerate(w) for k, h in table if k == c}
    two = {(w, v[:j] + h + v[j + 1 :]) for w, v in one for j, c in enumerate(w) for k, h in table if k == c and v[j] == w[j]}
    assert got == {(w, v) for w, v in one | two if v != w}
    freq = spark.createDataFrame([("结节", 90), ("节洁", 2), ("结洁", 60), ("像", 1)], "word string, freq long")
    said = spark.createDataFrame([("结", "jie"), ("节", "jie"), ("洁", "jie"), ("像", "xiang")], "char string, syllable string")
    out = {(r["wrong"], r["correct"]): (r["w_freq"], r["c_freq"], r["distance"]) for r in sounds.sound_confusions(freq, said, 50).collect()}
    assert out == {("节洁", "结节"): (2, 90, 0.0), ("节洁", "结洁"): (2, 60, 0.0)}
