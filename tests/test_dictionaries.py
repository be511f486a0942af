"""Dictionaries read from files: the package's own, written out and read again, and odd ones."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera import dictionaries as di
from tessera import fixtures as fx
from tessera.config import LEXICON
from tessera.functions import scan
from tessera.operators import checks
from tessera.operators import entities as en
from tessera.sources.reports import synthetic_reports

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sheets(tmp_path_factory):
    """The package's dictionaries as sheets of delimited text."""
    d = tmp_path_factory.mktemp("sheets")
    names = {p: "|".join(x for x in (p.split(">")[-1], s) if x) for p, s, *_ in fx.KG}
    own = {p: (lo, hi) for p, _, lo, hi in fx.KG}
    lines = ["一级部位,二级部位,三级部位,四级部位,五级部位,六级部位,起始坐标,终止坐标"]
    for path in own:
        nodes = path.split(">")
        cells = [names[">".join(nodes[: k + 1])] for k in range(len(nodes))]
        lines.append(",".join([*cells, *[""] * (6 - len(cells)), *map(str, own[path])]))
    (d / "kg.csv").write_text("\n".join(lines) + "\n", "utf-8")
    kind = {"length": "长度", "percent": "百分比", "volume": "体积"}
    (d / "normal.csv").write_text("关键词,属性,最小值,最大值\n" + "".join(f"{k},{kind[p]},{a},{b}\n" for k, p, a, b in fx.NORMAL_MEASURE) + "坏,长度,x,1\n", "utf-8")
    (d / "critical.csv").write_text("序号,设备,结论,部位,描述值,描述,类别\n" + "".join(f"{n},{m},{c},{p},{v or ''},{t},{k}\n" for n, m, c, p, v, t, k in fx.CRITICAL), "utf-8")
    (d / "rules.csv").write_text("原始值,替换值,IsRegex,modality\n上肺,肺上叶,,\n约(\\d),$1,1,\n心影,心脏,,DX\n很长的规则名,短,,DX\n", "utf-8")
    (d / "words.ini").write_text("[a]\nmale = 前列腺|精囊\n[measure]\nmm_max=20\nunknown=1\n", "utf-8")
    return d


def test_the_packages_own_from_files(spark, sheets):
    got = di.load(spark, f"{sheets}/kg.csv", f"{sheets}/normal.csv", f"{sheets}/critical.csv", ini=f"{sheets}/words.ini")
    assert set(got.kg) == set(di.DEFAULT.kg)
    assert sorted(got.normal) == sorted(fx.NORMAL_MEASURE) and sorted(got.critical) == sorted(fx.CRITICAL)
    assert got.lexicon.male == "前列腺|精囊" and got.lexicon.mm_max == 20.0 and got.lexicon.female == LEXICON.female
    reports = synthetic_reports(spark, SF)
    rows = lambda d: sorted(map(repr, en.entities(reports, dicts=d).collect()))
    assert rows(got) == rows(di.DEFAULT)
    report = lambda d: sorted(map(repr, checks.part_missing(reports, en.entities(reports, dicts=d), d).collect()))
    assert report(got) == report(di.DEFAULT)
    assert checks.measure_errors(reports, got.lexicon).count() > checks.measure_errors(reports).count()


def test_replacement_rules_by_modality(spark, sheets):
    of = lambda m: [r[1] for r in di.read_replace(spark, f"{sheets}/rules.csv", modality=m)]
    assert of("DR") == of("DX") == ["心影", "很长的规则名"]
    assert of("CT") == of("") == ["上肺", "约(\\d)"]
    text = spark.createDataFrame([("上肺约3cm",)], "t string")
    assert text.select(di.cleaned(text["t"], di.read_replace(spark, f"{sheets}/rules.csv"))).first()[0] == "肺上叶3cm"
    assert di.ordered_rules([("ab", "", True), ("abcde", "", False), ("xy", "", False)])[0] == (0, "xy", "", False)


def test_saved_and_restored(spark, sheets, tmp_path):
    got = di.load(spark, f"{sheets}/kg.csv")
    di.save(got, spark, str(tmp_path / "d"))
    back = di.restore(spark, str(tmp_path / "d"))
    assert set(back.kg) == set(got.kg) and set(back.critical) == set(got.critical) and set(back.replace) == set(got.replace)


def test_odd_files(spark, tmp_path):
    (tmp_path / "e.env").write_text("# note\nA=1\nexport B = 'two'\n\nbroken\n", "utf-8")
    assert di.read_env(str(tmp_path / "e.env")) == {"A": "1", "B": "two"}
    (tmp_path / "bad.ini").write_text("[x]\nmale=(\n", "utf-8")
    with pytest.raises(ValueError):
        di.read_lexicon_ini(str(tmp_path / "bad.ini"))
    (tmp_path / "kg.csv").write_text("一级部位,二级部位,起始坐标,终止坐标\n甲|乙,丙,1,2\n甲|乙,丁,5,9\n,,1,1\n", "utf-8")
    got = {r[:5]: r[4:] for r in di.read_kg(spark, str(tmp_path / "kg.csv"))}
    assert {(r[0], r[2], r[4], r[5]) for r in di.read_kg(spark, str(tmp_path / "kg.csv"))} == {("甲", "甲", 1.0, 9.0), ("乙", "甲", 1.0, 9.0), ("丙", "甲>丙", 1.0, 2.0), ("丁", "甲>丁", 5.0, 9.0)}
    assert len(got) == 4 and di.valid_pattern("a|b") and not di.valid_pattern("(")


def test_too_large(spark, monkeypatch, sheets):
    monkeypatch.setattr(di, "MOST", 3)
    with pytest.raises(ValueError):
        di.read_kg(spark, f"{sheets}/kg.csv")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab肺.", min_size=1, max_size=4), max_size=7), st.text("ab肺.", max_size=24))
def test_names_are_those_of_the_trie(keys, text):
    trie = scan.KeywordTrie({k: k for k in keys})
    assert [(n, s, s + len(n)) for n, s in di.Names(keys).spans(text)] == trie.spans(text)


def test_repeated_names_have_their_own_places(spark):
    text = "左肺见结节，右肺见结节，肺门清晰。"
    r = spark.createDataFrame([(1, "CT", "胸部平扫", "男", "", text, "")], "report_id long, modality string, StudyPart string, Sex string, applyTable string, ReportStr string, ConclusionStr string")
    got = [(x["start"], x["orientation"]) for x in en.entities(r).orderBy("start").collect()]
    assert got == [(1, "左"), (7, "右"), (12, "右")]


def test_thousands_of_names(spark):
    """Five thousand names give what forty give, on the same texts."""
    rng = random.Random(1)
    more = [("".join(rng.choice("甲乙丙丁戊己庚辛壬癸") for _ in range(rng.randint(4, 8))), "x", "头部>x", 2, 0.0, 1.0) for _ in range(5000)]
    many = di.Dictionaries(kg=(*di.DEFAULT.kg, *more))
    reports = synthetic_reports(spark, SF)
    count = lambda d: en.entities(reports, dicts=d).groupBy("keyword").count().collect()
    assert sorted(map(tuple, count(many))) == sorted(map(tuple, count(di.DEFAULT)))


def test_thresholds_by_precedence(tmp_path):
    (tmp_path / "t.md").write_text('# run\n\nbest={"accept": 0.2, "reject": -0.3, "other": 1, "least": "x"}\n', "utf-8")
    base = {"accept": 0.15, "reject": -0.2, "least": 5}
    assert di.thresholds(base) == base
    assert di.thresholds(base, str(tmp_path / "t.md")) == {"accept": 0.2, "reject": -0.3, "least": 5}
    assert di.thresholds(base, str(tmp_path / "t.md"), {"TESSERA_ACCEPT": "0.4", "TESSERA_LEAST": "many"}) == {"accept": 0.4, "reject": -0.3, "least": 5}
    (tmp_path / "bad.md").write_text("best={oops}", "utf-8")
    assert di.thresholds(base, str(tmp_path / "bad.md")) == base


def test_segmenter_words_and_special_exams(spark, tmp_path):
    (tmp_path / "user.txt").write_text("骶髂关节 9 n\n肝\n", "utf-8")
    (tmp_path / "general.txt").write_text("甲乙 5000 n\n丙 9000 n\n丁戊 10 n\n己庚 2000 n\n辛壬 x n\n癸子 3000 n\n", "utf-8")
    words = di.read_segmenter(spark, str(tmp_path / "user.txt"), str(tmp_path / "general.txt"), most=2)
    assert words == ["骶髂关节", "己庚", "甲乙", "肝"]
    (tmp_path / "special.csv").write_text("一级项目,二级项目,三级项目\nCT,增强,增强|造影\n,,CTA\n,灌注,CBF\nMR,波谱,MRS\n", "utf-8")
    assert di.read_special(spark, str(tmp_path / "special.csv")) == {"CT": {"增强": ("增强", "造影", "CTA"), "灌注": ("CBF",)}, "MR": {"波谱": ("MRS",)}}


def test_learnt_tables_are_kept(spark, tmp_path):
    from tessera.operators import grammar

    freq = spark.createDataFrame([("结节", 5)], "word string, freq long")
    grammar.save({"freq": freq}, str(tmp_path / "l"))
    assert grammar.restore(spark, str(tmp_path / "l"), ("freq",))["freq"].collect() == freq.collect()
