"""Order-dependent text logic on plain values."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera import fixtures as fx
from tessera.functions import scan


def brute(entries, text):
    low, out, at = text.lower(), [], 0
    while at < len(low):
        fits = [k for k in entries if low.startswith(k, at) and not (at and low[at - 1] == "_") and not (at + len(k) < len(low) and low[at + len(k)] == "_")]
        if fits:
            k = max(fits, key=len)
            out.append((k, at, at + len(k)))
            at += len(k)
        else:
            at += 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab_", min_size=1, max_size=4), max_size=6), st.text("ab_A", max_size=20))
def test_trie_is_leftmost_longest(keys, text):
    trie = scan.KeywordTrie({k: k for k in keys})
    assert [(v, a, b) for v, a, b in trie.spans(text)] == brute(set(keys), text)


def test_trie_maintenance():
    trie = scan.KeywordTrie({"肺": "肺", "肺上叶": "肺上叶"})
    assert len(trie) == 2 and "肺上叶" in trie and trie.get("肺") == "肺"
    assert trie.replaced("右肺上叶") == "右肺上叶"
    assert trie.remove("肺上叶") and not trie.remove("肺上叶")
    assert trie.spans("肺上叶") == [("肺", 0, 1)]
    trie.add("上肺", "肺上叶")
    assert trie.replaced("左上肺") == "左肺上叶"


def test_spans_point_at_keywords():
    for text in fx.DESCRIPTION:
        for e in scan.structure(text, scan.dictionary()):
            assert e.clause[e.start : e.end] == e.keyword


def test_two_organs_without_finding():
    es = scan.structure("肝脏、胆囊未见明显异常。", scan.dictionary())
    assert [e.keyword for e in es] == ["肝脏", "胆囊"] and all(e.positive == 0 for e in es)


def test_sides():
    assert scan.side_of("右肺上叶见结节", "肺上叶") == "右"
    assert scan.side_of("卵巢(左侧)见囊肿", "卵巢") == "左"
    assert scan.side_of("两肺纹理", "肺") == "双"
    assert scan.side_of("左侧子宫", "子宫") == ""


def test_sides_are_handed_on():
    def e(side):
        return scan.Entity("肾", 0, 1, [("腹部", "肾脏")], [(0.0, 1.0)], orientation=side)

    assert [x.orientation for x in scan.fill_sides([e(s) for s in ("", "左", "", "", "右", "")])] == ["左", "左", "左", "左", "右", "右"]


@pytest.mark.parametrize(
    ("before", "after"),
    [("L3-5", "腰3椎、腰4椎、腰5椎"), ("颈7/8", "颈7/胸1"), ("L5/S1", "腰5/骶1"), ("T3、4、5", "胸3、胸4、胸5"), ("第1-3肋", "第1肋、第2肋、第3肋"), ("CT平扫", "CT平扫")],
)
def test_expansion(before, after):
    assert scan.expand_parts(before) == after


def test_disambiguation_by_exam():
    trie = scan.dictionary()
    exams = scan.structure("胸部平扫", trie, title=True)
    one = scan.structure("上叶见结节", trie, exams)
    assert [e.paths for e in one] == [[("胸部", "肺", "肺上叶")]]
    assert len(scan.structure("上叶见结节", trie)[0].paths) >= 1


def test_merge_keeps_the_deeper_in_reports():
    trie = scan.dictionary()
    es = scan.structure("肝脏见肝右叶囊肿", trie)
    assert "肝右叶" in [e.keyword for e in es]


def test_best_clause():
    assert scan.best_clause("胆囊壁增厚", "肝脏正常，胆囊壁增厚。") == ("胆囊壁增厚", 1.0)
    assert scan.best_clause("abc", "") == ("", 0.0)


def test_highlight_keeps_the_stronger_of_overlapping_marks():
    assert scan.highlight("a<b", [(0, 2, 2, "x"), (1, 3, 1, "y")]) == 'a<span class="y">&lt;b</span>'


def test_random_texts_never_fail():
    rng = random.Random(4)
    signs = "肺肝右左上叶囊，。；IMse3并伴(）未见cm12 "
    trie = scan.dictionary()
    for _ in range(500):
        scan.structure("".join(rng.choice(signs) for _ in range(rng.randint(0, 40))), trie)
