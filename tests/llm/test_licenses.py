"""License scans against every span of whole words."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import licenses, queries
from tessera.llm.queries import LICENSE_PHRASES

NOTICES = [("mit", "Released under the MIT License"), ("gpl", "under the terms of the GNU General Public License"), ("short", "All rights reserved"), ("é", "Tous droits réservés à l'auteur")]
SCHEMA = "doc_id long, text string, n_words int, spans string, label string"


def words_of(text):
    """One character after the other."""
    out, word = [], ""
    for c in (text or "").translate({k: k + 32 for k in range(65, 91)}):
        if ord(c) >= 128 or "0" <= c <= "9" or "a" <= c <= "z":
            word += c
        else:
            out += [word] if word else []
            word = ""
    return out + ([word] if word else [])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(text, notices):
    """(notice, first word, word after, edits) of all spans within the allowed edits."""
    words, out = words_of(text), set()
    for i, (_, notice) in enumerate(notices):
        plain = " ".join(words_of(notice)).encode()
        k = min(len(plain) // licenses.PER_EDIT, licenses.MAX_EDITS)
        for a in range(len(words)):
            for b in range(a + 1, min(len(words), a + len(plain)) + 1):
                span = " ".join(words[a:b]).encode()
                if abs(len(span) - len(plain)) <= k and (e := distance(span, plain)) <= k:
                    out.add((i, a, b, e))
    return out


def check(text, notices):
    got = licenses.Scanner([], notices).scan(text.encode())
    assert got[0] == len(words_of(text))
    want = brute(text, notices)
    spans = {(h.label, h.start, h.stop, h.edits) for h in got[1]}
    assert spans <= {(notices[i][0], a, b, e) for i, a, b, e in want}
    # each place where a notice stands is told of, by itself or by an overlapping one with no more edits
    for i, a, b, e in want:
        assert any(h.start < b and a < h.stop and h.edits <= e for h in got[1]), (notices[i], a, b, e, spans)
    return spans


def spoilt(rng, text, edits):
    for _ in range(edits):
        at = rng.randrange(len(text))
        text = rng.choice([text[:at] + text[at + 1 :], text[:at] + rng.choice("aeimnx .") + text[at:], text[:at] + rng.choice("zqé") + text[at + 1 :]])
    return text


@pytest.mark.parametrize("seed", range(12))
def test_against_all_spans(seed):
    rng = random.Random(seed)
    parts = []
    for _ in range(7):
        parts += [" ".join(rng.choice(["the", "license", "under", "rights", "mit", "of", "gnu"]) for _ in range(rng.randint(0, 6)))]
        parts += [spoilt(rng, rng.choice(NOTICES)[1], rng.randint(0, 5))]
    check(rng.choice([" ", ",\n", ". "]).join(parts), NOTICES)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["all", "rights", "reserved", "al", "right", "reservd", "a", "x", "under", "the"]), max_size=14))
def test_repeated_words(words):
    check(" ".join(words), [("short", "All rights reserved"), ("a", "a"), ("under", "under the under the under")])


def test_pieces_agree(monkeypatch):
    rng = random.Random(5)
    text = " ".join(spoilt(rng, rng.choice(NOTICES)[1], rng.randint(0, 3)) + " filler" * rng.randint(0, 9) + " under the mit license" for _ in range(60)) + " " + "w" * 900
    scanner = licenses.Scanner(LICENSE_PHRASES, NOTICES)
    whole = scanner.scan(text.encode())
    assert len(whole[1]) > 40 and len(whole[2]) > 55
    for size in (7, 64, 333, 1000):
        monkeypatch.setattr(licenses, "PIECE", size)
        assert scanner.scan(text.encode()) == whole


def test_long_text():
    text = b"lorem ipsum " * 2_000_000 + b"Licensed undr the Apache Licence, Version 2.0" + b" dolor" * 1000
    n, hits, places = licenses.Scanner(LICENSE_PHRASES, licenses.read_notices()).scan(text)
    assert n == 4_000_000 + 8 + 1000
    assert [(h.label, h.start, h.edits) for h in hits] == [("apache-2", 4_000_000, 2)] and not places


def test_best_of_overlapping():
    spans = check("licensed under cc by sa 4.0 and licensed under cc by nc 4.0", [("nc", "licensed under CC BY-NC 4.0"), ("sa", "Licensed under CC BY-SA 4.0")])
    assert spans == {("sa", 0, 7, 0), ("nc", 8, 15, 0)}


def test_digest(spark):
    rows = [
        (1, "Under the MIT License. CC-BY NC CC BY NC", 0, "s", "x"), (2, None, 0, "s", "x"), (3, " \n", 0, "s", "x"), (4, "released undr the MIT licence", 0, "s", "x"),
        (5, "nothing here under the mit", 0, None, None), (4, "released undr the MIT licence", 0, "s", "x"), (None, "APACHE License; version 2 cc by nc", 0, "s", "x"),
    ]
    table = spark.createDataFrame(rows, SCHEMA)
    scanned = licenses.scan_documents(table, LICENSE_PHRASES)
    got = sorted((tuple(r) for r in licenses.license_digest(scanned).collect()), key=repr)
    share = 1 - 2 / 30
    want = [
        (1, 10, 3, 0, 7, "cc-by-nc,mit", "cc-by-nc,mit", 1.0), (2, 0, 0, None, None, "", "", 0.0), (3, 0, 0, None, None, "", "", 0.0), (4, 5, 0, None, None, "", "mit", share),
        (4, 5, 0, None, None, "", "mit", share), (5, 5, 0, None, None, "", "", 0.0), (None, 7, 2, 0, 4, "apache-2,cc-by-nc", "apache-2,cc-by-nc", 1.0),
    ]
    assert [(*r[:7], round(r[7], 9)) for r in got] == sorted([(*r[:7], round(r[7], 9)) for r in want], key=repr)
    assert licenses.scan_documents(spark.createDataFrame([], SCHEMA), LICENSE_PHRASES).count() == 0


def test_query_against_naive(spark):
    sf = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in queries.op12_license_scan(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        words, r = words_of(text), got[i]
        at = [(p, label) for label, phrase in LICENSE_PHRASES for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
        starts = [p for p, _ in at]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(at), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in at})) and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] == 1.0 or not at)
        assert "gpl" in r["labels"].split(",") or "licensed under the gnu general public license" not in " ".join(words)
