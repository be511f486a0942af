"""URL filters: host and path rules first, then a weighted vocabulary.

Rules name a host and a path. A rule fits its host and all subdomains where the url's
path starts with the rule's; the longest rule that fits decides. Where none does, an
Aho-Corasick automaton finds the terms of the vocabulary in the lower-cased url. A hit
counts if neither neighbour is an ASCII letter or digit. Every term has a weight; one of
``LIMIT`` or more is strict and rejects by one hit, softer ones reject where two or more
different terms weigh as much together. ``read_terms`` reads a vocabulary from a file with
a term and its weight on each line; ``url_terms.txt`` is the one of the query.

One pass without a shuffle; the automaton and the rules are small parameters.

Defined results: a null url, or one without ``://``, has empty host and path, so that
no rule fits; it is still searched for terms, a null one having none. Repeated rows are
judged row by row; an empty table gives an empty result. Only id and url are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 100


def read_terms(path: str | Path = Path(__file__).with_name("url_terms.txt")) -> dict[str, int]:
    """Weights by term; lines that start with # and empty ones are left out."""
    lines = (line.split() for line in Path(path).read_text("utf-8").splitlines() if line.strip() and not line.startswith("#"))
    return {term.translate(_UPPER): int(weight) for term, weight in lines}


_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_STOP = re.compile(r"[/?#]")
_END = re.compile(r"[?#]")


def split_url(url: str | None) -> tuple[str, str]:
    """Host, with A-Z lower-cased, and path."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    m = _STOP.search(rest)
    host, rest = (rest[: m.start()], rest[m.start() :]) if m else (rest, "")
    m = _END.search(rest)
    return host.translate(_UPPER), rest[: m.start()] if m else rest


def fitting_rule(host: str, path: str, rules: list[tuple[str, str]]) -> tuple[str, str] | None:
    """rules: (verdict, host and path), longest first."""
    for verdict, rule in rules:
        name, slash, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + tail):
            return verdict, rule
    return None


def automaton(terms: dict[str, int]):
    a = ahocorasick.Automaton()
    for t, weight in terms.items():
        a.add_word(t, (t, weight))
    a.make_automaton()
    return a


def hits(url: str | None, a) -> dict[str, int]:
    """Weights of the distinct terms of a url that stand between boundaries."""
    found: dict[str, int] = {}
    if url and len(a):
        low = url.translate(_UPPER)
        inner = lambda c: c.isascii() and c.isalnum()
        for end, (term, weight) in a.iter(low):
            start = end - len(term) + 1
            if not (start and inner(low[start - 1])) and not (end + 1 < len(low) and inner(low[end + 1])):
                found[term] = weight
    return found


def rejected(found: dict[str, int]) -> bool:
    return any(w >= LIMIT for w in found.values()) or (len(found) > 1 and sum(found.values()) >= LIMIT)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], terms: dict[str, int] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, strict_hits, soft_hits, soft_weight) for every row. terms: weights, those of the file if None."""
    rules = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    terms = read_terms() if terms is None else terms
    names = ["host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_weight"]
    kinds = [pa.string()] * 4 + [pa.int32()] * 3

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(terms)
        for b in batches:
            rows = []
            for u in b.column("url"):
                url = u.as_py()
                host, path = split_url(url)
                fit = fitting_rule(host, path, rules)
                found = hits(url, a)
                soft = [w for w in found.values() if w < LIMIT]
                verdict = fit[0] if fit else "block" if rejected(found) else "allow"
                rows.append((host, path, fit[1] if fit else None, verdict, len(found) - len(soft), len(soft), sum(soft)))
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.record_batch([b.column("page_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["page_id", *names])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).mapInArrow(f, f"page_id {kind}, host string, path string, rule string, verdict string, strict_hits int, soft_hits int, soft_weight int")
