"""Order-dependent text logic on plain Python values; the Arrow functions of ``operators.detect`` call it.

Offsets are character positions in the text that a function is given.
"""

from __future__ import annotations

import difflib
import html
import re
from dataclasses import dataclass, field, replace

from tessera import fixtures as fx
from tessera.config import LEXICON


class KeywordTrie:
    """Dictionary of keywords: leftmost, longest matches that don't overlap, case ignored.

    A match may not touch an underscore, the only character that counts as part of a word.
    """

    def __init__(self, entries: dict[str, object] | None = None):
        self.root: dict = {}
        self.entries: dict[str, object] = {}
        for k, v in (entries or {}).items():
            self.add(k, v)

    def __len__(self) -> int:
        return len(self.entries)

    def __contains__(self, keyword: str) -> bool:
        return keyword.lower() in self.entries

    def get(self, keyword: str):
        return self.entries.get(keyword.lower())

    def add(self, keyword: str, value: object = None) -> None:
        key = keyword.lower()
        if not key:
            return
        node = self.root
        for ch in key:
            node = node.setdefault(ch, {})
        node[""] = key
        self.entries[key] = keyword if value is None else value

    def remove(self, keyword: str) -> bool:
        key = keyword.lower()
        if key not in self.entries:
            return False
        del self.entries[key]
        way, node = [], self.root
        for ch in key:
            way.append((node, ch))
            node = node[ch]
        del node[""]
        for parent, ch in reversed(way):
            if parent[ch]:
                break
            del parent[ch]
        return True

    def spans(self, text: str) -> list[tuple[object, int, int]]:
        low, out, at = text.lower(), [], 0
        while at < len(low):
            node, end, to = self.root, -1, at
            if not (at and low[at - 1] == "_"):
                while to < len(low) and low[to] in node:
                    node = node[low[to]]
                    to += 1
                    if "" in node and not (to < len(low) and low[to] == "_"):
                        end = to
            if end > 0:
                out.append((self.entries[low[at:end]], at, end))
                at = end
            else:
                at += 1
        return out

    def replaced(self, text: str) -> str:
        out, at = [], 0
        for value, start, end in self.spans(text):
            out += [text[at:start], str(value)]
            at = end
        return "".join(out) + text[at:]


@dataclass
class Entity:
    """A dictionary hit with its candidate paths and axis ranges."""

    keyword: str
    start: int
    end: int
    paths: list[tuple[str, ...]]
    axis: list[tuple[float, float]]
    sentence_index: int = 0
    sentence_start: int = 0
    sentence: str = ""
    clause: str = ""
    orientation: str = ""
    illness: str = ""
    positive: int = 0
    notes: list[str] = field(default_factory=list)

    @property
    def position(self) -> str:
        return self.paths[0][-1]


#: Names that stand for several nodes, so that disambiguation has work.
AMBIGUOUS = {"上叶": ["胸部>肺>肺上叶", "颈部>甲状腺"], "右叶": ["腹部>肝脏>肝右叶", "颈部>甲状腺"], "附件": ["盆腔>卵巢", "脊柱>腰椎"]}


def dictionary() -> KeywordTrie:
    """The graph's names and the ambiguous ones, with their paths and ranges."""
    axis = {p: (lo, hi) for p, _, lo, hi in fx.KG}
    names: dict[str, list[str]] = {}
    for alias, _, path, *_ in fx.kg_rows():
        names.setdefault(alias, []).append(path)
    for alias, paths in AMBIGUOUS.items():
        names.setdefault(alias, []).extend(paths)
    return KeywordTrie({k: [(tuple(p.split(">")), axis[p]) for p in sorted(set(v))] for k, v in names.items()})


def split_sentences(text: str) -> list[tuple[str, int]]:
    """Sentences with their start; the whole text if it has none."""
    out = [(m.group(), m.start()) for m in re.finditer("[^。；？;！!\n\r]+", text)]
    return out or ([(text, 0)] if text else [])


_BOILERPLATE = re.compile("^(余|其余|残|若)|临时|换|结合临床|进一步|建议|随访|必要|请|所见$|片示$|准备")
_JOINED = re.compile(r"(?i)^IM|se\d+$")


def clause_groups(sentence: str, found: list[Entity]) -> list[tuple[str, list[Entity]]]:
    """Clauses that hang together, each with its entities, whose offsets become those of the clause.

    A clause without an entity belongs to the one before; boilerplate without an entity goes.
    """
    groups: list[tuple[str, list[Entity]]] = []
    for m in re.finditer("[^，,；;]+", sentence):
        text = m.group().strip()
        lead = m.start() + m.group().find(text) if text else m.start()
        own = [e for e in found if m.start() <= e.start and e.end <= m.end()]
        if not text or (not own and _BOILERPLATE.search(text)):
            continue
        join = groups and (not own or text.upper().startswith("IM") or re.search(r"se\d+$", groups[-1][0]))
        base = len(groups[-1][0]) + 1 if join else 0
        own = [replace(e, start=e.start - lead + base, end=e.end - lead + base) for e in own]
        if join:
            groups[-1] = (f"{groups[-1][0]},{text}", groups[-1][1] + own)
        else:
            groups.append((text, own))
    return groups


def side_of(clause: str, keyword: str) -> str:
    if re.search(LEXICON.single_organ, keyword):
        return ""
    at = clause.find(keyword)
    near = re.search("^(?:.*[^侧位])?(左|右|双|两)", clause[: max(0, at)]) or re.search("[(（](左|右|双|两)[侧部]*?[)）]", clause[at + len(keyword) :])
    return near[1].replace("两", "双") if near else ""


def fill_sides(items: list[Entity]) -> list[Entity]:
    """Sides of paired organs from the nearest earlier entity, filled ones included, else from the next two."""
    out: list[Entity] = []
    for i, e in enumerate(items):
        if not e.orientation and re.search(LEXICON.paired_organ, " ".join(x for p in e.paths for x in p)):
            before = next((x.orientation for x in reversed(out) if x.orientation), "")
            e = replace(e, orientation=before or next((x.orientation for x in items[i + 1 : i + 3] if x.orientation), ""))
        out.append(e)
    return out


_CONNECT = re.compile("伴有|伴|合并|并")
_TIPS = re.compile("旁|位置|水平|平面|层面|:|：|腹侧|周围|附近|处")
_DENY = re.compile("^(?:未见|无|未|压迫|累及|侵犯|推|沿|包绕|紧贴|近|未达|较|仅|平约|发自|向|邻近)")


def findings(clause: str, own: list[Entity]) -> list[Entity]:
    """own with the finding that each entity of a clause is described by.

    The clause is cut at connectors with entities on both sides. A chunk that denies
    ahead of an entity is that entity's finding as a whole; else it is what follows up
    to the next entity, else what comes before.
    """
    own = sorted(own, key=lambda e: e.start)
    cuts = [0] + [m.start() for m in _CONNECT.finditer(clause) if any(e.end <= m.start() for e in own) and any(e.start >= m.end() for e in own)] + [len(clause)]
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        inside = [e for e in own if a <= e.start < b]
        for k, e in enumerate(inside):
            last = inside[k + 1].start if k + 1 < len(inside) else b
            left = clause[inside[k - 1].end if k else a : e.start]
            right = clause[e.end : last]
            left = _CONNECT.sub("", left, count=1) if a and not k else left
            tail = clause[inside[-1].end : b]
            if len(right) <= 2 and len(tail) > len(right) and right not in "癌大炎瘤水梗疝桥病巨偏旋移折":
                right = tail
            if _DENY.match(left):
                text = clause[a:b].rstrip("，,。；;：: ")
            elif not right and len(left) > 1 and not _TIPS.search(left):
                text = left
            else:
                text = right
            out.append(replace(e, illness=text.strip("，, ")))
    return out


def level(e: Entity) -> int:
    """0 normal, 1 physiological, 2 positive but ignorable, 3 positive."""
    sick = False
    if not re.search(LEXICON.ignore_entity, e.clause):
        if re.search(r"\d+(?:\.\d+)?(?:mm|cm|ml|毫米|厘米|毫升|%|％)", e.clause, re.I):
            sick = True
        else:
            for part in re.split("[,，]", re.sub(",现|,拟|,考虑", "", e.illness)):
                part = part.strip()
                if not part or re.search("^未见", part) and part not in LEXICON.absolute_illness.split("|"):
                    continue
                if part in LEXICON.absolute_illness.split("|") or re.search(LEXICON.illness, part) or (len(part) > 1 and not re.search(LEXICON.normal, part)):
                    sick = True
                    break
    if sick:
        return 2 if re.search(LEXICON.miss_ignore, e.clause) else 3
    return 1 if re.search(LEXICON.physiologic, e.clause) else 0


def _crosses(a: tuple[float, float], b: tuple[float, float], folded: bool = False) -> bool:
    if folded:
        a, b = (tuple(x if x < 500 else x % 100 for x in v) for v in (a, b))
    return a[0] < b[1] and b[0] < a[1] and abs(a[0] - b[0]) <= 100


def disambiguate(e: Entity, context: list[Entity], exams: list[Entity]) -> Entity:
    """e with fewer candidate paths; a strategy counts only if it leaves fewer, but not none.

    In order: spine wording, the exam's axis, the context entity with most path nodes in
    common, the context's axis, folded axes, then the deepest path.
    """
    cands = list(zip(e.paths, e.axis, strict=True))
    if len(cands) < 2:
        return e

    def keep(left: list) -> bool:
        nonlocal cands
        if left and len(left) < len(cands):
            cands = left
        return len(cands) == 1

    def done() -> Entity:
        return replace(e, paths=[p for p, _ in cands], axis=[a for _, a in cands])

    if re.search("椎|横突|棘|脊|肋|骶", e.sentence) and keep([c for c in cands if c[0][0] != "盆腔"]):
        return done()
    spans = [x.axis[0] for x in exams]
    if spans and keep([c for c in cands if any(_crosses(c[1], s) for s in spans)]):
        return done()
    best, top = None, 0
    for c in context:
        if len(c.paths) == 1:
            for cand in cands:
                n = len(set(cand[0]) & set(c.paths[0]))
                if n > top:
                    best, top = cand, n
    if best is not None and keep([best]):
        return done()
    near = [c.axis[0] for c in context if len(c.paths) == 1]
    for folded in (False, True):
        if near and keep([c for c in cands if any(_crosses(c[1], s, folded) for s in near)]):
            return done()
    deep = max(len(p) for p, _ in cands)
    keep([c for c in cands if len(c[0]) == deep])
    return done()


def merge(items: list[Entity], title: bool = False, text: str = "") -> list[Entity]:
    """items without repeats, contained spans, and of related paths the parent (or, in titles without a separator, the parent's) less telling one."""
    seen, unique = set(), []
    for e in items:
        key = (e.keyword, e.start, e.end, e.sentence_index, e.sentence_start, tuple(e.paths))
        if key not in seen:
            seen.add(key)
            unique.append(e)
    out: list[Entity] = []
    for at in dict.fromkeys((e.sentence_index, e.sentence_start) for e in unique):
        group = [e for e in unique if (e.sentence_index, e.sentence_start) == at]
        group = [e for e in group if not any(o is not e and o.start <= e.start and o.end >= e.end and (o.start, o.end) != (e.start, e.end) for o in group)]
        order = sorted(group, key=lambda e: len(e.paths[0]), reverse=not title)
        gone: set[int] = set()
        for i, a in enumerate(order):
            for b in order[i + 1 :]:
                if id(a) in gone or id(b) in gone:
                    continue
                p, q = set(a.paths[0]), set(b.paths[0])
                if not (p <= q or q <= p) or (a.orientation and b.orientation and a.orientation != b.orientation):
                    continue
                if title:
                    between = text[a.end : b.start] if b.start >= a.end else ""
                    gone.add(id(b) if re.search(r"[\\/|+]", between) else id(a))
                elif not a.illness or not b.illness or a.positive == b.positive:
                    gone.add(id(b))
        out += [e for e in group if id(e) not in gone]
    return out


def structure(text: str, trie: KeywordTrie, exams: list[Entity] = (), title: bool = False) -> list[Entity]:
    """The entities of a text, all steps in order."""
    items: list[Entity] = []
    for index, (sentence, start) in enumerate(split_sentences(text)):
        hits = [Entity(sentence[a:b], a, b, [p for p, _ in v], [x for _, x in v], index, 0, sentence) for v, a, b in trie.spans(sentence)]
        for clause, own in clause_groups(sentence, hits):
            own = [replace(e, clause=clause, sentence_start=start + max(0, sentence.find(clause.split(",")[0]))) for e in own]
            own = [replace(e, orientation=side_of(clause, e.keyword)) for e in own]
            items += findings(clause, own)
    items = fill_sides(items)
    items = [replace(e, positive=level(e)) for e in items]
    items = [disambiguate(e, [o for o in items if o is not e], list(exams)) for e in items]
    return merge(items, title, text)


def best_clause(short: str, text: str) -> tuple[str, float]:
    """The clause of a text that is most like a short sentence, and how much: 1 if equal or contained.

    Clauses that share less than 0.3 of their characters are not looked at closely; a
    common beginning adds 0.05.
    """
    best, top = "", 0.0
    matcher = difflib.SequenceMatcher(autojunk=True)
    matcher.set_seq2(short)
    for clause in (c.strip() for c in re.split("[，,。；;！？、\n\r]", text)):
        if not clause:
            continue
        if clause == short:
            return clause, 1.0
        common = len(set(clause) & set(short)) / max(1, len(set(clause) | set(short)))
        if common < 0.3:
            ratio = common
        else:
            matcher.set_seq1(clause)
            ratio = matcher.quick_ratio()
            if ratio > top:
                ratio = matcher.ratio()
        ratio = min(1.0, ratio + 0.05 * (clause[:2] == short[:2]))
        if ratio > top:
            best, top = clause, ratio
    return best, round(top, 6)


_SPINE = {"C": ("颈", 7), "T": ("胸", 12), "L": ("腰", 5), "S": ("骶", 5)}
_NEXT = {"颈": ("胸", 7), "胸": ("腰", 12), "腰": ("骶", 5), "骶": ("尾", 5)}


def expand_parts(text: str) -> str:
    """Abbreviated vertebrae, discs and ribs written out: C3-5, L4/5, T3、4、5, 第1-3肋."""

    def name(part: str, n: int) -> str:
        nxt, most = _NEXT.get(part, (part, 99))
        return f"{part}{n}椎" if n <= most else f"{nxt}{n - most}椎"

    def letters(m: re.Match) -> str:
        return _SPINE[m[1].upper()][0] + m[2]

    out = re.sub(r"(?<![A-Za-z])([CTLSctls])(\d{1,2})(?!\d*[A-Za-z])", letters, text)

    def span(m: re.Match) -> str:
        part, a, b = m[1], int(m[2]), int(m[4])
        return "、".join(name(part, n) for n in range(a, b + 1)) if a <= b else m[0]

    out = re.sub(r"([颈胸腰骶])(\d{1,2})\s*[-~—至]\s*([颈胸腰骶]?)(\d{1,2})(?=[^\d/]|$)", lambda m: span(m) if m[3] in ("", m[1]) else m[0], out)

    def disc(m: re.Match) -> str:
        part, a, b = m[1], int(m[2]), int(m[3])
        other, most = _NEXT.get(part, (part, 99))
        second = f"{other}1" if a == most else f"{part}{b}"
        return f"{part}{a}/{second}"

    out = re.sub(r"([颈胸腰])(\d{1,2})/(\d{1,2})", disc, out)
    for _ in range(10):  # a list's next number takes the part of the one before
        new = re.sub(r"([颈胸腰骶])(\d{1,2})(椎?)、(\d{1,2})(?=\D|$)", lambda m: f"{m[1]}{m[2]}{m[3]}、{m[1]}{m[4]}{m[3]}", out)
        if new == out:
            break
        out = new

    def ribs(m: re.Match) -> str:
        a, b = int(m[1]), int(m[2])
        return "、".join(f"第{n}肋" for n in range(a, b + 1)) if a <= b else m[0]

    return re.sub(r"第?(\d{1,2})\s*[-~—至]\s*(\d{1,2})(?:前|后)?肋", ribs, out)


def highlight(text: str, marks: list[tuple[int, int, int, str]]) -> str:
    """Escaped text with marked spans (start, end, priority, label); of overlapping ones the lower priority number stays."""
    kept: list[tuple[int, int, int, str]] = []
    for m in sorted(marks, key=lambda x: (x[0], x[2])):
        if kept and m[0] < kept[-1][1]:
            if m[2] < kept[-1][2]:
                kept[-1] = m
        else:
            kept.append(m)
    out, at = [], 0
    for start, end, _, label in kept:
        out += [html.escape(text[at:start]), f'<span class="{html.escape(label)}">', html.escape(text[start:end]), "</span>"]
        at = end
    return "".join(out) + html.escape(text[at:])
