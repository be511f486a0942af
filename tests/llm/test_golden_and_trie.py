"""Golden records and prefix tries against naive versions, with odd rows."""

import hashlib
import random
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.llm import golden, queries, trie

CLIENTS = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, cluster_id long, trust string, part int"
DAY = timedelta(hours=24)


def clients(seed, n):
    rng = random.Random(seed)
    start = datetime(2024, 3, 1)
    pick = lambda *xs: rng.choice([None, "", " \t", *xs])
    out = []
    for i in range(n):
        at = rng.choice([None, start + rng.randrange(4) * 30 * DAY + timedelta(microseconds=rng.choice([0, 0, 1, -1]))])
        master = rng.choice([None, 7, 7, 7, rng.randrange(9), i])
        who = rng.choice([i, i, 3, None])
        out.append((who, master, rng.choice(["crm", "web", "store", "partner", "fax", None]), at, pick("Ab", "äbc", "a b", "xyz"), pick("a@b", "c@d"), pick("X", "Y "), rng.choice([None, 1, 2]), pick("s", "t"), rng.choice([None, 1.005, -2.5, float("nan"), float("inf")]), 1, "t", 2))
    return out + out[:20] * 3


def blank(text):
    return None if text is None or not text.strip(" \t\n\x0b\f\r") else text


def naive(rows):
    groups = {}
    for who, master, source, at, name, email, city, nation, segment, balance, *_ in rows:
        balance = None if balance is None or balance != balance or abs(balance) == float("inf") else balance
        rank = golden.TRUST.index(source) if source in golden.TRUST else 4
        groups.setdefault(master if master is not None else who, []).append((who, rank, at, blank(name), blank(email), blank(city), nation, blank(segment), balance))
    low = lambda v: (v is not None, v if v is not None else 0)  # noqa: E731  nulls first
    out = []
    for c, rs in groups.items():
        latest = max((r[2] for r in rs if r[2] is not None), default=None)
        stale = lambda r: r[2] is None or latest - r[2] > 60 * DAY  # noqa: B023, E731
        recent = lambda r: (r[2] is None, -(r[2] - datetime(1970, 1, 1)) / timedelta(microseconds=1) if r[2] else 0, r[1], r[0] is None, low(r[0]), *map(low, r[3:]))
        trusted = lambda r: (stale(r), r[1], recent(r))  # noqa: B023, E731

        def first(k, order):
            found = [r for r in sorted(rs, key=order) if r[k] is not None]  # noqa: B023
            return (found[0][k], found[0][0]) if found else (None, None)

        segment = first(7, recent)
        place = min(rs, key=lambda r: (-(r[5] is not None) - (r[6] is not None), recent(r)))  # noqa: B023
        name, email = first(3, lambda r: (-len(r[3] or ""), trusted(r))), first(4, trusted)  # noqa: B023
        balance = first(8, lambda r: (segment[0] is None or r[7] != segment[0], recent(r)))  # noqa: B023
        out.append((c, len(rs), sum(map(stale, rs)), name[0], email[0], segment[0], place[5], place[6], balance[0], name[1], email[1], segment[1], balance[1], place[0] if place[5] or place[6] is not None else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "n", "share"), [(1, 60, 1000), (2, 200, 5), (3, 200, 1), (4, 1, 1000)])
def test_golden_records(spark, monkeypatch, seed, n, share):
    """Every cluster large, some of them, and none."""
    monkeypatch.setattr(golden, "SHARE", share)
    rows = clients(seed, n)
    got = golden.golden_records(spark.createDataFrame(rows, CLIENTS).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == naive(rows)


def test_golden_zone_and_empty(spark):
    """A time with a zone, over a change of clock: 1,440 hours and no more."""
    schema = CLIENTS.replace("timestamp_ntz", "timestamp")
    at = [datetime(2024, 2, 1), datetime(2024, 2, 1) + 60 * DAY, datetime(2024, 2, 1) + 60 * DAY + timedelta(microseconds=1)]
    row = lambda i, c, t: (i, c, "crm", t, "n", None, None, None, None, None, 1, "t", 2)
    before = spark.conf.get("spark.sql.session.timeZone")
    rows = [row(1, 1, at[0]), row(2, 1, at[1]), row(3, 3, at[0]), row(4, 3, at[2])]
    made = spark.createDataFrame([(*r[:3], None if r[3] is None else r[3].isoformat(" "), *r[4:]) for r in rows], CLIENTS.replace("timestamp_ntz", "string"))
    try:
        for zone in ("UTC", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            table = made.withColumn("updated_at", F.to_timestamp(F.concat("updated_at", F.lit("+00:00"))))
            got = {r["cluster_id"]: r["n_stale"] for r in golden.golden_records(table).collect()}
            assert got == {1: 0, 3: 1}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert golden.golden_records(spark.createDataFrame([], schema)).count() == 0
    assert golden.golden_records(spark.createDataFrame([], CLIENTS)).count() == 0


def test_golden_query(spark):
    d = queries.op11_golden_record(spark, "/root/testdata/sf0.001")
    assert d.count() == spark.read.parquet("/root/testdata/sf0.001/clients.parquet").selectExpr("coalesce(master_id, client_id) c").distinct().count()
    assert dict(d.dtypes)["balance_cents"] == "bigint"


TURNS = "conv_id long, turn long, role string, text string, depth int, p1 string, round long"


def talks(seed, n, length, letters="ab"):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(-n, 3 * n), n):
        for t in range(rng.randint(1, length)):
            out.append((c, rng.choice([t, t, t, None, 2]), rng.choice(["u", "a", None, ""]) if t % 3 == 0 else "u", rng.choice([*letters, "é" if t % 4 else "", None]), 1, "p", 2))
    return out + out[:5] + [(None, 0, "u", "lost", 1, "p", 2)]


def in_order(rows):
    """conv_id: its turns (role, text)."""
    mark = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, mark(role or "", text or ""), role or "", text or ""))
    return {c: [x[3:] for x in sorted(ts)] for c, ts in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + own[h:]
    return out


def naive_trie(convs):
    nodes = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    kids = {}
    for path in nodes:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    totals = {}
    for path in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[path]) - 1) * len(path[-1][1].encode()) if path else 0
        below = [totals[k] for k in kids.get(path, [])]
        totals[path] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
    return sorted(
        (min(cs), len(p), min(nodes[p[:-1]]) if p else None, len(cs), len(kids.get(p, [])), *totals[p], hashlib.sha256(",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(p)).encode()).hexdigest())
        for p, cs in nodes.items()
    )


@pytest.mark.parametrize(("seed", "n", "length"), [(1, 60, 9), (2, 30, 40), (3, 1, 5), (4, 200, 3)])
def test_prefix_trie(spark, monkeypatch, seed, n, length):
    monkeypatch.setattr(trie, "STEP", 3)
    monkeypatch.setattr(trie, "RUN_BITS", 2)
    rows = talks(seed, n, length)
    table = spark.createDataFrame(rows, TURNS).repartition(3)
    convs = in_order(rows)
    numbered = trie.numbered(table)
    plain = trie.prefix_trie(trie.rooted(numbered)).collect()
    assert sorted(map(tuple, plain)) == naive_trie(convs)
    got = trie.prefix_trie(trie.spliced(numbered)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(naive_trie(rebuilt(convs)), key=repr)


def test_trie_of_copies(spark):
    """Long copies, a prefix of them, one that leaves late, and a conversation of one turn; ids far apart."""
    talk = [("u", f"t{k}") for k in range(70)]
    convs = {5000 * k: talk for k in range(9)} | {7: talk[:20], 3: [*talk[:65], ("a", "other"), ("a", "end")], 1: [("x", "y")], 2**62: talk}
    rows = [(c, d, *t, 1, "p", 2) for c, ts in convs.items() for d, t in enumerate(ts)]
    numbered = trie.numbered(spark.createDataFrame(rows, TURNS), "role", "text")
    nodes = trie.prefix_trie(trie.rooted(numbered))
    assert sorted(map(tuple, nodes.collect())) == naive_trie(convs)
    texts = trie.with_turns(nodes, trie.rooted(numbered), "role", "text").where("depth > 0")
    paths = {tuple(ts[:d]) for ts in convs.values() for d in range(1, len(ts) + 1)}
    assert sorted((r["role"], r["text"]) for r in texts.collect()) == sorted(p[-1] for p in paths)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert trie.prefix_trie(trie.rooted(trie.numbered(none))).count() == 0
    assert trie.prefix_trie(trie.spliced(trie.numbered(none))).count() == 0
    lost = spark.createDataFrame([(None, 1, "u", "t", 1, "p", 2)], TURNS)
    assert trie.prefix_trie(trie.spliced(trie.numbered(lost))).count() == 0
