"""The burst trie against counting every prefix of every conversation."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from shelfwatch.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0), tie, role, text))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)  # the remainder has the sign of c
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plain_nodes(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        sums[p] = (sum(sums[k][0] for k in kids[p]) or 1, own + sum(sums[k][1] for k in kids[p]))
    rows = []
    for p, convs_of in members.items():
        ends = ",".join(map(str, sorted(c for c in convs_of if len(convs[c]) == len(p))))
        rows.append((min(convs_of), len(p), min(members[p[:-1]]) if p else None, len(convs_of), len(kids[p]), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def corpus():
    rng = random.Random(3)
    rows = []
    for c in [*range(-12, 60), 1000, 1001]:
        rows += [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "ü", "long text " * 3, None, ""]))
                 for t in range(rng.randrange(1, 12))]
    rows += [(c, t, "user", f"copy {t}") for c in range(100, 190) for t in range(10)]  # copies
    rows += [(c, t, "user", f"deep {t}") for c in (300, 305, 310) for t in range(12)] + [(300, 12, "user", "x"), (305, 12, "user", "y")]
    rows += [(None, 0, "user", "lost"), (7, 3, "user", "same"), (7, 3, "user", "same"), (500, 0, None, None)]
    return rows


@pytest.mark.parametrize("limit", [12, 200, 10**9])
def test_against_plain(spark, limit):
    rows = corpus()
    convs, turns = prefix_trie.rebuilt(prefix_trie.turn_rows(spark.createDataFrame(rows, SCHEMA)))
    got = sorted((tuple(r) for r in prefix_trie.trie_nodes(convs, turns, limit).collect()), key=str)
    assert got == plain_nodes(plain_rebuilt(rows))


def test_one_hot_conversation_and_copies(spark, monkeypatch):
    """A third of the rows is one conversation, a third is copies of another; runs of ids are cut."""
    monkeypatch.setattr(prefix_trie, "RUN", 7)
    rows = [(5, t, "user", f"turn {t}") for t in range(600)] + [(c, t, "user", "equal") for c in range(1000, 1300) for t in range(2)]
    rows += [(c, 0, "user", f"own {c}") for c in range(2000, 2600)]
    convs = spark.createDataFrame([(c,) for c in {r[0] for r in rows} | {9}], "conv long")
    turns = prefix_trie.turn_rows(spark.createDataFrame(rows, SCHEMA))
    got = sorted((tuple(r) for r in prefix_trie.trie_nodes(convs, turns, 50).collect()), key=str)
    plain = defaultdict(list)
    for c, _, role, text in rows:
        plain[c].append((role, text))
    plain[9] = []
    assert got == plain_nodes(plain)


def test_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie_nodes(*prefix_trie.rebuilt(prefix_trie.turn_rows(none))).count() == 0
    one = spark.createDataFrame([(5, None, None, None, "x", 1)], SCHEMA + ", pos string, tid int")
    rows = [tuple(r) for r in prefix_trie.trie_nodes(*prefix_trie.rebuilt(prefix_trie.turn_rows(one))).orderBy("depth").collect()]
    assert [r[:7] for r in rows] == [(5, 0, None, 1, 1, 1, 0), (5, 1, 5, 1, 0, 1, 0)]
    long = spark.createDataFrame([(5, 0, "user", "w " * 300_000), (6, 0, "user", "w " * 300_000)], SCHEMA)
    convs, turns = prefix_trie.turn_rows(long).select("conv").distinct(), prefix_trie.turn_rows(long)
    assert {r["saved_tokens"] for r in prefix_trie.trie_nodes(convs, turns).collect()} == {600_000}
