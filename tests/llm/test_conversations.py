"""Conversation tries and repair against brute force, over odd rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from adledger.llm import burst_trie, turn_repair

CONV = "conv_id long, turn long, role string, text string, id string, head string, pos int, body string"
SPACE = " \t\n\v\f\r"


@pytest.fixture(scope="module")
def told():
    """Rows with nulls everywhere, ties, repeated rows, shared starts, one long conversation and a 2 MB text."""
    r = random.Random(3)
    starts = [[("user", f"hi {i}."), ("assistant", "yes?"), ("user", "go on")] for i in range(3)]
    rows = []
    for conv in range(-7, 60):
        if conv % 11 == 3:
            continue
        turns = starts[conv % 3][:r.randint(0, 3)] + [
            (r.choice(["user", "assistant", "system", "tool", "", "User", None]), r.choice(["a.", "b", "", None, " \t", " ", "é!", "c. \n"]))
            for _ in range(r.randint(0, 4))]
        rows += [(conv, i if r.random() < 0.9 else None, *t) for i, t in enumerate(turns)]
    rows += [rows[5], rows[5], rows[9]]
    rows += [(None, 0, "user", "q."), (None, None, "assistant", "a"), (70, None, None, None)]
    rows += [(80, i, "user" if i % 2 else "assistant", f"t{i % 40}.") for i in range(300)]
    rows += [(85, i, "user" if i % 2 else "assistant", f"t{i % 40}.") for i in range(200)]
    rows += [(90, 2**40, "user", "x" * 2_000_000 + "."), (90, 7, "system", "long")]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def table(spark, told):
    return spark.createDataFrame([(*t, "i", "h", 1, "b") for t in told], CONV).repartition(5)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def in_order(rows, blank, tie):
    rows = [(t, role if role is not None else blank, text if text is not None else blank) for t, role, text in rows]
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], tie(x)))


def expected_trie(convs):
    nodes = defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    kids = defaultdict(set)
    for p in nodes:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in nodes:
        cost = (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += cost
            leaves[p[:d]] += not kids[p]
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                   sha(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)))) for p, m in nodes.items())


def by_conv(told):
    convs = defaultdict(list)
    for c, *rest in told:
        if c is not None:
            convs[c].append(tuple(rest))
    return convs


def tid(x):
    return hashlib.sha256(f"{len(x[1].encode())}:{x[1]}{x[2]}".encode()).digest()[:16]


def found_trie(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def order_key(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


@pytest.mark.parametrize("burst", [1, 40, 50_000])
def test_tries(table, told, burst):
    own = {c: tuple((role, text) for _, role, text in in_order(rows, "", tid)) for c, rows in by_conv(told).items()}
    got = found_trie(burst_trie.prefix_trie(table.where("conv_id <> 85 or conv_id is null"), burst=burst))
    assert sorted(got, key=order_key) == sorted(expected_trie({c: s for c, s in own.items() if c != 85}), key=order_key)
    if burst == 40:  # 80 and 85 share all turns of the shorter one
        return
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c / 5) * 5
        rebuilt[c] = own.get(c - base, ())[:h] + own[c][h:]
    got = found_trie(burst_trie.grafted_trie(table, burst=max(burst, 480)))
    assert sorted(got, key=order_key) == sorted(expected_trie(rebuilt), key=order_key)


def test_empty_tries(table):
    none = table.where("false")
    assert burst_trie.grafted_trie(none).count() == burst_trie.prefix_trie(none.where("conv_id = 1")).count() == 0


def test_sweep_names_parents():
    suffixes = [([b"a", b"b"], [1, 2], 5, 1), ([b"a"], [1], 3, 2), ([b"a", b"c"], [1, 4], 2, 1), ([b"z"], [9], 9, 3)]
    assert sorted(burst_trie.sweep(suffixes, 4), key=order_key) == sorted([
        (5, 2, None, 4, 2, 2, 3, 3), (6, 5, 2, 1, 0, 1, 0, 5), (6, 2, 2, 1, 0, 1, 0, 2), (5, 9, None, 3, 0, 1, 18, 9)], key=order_key)


def search(rows):
    """Cheapest, then least, edit string by uniform-cost search; rows are (initial, fault)."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        state = (i, {"": 0, "s": 1}.get(out, 2 + (out[-1:] == "a")))
        if i == len(rows) and re.match(r"(s?(ua)+)?\Z", out):
            return cost, audit
        if (state, "done") in seen:
            continue
        seen.add((state, "done"))
        steps = [("I", 3, 0, x) for x in "ua"]
        if i < len(rows):
            initial, fault = rows[i]
            steps.append(("D", 4, 1, ""))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                steps += [("K", extra, 1, initial or "?")] + [("R", 3 + extra, 1, x) for x in "ua"]
        for letter, price, used, role in steps:
            if re.match(r"s?(ua)*u?\Z", out + role):
                heapq.heappush(heap, (cost + price, audit + letter, i + used, out + role))


def expected_audit(rows):
    seen, told = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        fault = ("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
        told.append((role[:1], fault))
    cost, audit = search(told)
    out, left = [], iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(left)[1:]
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if out and out[-1][0][:1] == "u" else "user"
        out.append((role, text, letter))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = [sum(f == x for _, f in told) for x in ("blank", "duplicate", "truncated")]
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
    return (gaps, *count, illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t, _ in out))), out


def hurt(told):
    out = defaultdict(list)
    for c, turn, role, text in told:
        role, text = (" " if v is None else v for v in (role, text))
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        out[c] += [] if fate == 0 else [(turn, "user" if fate == 4 else role,
                                         "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)] * (2 if fate == 3 else 1)
    return out


def test_repair(table, told):
    digest = lambda x: hashlib.sha256(x[2].encode()).digest()[:16]
    want = {c: expected_audit(in_order(rows, " ", digest)) for c, rows in hurt(told).items()}
    hurt_rows = turn_repair.damaged(table)
    got = turn_repair.audits(hurt_rows, table).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == {c: w[0] for c, w in want.items()} and len(got) == len(want)
    rows = sorted(turn_repair.repair(hurt_rows).collect(), key=lambda r: r.position)
    for c, (_, out) in want.items():
        assert [(r.role, r.text, r.edit) for r in rows if r.conv_id == c] == out


def test_repair_of_nothing(table, spark):
    none = table.where("false")
    assert turn_repair.audits(turn_repair.damaged(none), none).count() == turn_repair.repair(none).count() == 0
    named = spark.createDataFrame([("x", 1, "user", "a.")], "conv_id string, turn int, role string, text string")
    [row] = turn_repair.audits(named).collect()
    assert row.conv_id == "x" and (row.cost, row.audit) == (3, "KI")


def test_edits_are_the_cheapest_and_least():
    r = random.Random(4)
    names = ["", "truncated", "blank"]
    for _ in range(300):
        rows = [r.randrange(12) for _ in range(r.randint(0, 30))]
        cost, audit = turn_repair.cheapest_edits(bytes(rows))
        assert (cost, audit.decode()) == search([("suax"[x % 4], names[x // 4]) for x in rows])
