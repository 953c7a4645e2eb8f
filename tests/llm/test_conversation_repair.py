"""Conversation repair against exhaustive search."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

from rungwork.llm import conversation_repair
from rungwork.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """(cost, audit, repaired) of rows (role, text, fault) by trying every edit from the end on."""

    @lru_cache(None)
    def go(i, last, inserted):
        ways = []
        if i == len(rows) and last in ("", "a"):
            ways.append((0, "", ()))
        following = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
        name = {"u": "user", "a": "assistant"}[following]
        if inserted < 3:
            cost, audit, out = go(i, following, inserted + 1)
            ways.append((cost + 2, "I" + audit, ((name, ""), *out)))
        if i < len(rows):
            role, text, fault = rows[i]
            cost, audit, out = go(i + 1, last, 0)
            ways.append((cost + 3, "D" + audit, out))
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                if role[:1] == following or (role[:1] == "s" and last == ""):
                    cost, audit, out = go(i + 1, role[:1], 0)
                    ways.append((cost + late, "K" + audit, ((role, text), *out)))
                cost, audit, out = go(i + 1, following, 0)
                ways.append((cost + late + 2, "R" + audit, ((name, text), *out)))
        return min(ways, default=(10**9, "", ()))

    return go(0, "", 0)


def expected(rows):
    """Rows (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults, illegal = set(), [], 0
    for k, (_, role, text) in enumerate(rows):
        last = BLANK.findall(text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None)
        seen.add((role, text))
        illegal += k > 0 and rows[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, out = cheapest(tuple((r, t, f) for (_, r, t), f in zip(rows, faults)))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest), out


def damaged(conv, turn, role, text):
    role, text = " " if role is None else role, " " if text is None else text
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    if kind == 0:
        return []
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def made(seed, convs):
    r = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "Human", "", None, "u2", "agent", "s"]
    texts = [None, "", " \t", "Yes.", "No", "Why? ", "Well!\n", "x", "A. b", "\x0b.\x1c", "漢字。", "漢字!"]
    return [
        (conv, r.choice([None, *range(12)]), r.choice(roles[: r.choice([3, 5, 12])]), r.choice(texts if r.random() < 0.7 else [f"text {r.random()}."]))
        for conv in convs for _ in range(r.choice([1, 2, 3, 5, 9, 14]))
    ]


def test_every_path_of_small_conversations():
    r = random.Random(4)
    for _ in range(1500):
        rows = [(r.choice(["system", "user", "assistant", "tool", ""]), f"t{k}", r.choice([None, None, "truncated", "blank"])) for k in range(r.randint(0, 8))]
        summary, edits = conversation_repair.Summary(), conversation_repair.Edits()
        for role, text, fault in rows:
            summary.add(None, role, text, fault)
            edits.add(None, role, text, fault)
        *_, cost, audit, digest = summary.close()
        edits.close()
        want = cheapest(tuple(rows))
        assert (cost, audit) == want[:2], rows
        assert digest == hashlib.sha256("\n".join(f"{a}:{t}" for a, t in want[2]).encode()).hexdigest()
        told = edits.taken()
        assert "".join(e for _, e, _, _ in told) == audit and [p for p, *_ in told] == list(range(len(told)))
        assert tuple((a, t) for _, e, a, t in told if e != "D") == want[2]


def test_summaries_equal_brute_force(spark):
    rows = made(7, [*range(120), None, 10**12]) + [(500, None, "user", None), (501, 3, None, "x")]
    frame = spark.createDataFrame([(*x, "more", "d") for x in rows], "conv_id long, turn long, role string, text string, fault string, dropped string").repartition(5)
    found = conversation_repair.faults(conversation_repair.damage(frame))
    got = {x[0]: tuple(x)[1:] for x in conversation_repair.summaries(found).collect()}
    edits = {}
    for x in sorted(conversation_repair.repaired(found).collect(), key=lambda x: x.place):
        edits.setdefault(x.conv_id, []).append((x.edit, x.role, x.text))
    assert got.keys() == {x[0] for x in rows}
    for conv in got:
        want, out = expected([y for x in rows if x[0] == conv for y in damaged(*x)])
        assert got[conv] == want, conv
        assert tuple((a, t) for e, a, t in edits.get(conv, []) if e != "D") == out
    assert any(not damaged(*x) for x in rows) and got[None] != got[500]


def test_memory_holds_the_open_suffix_alone():
    """Ordinary rows settle within a few steps; a run of rows that must go is a number in its leaves."""
    summary = conversation_repair.Summary()

    def open_nodes():
        seen, todo = 0, [summary.repair.root]
        while todo:
            node = todo.pop()
            seen += 1
            todo += node.heirs
        return seen

    most, r = 0, random.Random(3)
    for k in range(20_000):
        summary.add(k, r.choice(["user", "assistant", "tool"]), f"text {k}.", r.choice([None, None, "truncated", "blank"]))
        most = max(most, open_nodes())
    assert most < 200
    for k in range(20_000):
        summary.add(k, "user", "", "blank")
    assert open_nodes() < 200
    assert summary.close()[6].count("D") >= 20_000


def test_empty_table_and_whole_query(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    found = conversation_repair.faults(conversation_repair.damage(empty))
    assert conversation_repair.summaries(found).count() == 0 and conversation_repair.repaired(found).count() == 0
    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_conversation_repair"][0](spark, SF).collect()
    assert sorted(x.conv_id for x in got) == sorted({x[0] for x in rows})
    for x in got:
        assert tuple(x)[1:] == expected([y for row in rows if row[0] == x.conv_id for y in damaged(*row)])[0]
