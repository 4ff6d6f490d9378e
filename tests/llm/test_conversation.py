"""Conversation repair against a search over all edits, over pieces of different lengths, and on odd rows."""

import hashlib
import itertools
import random
import re

import pytest

from panelith.llm import conversation

GOAL = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, copies long"


def edits(rows):
    """All sequences of edits with at most two insertions in a row, as (cost, letters, repaired)."""
    puts = [("", 0, [])]
    for n in (1, 2):
        puts += [("I" * n, 2 * n, [(r, "") for r in roles]) for roles in itertools.product(("user", "assistant"), repeat=n)]
    seen, ways = set(), [(0, "", [])]
    for role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        lost = blank or (role, text) in seen
        seen.add((role, text))
        cut = 0 if lost else int(not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text))
        steps = [("D", 3, [])]
        if not lost:
            steps += [("K", cut, [(role, text)]), ("R", 2 + cut, [("user", text)]), ("R", 2 + cut, [("assistant", text)])]
        ways = [(c + pc + sc, a + pl + sl, out + po + so) for c, a, out in ways for pl, pc, po in puts for sl, sc, so in steps]
    return [(c + pc, a + pl, out + po) for c, a, out in ways for pl, pc, po in puts]


def brute(rows):
    good = [w for w in edits(rows) if GOAL.fullmatch("".join(r[:1] for r, _ in w[2]))]
    cost, letters, out = min(good, key=lambda w: (w[0], w[1]))
    return cost, letters, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def python_rows(rows):
    seen, out = set(), []
    for role, text in rows:
        out.append(conversation.Row(None, role, text, 1, (role, text) in seen))
        seen.add((role, text))
    return out


ROLES, TEXTS = ("system", "user", "assistant", "tool", " "), ("a.", "b", " ", "c!", "")


def test_cheapest_edits_equal_a_search_over_all():
    rng = random.Random(5)
    for _ in range(150):
        rows = [(rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(rng.randrange(4))]
        letters, out, _, cost = conversation.cheapest(python_rows(rows), 0, conversation.ENDS, True)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        assert (cost, letters, digest) == brute(rows), rows


def test_pieces_give_what_the_whole_gives():
    rng = random.Random(6)
    for _ in range(60):
        rows = python_rows([(rng.choice(ROLES), f"{rng.choice(TEXTS)}{rng.randrange(30)}{rng.choice('.x')}") for _ in range(rng.randrange(1, 40))])
        whole = conversation._Mended()
        whole.take(rows, conversation.ENDS, True)
        size = rng.randrange(1, 9)
        cut = [rows[k : k + size] for k in range(0, len(rows), size)]
        behind = conversation.behind_costs([conversation.matrix(p) for p in cut])
        pieces = conversation._Mended()
        for n, p in enumerate(cut):
            pieces.take(p, behind[n], n + 1 == len(cut))
        assert pieces.report() == whole.report()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, 0, "system", "s.", 1), (1, 1, "user", "q?", 1), (1, 2, "assistant", "a.", 1),
        (2, 0, "user", "q?", 2), (2, 3, "assistant", "q", 1), (2, 3, "assistant", "q", 1), (2, 7, "user", "q?", 1),
        (3, 5, "user", None, 0), (3, 6, None, "x", 0),
        (4, None, None, None, 1), (4, None, "user", "z.", 1), (4, 2, "", "y", 1),
        (None, 1, "user", "q?", 1), (None, 2, "assistant", "a!", 1),
    ]
    rows += [(5, t, ("user", "assistant")[t % 2], f"{t % 7}.", 1) for t in range(300)]
    rows += [(6, 1, "user", "same.", 1)] * 200
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("piece", [3, 4096])
def test_reports_by_spark(spark, odd, piece):
    got = {r["conv_id"]: r for r in conversation.repair(odd.withColumn("matrix", odd["turn"]), piece=piece).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, None}
    assert (got[1]["cost"], got[1]["audit"], got[1]["gaps"]) == (0, "KKK", 0)
    assert got[1]["repaired_sha256"] == hashlib.sha256(b"system:s.\nuser:q?\nassistant:a.").hexdigest()
    assert (got[2]["gaps"], got[2]["duplicate"], got[2]["truncated"], got[2]["illegal"]) == (5, 3, 1, 2)
    assert (got[2]["audit"], got[2]["cost"]) == ("KDKDD", 10)
    assert tuple(got[3])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert (got[4]["gaps"], got[4]["blank"], got[4]["truncated"]) == (0, 1, 1)
    assert (got[None]["audit"], got[None]["cost"]) == ("KK", 0)
    assert got[5]["duplicate"] == 300 - 14 and len(got[5]["audit"].replace("I", "")) == 300
    assert (got[6]["duplicate"], got[6]["illegal"]) == (199, 199)


def test_least_letters_of_copies(spark, odd):
    got = conversation.repair(odd.where("conv_id = 6")).first()
    # keeping one and inserting an answer (2) is cheaper than deleting it (3)
    assert (got["audit"], got["cost"]) == ("K" + "D" * 199 + "I", 2 + 3 * 199)


@pytest.mark.parametrize("piece", [2, 4096])
def test_repaired_turns_hash_to_the_report(spark, odd, piece):
    said: dict = {}
    for r in sorted(conversation.repair(odd, turns=True, piece=piece).collect(), key=lambda r: r["position"]):
        said.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in conversation.repair(odd).collect():
        assert hashlib.sha256("\n".join(said.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]


def test_damage_and_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation.repair(conversation.damage(empty)).count() == 0
    rows = spark.createDataFrame([(c, t, "assistant", "x. y!") for c in range(40) for t in range(20)], "conv_id long, turn long, role string, text string")
    import zlib

    for r in conversation.damage(rows.withColumn("code", rows["turn"])).collect():
        code = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        assert r["copies"] == {0: 0, 3: 2}.get(code, 1)
        assert r["text"] == {1: "", 2: "x y"}.get(code, "x. y!") and r["role"] == ("user" if code == 4 else "assistant")
