import hashlib
import itertools
import random
import re
import zlib

import pytest

from sphaera.llm import conversations as cv

OK = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def every_audit(symbols):
    """The cheapest and least audit of a short list of (initial, must go, late), by trying all."""
    gaps = ["", "u", "a", "uu", "ua", "au", "aa"]
    best = None
    acts = [[("D", 4, "")] + ([] if gone else [("K", 3 * late, i), ("R", 3 + 3 * late, "u"), ("R", 3 + 3 * late, "a")]) for i, gone, late in symbols]
    for inserted in itertools.product(gaps, repeat=len(symbols) + 1):
        for act in itertools.product(*acts):
            roles = inserted[0] + "".join(a[2] + g for a, g in zip(act, inserted[1:], strict=True))
            if OK.fullmatch(roles):
                audit = "I" * len(inserted[0]) + "".join(a[0] + "I" * len(g) for a, g in zip(act, inserted[1:], strict=True))
                cost = 3 * sum(map(len, inserted)) + sum(a[1] for a in act)
                if best is None or (cost, audit) < best[:2]:
                    best = (cost, audit, roles)
    return best


def symbol(i, gone, late):
    return "x" if gone else (i if i in "sua" else "o").upper() if late else (i if i in "sua" else "o")


@pytest.mark.parametrize("n", [1, 2, 3])
def test_cheapest_equals_trying_all(n):
    kinds = [(i, False, late) for i in "suat" for late in (False, True)] + [("u", True, False)]
    every = list(itertools.product(kinds, repeat=n))
    random.seed(3)
    for rows in every if n < 3 else random.sample(every, 60):
        cost, audit, _ = every_audit(rows)
        letters, state, total = cv.cheapest("".join(symbol(*r) for r in rows))
        assert ("".join(letters), total) == (audit, cost) and state in (cv.START, cv.ASSISTANT)


def test_blocks_join_to_the_whole():
    import pandas as pd

    random.seed(4)
    for _ in range(200):
        sig = "".join(random.choice("suaoSUAOxuaua") for _ in range(random.randint(2, 40)))
        cuts = sorted(random.sample(range(1, len(sig)), random.randint(1, min(3, len(sig) - 1))))
        parts = [sig[a:b] for a, b in zip([0, *cuts], [*cuts, len(sig)], strict=True)]
        through = [[min(cv.remaining(p, tuple(0 if t == u else cv.NEVER for u in range(4)))[0][s], cv.NEVER) for s in range(4) for t in range(4)] for p in parts]
        ends = cv._ends(pd.DataFrame({"conv_id": 1, "block": range(len(parts)), "sig": parts, "through": through}))["end"].tolist()
        exits = [[cv.cheapest(p, tuple(e), s)[1] for s in range(4)] for p, e in zip(parts, ends, strict=True)]
        before = cv._states(pd.DataFrame({"conv_id": 1, "block": range(len(parts)), "exits": exits}))["before"].tolist()
        joined = "".join("".join(cv.cheapest(p, tuple(e), s)[0]) for p, e, s in zip(parts, ends, before, strict=True))
        assert joined == "".join(cv.cheapest(sig)[0])


def by_hand(rows):
    """Damage, faults, edits and digest of whole conversations in plain Python."""
    kept, ids = {}, {r[0] for r in rows}
    for conv, turn, role, text in rows:
        name = lambda v: " " if v is None else str(v)
        code = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        kept.setdefault(conv, []).extend([(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1))
    out = {}
    for conv in ids:
        order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
        turns, seen, faults, sig = sorted(kept.get(conv, []), key=order), set(), [], ""
        for _, role, text in turns:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append(fault)
            sig += symbol(role[:1] or "o", fault in ("blank", "duplicate"), fault == "truncated")
        letters, _, cost = cv.cheapest(sig) if sig else ([], 0, 0)
        lines, state = [], cv.START
        for (_, role, text), acts in zip(turns, letters, strict=True):
            for x in acts:
                if x == "K":
                    state = {"s": cv.SYSTEM, "u": cv.USER, "a": cv.ASSISTANT}[role[0]]
                    lines.append(f"{role}:{text}")
                elif x != "D":
                    state = cv.TURN[state]
                    lines.append(cv.ROLE[state] + ":" + (text if x == "R" else ""))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [r[:1] for _, r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        assert OK.fullmatch("".join(x[0] for x in lines))
        out[conv] = (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, "".join(letters), hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def rows_of(seed, n):
    random.seed(seed)
    rows = []
    for conv in range(n):
        turn = random.randint(0, 3)
        for _ in range(random.choice([1, 2, 3, 5, 8, 40])):
            role = random.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            text = random.choice(["Yes.", "No!", "more of it", "", None, " \n\t", "end? \n", "same.", f"text {random.random()}."])
            rows.append((conv if conv else None, random.choice([turn, turn, turn, None]), role, text))
            turn += random.choice([1, 1, 1, 2, 0])
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA + ", pos string, digest string").repartition(5)


@pytest.mark.parametrize("block", [cv.BLOCK, 4])
def test_query_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(cv, "BLOCK", block)
    rows = rows_of(block, 60)
    got = {r["conv_id"]: tuple(r)[1:] for r in cv.audits(cv.damage(table(spark, rows))).collect()}
    assert got == by_hand(rows)


def test_repaired_rows_and_empty_tables(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (1, 2, "assistant", "Well"), (2, 0, "assistant", " "), (3, None, "system", "Rules.")]
    out = [tuple(r) for r in cv.repaired(cv.whole(table(spark, rows))).orderBy("conv_id", "ordinal").collect()]
    assert [r for r in out if r[0] == 1] == [(1, 0, "user", "Hi.", "K"), (1, 1, "assistant", "", "I"), (1, 2, "user", "Again.", "K"), (1, 3, "assistant", "Well", "K")]
    roles = {c: "".join(r[2][0] for r in out if r[0] == c) for c in (1, 2, 3)}
    assert all(OK.fullmatch(x) for x in roles.values()) and roles[2] == "" and roles[1]
    none = table(spark, rows).where("false")
    assert cv.audits(cv.damage(none)).collect() == [] and cv.repaired(cv.whole(none)).collect() == []


def test_long_conversation(spark):
    rows = [(7, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(3000)] + [(8, t, "user", "x" * 200_000 + ".") for t in range(3)]
    got = {r["conv_id"]: tuple(r)[1:] for r in cv.audits(cv.damage(table(spark, rows))).collect()}
    assert got == by_hand(rows)
