"""Conversation repair against an enumeration of all edits, and row by row in plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import pyarrow as pa
import pytest

from mapwright.llm import conversations

SHAPE = re.compile(r"(s?(ua)+)?")


def enumerated(rows):
    """rows: (role initial, fault). The least (cost, audit) of all edits that cost no more than deleting all rows."""
    most, found = min(2, conversations.INSERT + 1) * len(rows), []

    def go(k, cost, audit, roles, inserts):
        if cost > most:
            return
        if k == len(rows) and SHAPE.fullmatch(roles):
            found.append((cost, audit))
        if inserts < 3:
            for role in "ua":
                go(k, cost + conversations.INSERT, audit + "I", roles + role, inserts + 1)
        if k == len(rows):
            return
        initial, fault = rows[k]
        go(k + 1, cost + 2, audit + "D", roles, 0)
        if fault not in ("blank", "duplicate"):
            more = 5 if fault == "truncated" else 0
            go(k + 1, cost + more, audit + "K", roles + initial, 0)
            for role in "ua":
                go(k + 1, cost + more + 1, audit + "R", roles + role, 0)

    go(0, 0, "", "", 0)
    return min(found)


def symbol(initial, fault):
    if fault in ("blank", "duplicate"):
        return "x"
    one = initial if initial in ("s", "u", "a") else "o"
    return one.upper() if fault == "truncated" else one


@pytest.mark.parametrize(("insert", "letters"), [(5, "DKR"), (1, "DKRI")])
def test_signatures_are_solved_like_an_enumeration(monkeypatch, insert, letters):
    """At the price of 5 an insert never pays, as deleting a row beside it costs 2."""
    monkeypatch.setattr(conversations, "INSERT", insert)
    rng = random.Random(1)
    cases = [list(c) for n in (0, 1, 2) for c in itertools.product([(i, f) for i in "suat" for f in (None, "blank", "truncated")], repeat=n)]
    cases += [[(rng.choice("suuaat"), rng.choice([None, None, None, "blank", "truncated"])) for _ in range(3 if insert == 1 else rng.randrange(3, 6))] for _ in range(100 if insert > 1 else 20)]
    audits = set()
    for rows in cases:
        got = conversations.solve("".join(symbol(*r) for r in rows))
        assert got == enumerated(rows), rows
        audits |= set(got[1])
    assert audits == set(letters)


def test_long_signatures():
    rng = random.Random(2)
    for n in (1_500, 20_000):
        cost, audit = conversations.solve("".join(rng.choice("suaxoSUA") for _ in range(n)))
        assert len(audit) - audit.count("I") == n and 0 < cost <= 2 * n
    assert conversations.solve("ua" * 5_000) == (0, "K" * 10_000)


def plain(table):
    """table: (conv, turn, role, text) as given to damage()."""
    out = {c: [] for c, *_ in table}
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    report = {}
    for conv, rows in out.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in rows:
            bare = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
        cost, audit = enumerated([(r[1][:1] or "?", f) for r, f in zip(rows, faults, strict=True)]) if len(rows) < 6 else conversations.solve("".join(symbol(r[1][:1], f) for r, f in zip(rows, faults, strict=True)))
        left, lines, state = iter(rows), [], None
        for letter in audit:
            following = {"u": "assistant"}.get(state, "user")
            if letter == "I":
                lines.append((following, ""))
            else:
                _, role, text = next(left)
                if letter != "D":
                    lines.append((role if letter == "K" else following, text))
            state = lines[-1][0][:1] if lines else None
        report[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(), lines,
        )
    return report


def table_of(seed):
    rng = random.Random(seed)
    texts = ["Ok.", "Why?", "no", "", " \t", "é!", "a.\n", "b. \x0b", "...", None, "Long one. " * 400, "x\x0cy", " ."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "unknown", "User"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 6)):
            rows.append((conv, rng.choice([turn, turn, turn * 3, None]), rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2], rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.randrange(9)}."))
    rows += [(100 + k, 0, "user", "gone.") for k in range(40)] + [(7, 0, "user", "same")] * 3
    return rows + [(500, k, ("user", "assistant")[k % 2], f"Turn {k}{'.' if k % 5 else ''}") for k in range(600)]


@pytest.mark.parametrize("seed", [1, 2])
def test_reports_and_repaired_rows(spark, seed):
    table = table_of(seed)
    df = spark.createDataFrame([(*r, 1, "clash") for r in table], "conv_id long, turn long, role string, text string, pos int, audit string").repartition(5)
    want = plain(table)
    got = conversations.repair_report(df, conversations.damage(df)).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r["conv_id"]][:-1], r["conv_id"]
    damaged = conversations.damage(df).withColumnsRenamed({"conv": "conv_id"})
    lines = {}
    for r in conversations.repaired_turns(damaged).collect():
        lines.setdefault(r["conv_id"], {})[r["place"]] = (r["role"], r["text"])
    for conv, w in want.items():
        assert [lines.get(conv, {})[k] for k in sorted(lines.get(conv, {}))] == w[-1]


def test_inserted_rows_are_replayed():
    rows = [(1, 0, "IKIK", None, None), (1, 1, None, "assistant", "a."), (1, 2, None, "assistant", "b."), (2, 0, "KII", None, None), (2, 1, None, "system", "s."), (3, 0, "", None, None), (None, 0, "RDI", None, None)]
    rows += [(None, 1, None, "tool", "x."), (None, 2, None, "user", "")]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part, strict=True)], names=["conv", "pos", "audit", "role", "text"]) for part in (rows[:2], rows[2:7], rows[7:])]
    got = list(conversations._events(iter(batches)))
    assert [e[:2] for e in got if e[1] is None] == [(1, None), (2, None), (3, None), (None, None)]
    assert [e for e in got if e[1]] == [
        (1, "user", ""), (1, "assistant", "a."), (1, "user", ""), (1, "assistant", "b."), (2, "system", "s."), (2, "user", ""), (2, "assistant", ""), (None, "user", "x."), (None, "assistant", ""),
    ]


def test_no_rows_at_all(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair_report(df).collect() == []
    assert conversations.repaired_turns(df).collect() == []


def test_far_turns_and_whole_tables(spark):
    df = spark.createDataFrame([(1, -(1 << 63), "user", "a."), (1, (1 << 63) - 1, "assistant", "b."), (2, 5, "assistant", "c.")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["gaps"], r["cost"], r["audit"]) for r in conversations.repair_report(df).collect()}
    assert got == {1: (0, 0, "KK"), 2: (0, 2, "D")}
