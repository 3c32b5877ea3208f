"""Conversation repair against a plain search over all edits, and its SQL."""

import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from shopsight.llm import conversation_repair as R
from tests import oracle_check

SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, mark string, lost boolean, kind int"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute(rows):
    """The contract, read literally: all edit sequences, the cheapest and then the least."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        body = text.rstrip(SPACES)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else
                      "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @functools.lru_cache(None)
    def best(i, state, inserted):
        options = []
        if i == len(rows):
            options += [(0, "", ())] if state in ("", "a") else []
        else:
            _, _, role, text = rows[i]
            cost, audit, out = best(i + 1, state, 0)
            options.append((cost + 4, "D" + audit, out))
            if faults[i] not in ("blank", "duplicate"):
                cut = 3 if faults[i] == "truncated" else 0
                for letter, extra, new in (("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")):
                    to = after.get((state, new[:1]))
                    if to:
                        cost, audit, out = best(i + 1, to, 0)
                        options.append((cost + extra + cut, letter + audit, (f"{new}:{text}",) + out))
        for new in ("user", "assistant"):
            to = after.get((state, new[0]))
            if to and inserted < 3:
                cost, audit, out = best(i, to, inserted + 1)
                options.append((cost + 3, "I" + audit, (f"{new}:",) + out))
        return min(options) if options else (10**9, "", ())

    cost, audit, out = best(0, "", 0) if rows else (0, "", ())
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def conversations():
    draw, rows = random.Random(5), []
    for conv in [None, *range(160)]:
        for turn in range(draw.randint(1, 11)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            text = draw.choice(["Yes.", "No!", "and so on", " \n", "", None, f"Say {draw.random()}?", "ends here. \t"])
            rows.append((conv, draw.choice([turn, turn, turn, 2 * turn, None]), role, text))
    rows += [(900, t, "user", f"Turn {t // 40}.") for t in range(300)] + [(901, 1, "user", "Same.")] * 70
    return rows


def test_repair_equals_a_search_over_all_edits(spark):
    rows = conversations()
    table = spark.createDataFrame([(*r, "x", True, 1) for r in rows], SCHEMA)  # columns that clash are ignored
    want = {}
    for conv, *rest in damage(rows):
        want.setdefault(conv, []).append((conv, *rest))
    for parts in (1, 7):
        found = R.repair(R.damaged(table.repartition(parts))).collect()
        assert len(found) == len({r[0] for r in rows})
        for r in found:
            got = (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
            if r.conv_id in want and len(want[r.conv_id]) < 40:
                assert got == brute(want[r.conv_id]), r.conv_id
            elif r.conv_id not in want:
                assert got == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_runs_cost_the_same_as_row_by_row():
    draw = random.Random(3)
    for _ in range(60):
        symbols = np.array([s for _ in range(draw.randint(0, 6)) for s in [draw.choice([0, 1, 2, 3, 5, 6, 8])] * draw.randint(1, 90)], np.int8)
        cost, audit = R.cheapest_edits(symbols)
        after = R._END
        for s in symbols[::-1].tolist():
            after = R._apply(R._powers[s][0], after)
        assert cost == after[0] and len(audit.replace("I", "")) == len(symbols)
    cost, audit = R.cheapest_edits(np.ones(1_000_000, np.int8))
    assert (cost, audit) == (1_500_000, "KR" * 500_000)


def test_long_texts_and_no_rows(spark):
    long = "word " * 1_000_000 + "."
    table = spark.createDataFrame([(7, 3, "user", long), (7, 4, "assistant", long)], "conv_id long, turn long, role string, text string")
    row = R.repair(R.damaged(table)).first()
    kept = damage([(7, 3, "user", long), (7, 4, "assistant", long)])
    assert (row.cost, row.audit, row.repaired_sha256) == brute(kept)[5:]
    assert R.repair(R.damaged(table.where("false"))).collect() == []


def test_sql(spark, sf_dir):
    assert oracle_check.difference(spark, oracle_check.connect(sf_dir), sf_dir, "op11_conversation_repair") is None
    assert "op11_conversation_repair" in entry.queries()


@pytest.mark.parametrize("key", ["conv_id", "turn"])
def test_null_keys_read_as_a_space(spark, key):
    rows = [(None if key == "conv_id" else 3, None if key == "turn" else t, "user", f"T{t}.") for t in range(6)]
    row = R.repair(R.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert (row.gaps, row.blank, row.duplicate, row.truncated, row.illegal, row.cost, row.audit, row.repaired_sha256) == brute(damage(rows))
