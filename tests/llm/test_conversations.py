import hashlib
import heapq
import re
import zlib
from collections import defaultdict

import pytest

from terrace.llm import conversations
from terrace.llm.conversations import Repair, damage, repair_report

SCHEMA = "conv_id long, turn long, role string, text string, `k.k` string, conv string, fault string"
SPACE = re.compile(r"[^\x20\x09-\x0D]")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "own", "own", "own") for r in rows], SCHEMA)


def cheapest(rows, must_go, cut):
    """Least cost, then least letters, by searching all edits from the first row on."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, letters, i, q, out = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, letters, out
        if (i, q) in done:
            continue
        done.add((i, q))
        if len(letters) < 3 * len(rows) + 3:
            for c, role in (("u", "user"), ("a", "assistant")):
                if (q, c) in step:
                    heapq.heappush(heap, (cost + 3, letters + "I", i, step[q, c], (*out, (role, ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, q, out))
            if i not in must_go:
                worse = 3 * (i in cut)
                if (q, role[:1]) in step:
                    heapq.heappush(heap, (cost + worse, letters + "K", i + 1, step[q, role[:1]], (*out, (role, text))))
                for c, new in (("u", "user"), ("a", "assistant")):
                    if (q, c) in step:
                        heapq.heappush(heap, (cost + 3 + worse, letters + "R", i + 1, step[q, c], (*out, (new, text))))


def broken(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def brute(original, rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role, text))
    out = {}
    for conv in {r[0] for r in original}:
        mine = sorted(groups[conv])
        turns = [t for known, t, _, _ in mine if known]
        pairs = [(role, text) for _, _, role, text in mine]
        blank = {i for i, (_, t) in enumerate(pairs) if not SPACE.search(t)}
        again = {i for i, p in enumerate(pairs) if p in pairs[:i]} - blank
        cut = {i for i, (_, t) in enumerate(pairs) if i not in blank | again and SPACE.findall(t)[-1] not in ".!?"}
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(pairs, pairs[1:]))
        cost, letters, lines = cheapest(pairs, blank | again, cut)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, len(blank), len(again), len(cut), illegal, cost, letters, sha)
    return out


def collected(df):
    got = df.collect()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r[n] for n in names) for r in got}


def table():
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User", "sage", "u"]
    texts = ["Yes.", "No!", "", " \t\x0b", "cut off", "Yes.", "ü?  \n", None, "a\nb:c.", "tail…", "No!"]
    rows = []
    for conv in range(120):
        for turn in range(conv % 9):
            h = zlib.crc32(f"{conv}/{turn}".encode())
            rows.append((conv, None if h % 23 == 0 else turn * (1 + h % 2), roles[h % 5 if conv % 3 else h % 11], texts[h // 16 % 11]))
    rows += [(None, t, "user", f"Null {t}.") for t in range(4)] + [(500, 3, "user", "Same."), (500, 3, "user", "Same."), (500, 3, "assistant", "Other."), (501, None, "user", "Alone.")]
    return rows + [(502, 0, "user", "long " * 50_000 + "."), (502, 1, "assistant", "end")]


@pytest.mark.parametrize("chunk", [conversations.CHUNK, 5])
def test_report_against_search(spark, chunk, monkeypatch):
    monkeypatch.setattr(Repair.__init__, "__defaults__", (chunk,))
    rows = table()
    original = frame(spark, rows)
    assert sorted(map(str, map(tuple, damage(original).collect()))) == sorted(map(str, broken(rows)))
    assert collected(repair_report(original, damage(original))) == brute(rows, broken(rows))


def test_conversation_over_many_chunks(spark):
    """A conversation of a third of all rows crosses chunks of seven rows; its repair is that of one search."""
    rows = [(7, t, ("user", "assistant", "user")[zlib.crc32(str(t).encode()) % 3], f"turn {t // 2}" + ".?"[: t % 3]) for t in range(200)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.") for c in range(8, 108) for t in range(4)]
    made = Repair(frame(spark, rows), chunk=7)
    want = brute(rows, rows)
    for r in made.report().collect():
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == want[r.conv_id][:7]
    got = [(r.role, r.text) for r in made.repaired().where("conv_id = 7").orderBy("k", "at").collect()]
    assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in got).encode()).hexdigest() == want[7][7]


def test_nothing_left_and_nothing_at_all(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    original = frame(spark, [(dropped, 0, "user", "Gone.")])
    assert collected(repair_report(original, damage(original))) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    empty = frame(spark, [])
    assert repair_report(empty, damage(empty)).count() == 0 and Repair(empty).repaired().count() == 0
