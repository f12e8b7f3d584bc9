import re
from collections import Counter, defaultdict

import pytest

from terrace.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target string, row string, k string, `a.b` string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, "own", "own", "own", "own", "own") for d, t, s in rows], SCHEMA)


def wanted(sizes, weights=(3, 1, 2), share=1.5, limit=2.0):
    """Targets by filling the lowest level first."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(limit * sizes[s] for s in full)) / sum(w[s] for s in rest) if rest else 0
        over = {s for s in rest if w[s] * level > limit * sizes[s]}
        if not over:
            return {s: limit * sizes[s] if s in full else w[s] * level for s in names}
        full |= over


def documents():
    out = [(i, " ".join(["wörd"] * (i * 7 % 90)) + "\n\t", f"s{i % 5}") for i in range(400)]
    out += [(1000 + i, "hot " * (1 + i % 13), "hot") for i in range(900)]  # one source holds most rows
    out += [(5, "same row", "s1")] * 40 + [(6, None, "s2"), (7, "", None), (8, "a b \x0b c", None), (None, "x", ""), (9, "long " * 20_000, "s3")]
    return out


def test_targets_and_copies(spark):
    rows = documents()
    got = mixing.plan(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((d, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, _ in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = wanted(sizes)
    taken, most = defaultdict(int), defaultdict(int)
    source_of = {(d, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))): s for d, t, s in rows}
    for r in got:
        s = source_of[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-12)
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[s] += r.taken
        most[s] = max(most[s], r["size"])
    assert all(abs(taken[s] - want[s]) <= 2 * most[s] for s in sizes)
    again = mixing.plan(frame(spark, rows[::-1]).repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_is_what_was_planned(spark):
    docs = frame(spark, documents())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and {r["size"] for r in mixed.select("size").distinct().collect()} == {"own"}
    plan = Counter()
    for r in mixing.plan(docs).collect():
        plan[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.select("doc_id").collect()) == +plan


def test_no_words_and_no_rows(spark):
    assert mixing.plan(frame(spark, [])).collect() == []
    got = mixing.plan(frame(spark, [(1, "", "a"), (2, None, "b")])).collect()
    assert [(r.source_size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
    one = mixing.plan(frame(spark, [(1, "a b", "a")])).collect()[0]
    assert one.target == 3.0 and one.taken in (2, 4)


def test_limit_is_met(spark):
    # b weighs least but is large; a and c stop at twice their size.
    rows = [(1, "w " * 10, "a"), (2, "w " * 1000, "b"), (3, "w " * 10, "c")]
    got = {r.doc_id: r.target for r in mixing.plan(frame(spark, rows)).collect()}
    assert got == {1: 20.0, 2: pytest.approx(1.5 * 1020 - 40), 3: 20.0}
