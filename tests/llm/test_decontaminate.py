import hashlib
import random
import re

import pytest

from terrace.llm import decontaminate


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text, items):
    have = words(text)
    hit, ids = set(), []
    for item_id, item in items:
        w = words(item)
        size = min(len(w), 10)
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        at = [i for i in range(len(have) - size + 1) if tuple(have[i : i + size]) in windows] if size else []
        hit |= {j for i in at for j in range(i, i + size)}
        ids += [str(item_id)] * bool(at)
    return len(have), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def tables():
    rng = random.Random(9)
    vocab = ["a", "b", "the", "Ünï", "x1", "of", "日本"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([10, 11, 30, 60, 9, 5, 1, 3])]
    items += [(20, None), (21, "..."), (22, items[2][1]), (23, "z " * 40), (100, "only short words here")]
    docs = [None, "", "--", "a", say(12), "z " * 15, "Z, " * 5000, "Only SHORT; words\nhere", items[0][1].upper().replace("Ü", "Ü")]
    for _ in range(30):
        src = rng.choice(items)[1] or ""
        w = src.split()
        cut = rng.randrange(len(w) + 1) if w else 0
        docs.append(" q ".join([" ".join(f"u{rng.randrange(99)}" for _ in range(rng.randrange(20))), " ".join(w[cut : cut + 14]), say(rng.randrange(6))]))
    return items, docs


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_against_brute_force(spark, limit):
    items, docs = tables()
    rows = [(i, t, "s") for i, t in enumerate(docs)] + [(4, docs[4], "s"), (None, docs[9], "s")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, words string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contamination(frame, bench, broadcast_bytes=limit).collect()
    want = sorted((str(r[0]), *brute(r[1], items)) for r in rows)
    assert sorted((str(r[0]), *r[1:]) for r in got) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    bench = spark.createDataFrame([], "item_id bigint, text string")
    row = decontaminate.contamination(docs, bench).first()
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)
    assert decontaminate.contamination(docs.limit(0), spark.createDataFrame([(1, "a b")], bench.schema)).count() == 0


def test_clean_keeps_whole_rows_without_hits(spark):
    items, docs = tables()
    rows = [(i, t, "s") for i, t in enumerate(docs)] + [(4, docs[4], "s"), (None, docs[9], "s")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, words string")
    got = decontaminate.clean(frame, spark.createDataFrame(items, "item_id bigint, text string"))
    assert got.columns == frame.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(r) for r in rows if not brute(r[1], items)[4])
    assert decontaminate.clean(frame, spark.createDataFrame([], "item_id bigint, text string")).count() == len(rows)
