import random

import numpy as np
import xxhash
from pyspark.sql import types as T

from terrace.llm import simhash


def brute(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, fps):
    label = dict(zip(range(len(ids)), range(len(ids))))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                label[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(i)
    return {i: min((ids[k] for k in g if ids[k] is not None), default=None) for g in groups.values() for i in g}


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["Ünï", "日本"]
    out = [None, "", " \t\n", "one", "One TWO", "a b c d", "A B C\x0bD", "word " * 3000]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([5, 60, 300]))]
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out


def test_fingerprint_is_the_definition():
    for t in texts():
        assert simhash.fingerprint_of(t.encode() if t is not None else None) == brute(t)


def test_near_duplicates_against_brute_force(spark):
    rows = [(i * 3 % 61, t, "x", 1) for i, t in enumerate(texts())] + [(None, "one", "x", 2)]
    schema = "doc_id bigint, text string, fp string, component_id int"
    got = simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    fps = [brute(r[1]) for r in rows]
    want = components([r[0] for r in rows], fps)
    expect = sorted((str(r[0]), f"{fps[i]:016x}", want[i]) for i, r in enumerate(rows))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == expect


def test_links_same_with_and_without_the_second_table(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**62), 2**62, 6)
    fps = {int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 9), replace=False)) for b in base for _ in range(30)}
    df = spark.createDataFrame([(f,) for f in fps], T.StructType([T.StructField("fp", T.LongType())]))
    ids = sorted(fps)
    for bound in (1, 3, 2048):
        found = {(r.src, r.dst) for r in simhash.links(df, pair_bucket=bound).collect()}
        assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 4 for a, b in found)
        want = components(ids, [f & (2**64 - 1) for f in ids])
        got = {f: f for f in ids}
        for _ in ids:
            for a, b in found:
                got[a] = got[b] = min(got[a], got[b])
        assert [got[f] for f in ids] == [want[i] for i in range(len(ids))]


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_deduplicate_keeps_one_row_of_each_group(spark):
    rows = [(i * 3 % 61, t, "x", 1) for i, t in enumerate(texts())] + [(None, "one", "x", 2), (0, None, "again", 3), (None, "alone at last", "x", 4)]
    schema = "doc_id bigint, text string, fp string, _hash int"
    got = simhash.deduplicate(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", "fp", "_hash"]
    fps = [brute(r[1]) for r in rows]
    want = components([r[0] for r in rows], fps)
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted({i: str(want[i]) for i in range(len(rows))}[i] for i in {want[i]: i for i in want}.values())
    assert simhash.deduplicate(spark.createDataFrame([], schema)).count() == 0
