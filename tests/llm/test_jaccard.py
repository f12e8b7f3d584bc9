import random

import corpus_pipeline
import pytest

from terrace.llm import jaccard


def brute(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def kept(rows):
    """Smallest ids of the groups, by comparing all pairs."""
    sets, label = [brute(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return {min(rows[i][0] for i in range(len(rows)) if label[i] == g) for g in set(label)}


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    out = [None, "", " \n", "one", "One", "a b c d", "A B  C d"]
    for _ in range(15):
        base = [rng.choice(words) for _ in range(rng.choice([40, 150, 400]))]
        for edits in (0, 0.01, 0.02, 0.03):  # each changed word changes five shingles
            out.append(" ".join(rng.choice(words) if rng.random() < edits else w for w in base))
    base = [rng.choice(words) for _ in range(200)]
    for _ in range(40):  # near copies of one text, mostly not of each other
        copy = list(base)
        for at in rng.sample(range(0, 200, 10), 3):
            copy[at] = rng.choice(words)
        out.append(" ".join(copy))
    out.append(" ".join(base))
    return out


@pytest.mark.parametrize(("paired", "block"), [(16, 1_000_000), (2, 900), (10**6, 1)])
def test_stage_against_brute_force(spark, monkeypatch, paired, block):
    monkeypatch.setattr(jaccard, "PAIRED", paired)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
    rows = [(i * 7 % 211, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, node string")
    got = corpus_pipeline.near_duplicate_stage(spark, df, "").collect()
    assert {r.doc_id for r in got} == kept(rows) and len(got) == len(kept(rows))
    assert all((r.doc_id, r.text) in rows and r.node == "x" for r in got)


def test_rows_without_id_repeats_and_empty_table(spark):
    rows = [(None, "one two"), (None, "ONE two"), (3, "x y z"), (None, "x y z"), (3, "x y z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r) for r in jaccard.deduplicate(df).collect()]
    assert len(got) == 2 and (3, "x y z") in got
    assert jaccard.deduplicate(df.limit(0)).count() == 0


def test_fingerprints_alone_find_the_closest_copies(spark, monkeypatch):
    """Without any band the stage still joins texts whose SimHash fingerprints are at most four bits apart."""
    monkeypatch.setattr(jaccard, "_band_members", lambda nodes: nodes.selectExpr("0L value", "node", "n", "0L size").limit(0))
    rng = random.Random(5)
    rows = []
    for i in range(6):
        words = [rng.choice("abcdefghij") + str(rng.randrange(900)) for _ in range(1500)]
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join([*words, "last"])), (10 * i + 2, " ".join(words[::-1]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()}
    assert got == {i for i, _ in rows if i % 10 != 1} == kept(rows)
