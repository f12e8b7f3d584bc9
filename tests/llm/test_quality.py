import random
import zlib

from terrace.llm import quality


def corpus():
    rng = random.Random(2)
    words = ["the", "river", "and", "valley", "stone", "light", "under", "quiet", "morning", "house"]
    out = []
    for i in range(400):
        good = i % 2
        n = rng.randrange(20, 300)
        text = " ".join(rng.choice(words) for _ in range(n)) if good else " ".join(rng.choice("$%#&") * 3 + rng.choice(words)[:3] for _ in range(n))
        out.append((i, text, good))
    return out


def test_learns_and_holds_out(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (902, "the river " * 20000, "x")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(7000, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, labels, docs_per_class=100)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [(i, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].predicted == q for i, q in held) >= 0.95 * len(held)
    # Labels held out change nothing: training on others' labels alone gives the same model.
    wrong = labels.where(~quality.held_out(labels.doc_id)).union(spark.createDataFrame([(i, 1 - q, 0) for i, q in held], labels.schema))
    assert quality.train(docs, wrong, docs_per_class=100) == model


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a")], "doc_id bigint, text string")
    model = quality.train(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert [(r.score, r.predicted) for r in quality.score(docs, model).collect()] == [(0.5, 0)] * 2
    assert quality.score(docs.limit(0), model).count() == 0


def test_repeated_ids_and_ties(spark):
    """Rows that share an id or a text change neither the bound of the sample nor the result between runs."""
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1, rows[1][1])] * 700 + [(i + 1000, rows[1][1]) for i in range(50)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(i + 1000, 1, 0) for i in range(50)], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, labels, docs_per_class=60)
    assert model == quality.train(docs.repartition(7), labels.repartition(3), docs_per_class=60)
    got = quality.score(docs, model).collect()
    assert len(got) == 1150 and len({(r.score, r.predicted) for r in got if r.text == rows[1][1]}) == 1


def test_whole_sample_makes_the_dictionary(spark):
    """A long text gives all of its blocks: what stands only at its middle is known to the dictionary."""
    rng = random.Random(3)
    filler = lambda n: " ".join(f"{rng.randrange(10**9)}" for _ in range(n))
    motto = " ".join(f"motto{rng.randrange(10**9)}" for _ in range(60))
    rows = [(i, f"{filler(700)} {motto} {filler(700)}" if i % 2 else filler(300), i % 2) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    model = quality.train(docs, spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id bigint, quality int, toxic int"))
    one, other = quality.differences([motto.encode(), filler(60).encode()], model.compressors())
    assert one > other
