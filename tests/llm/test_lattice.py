import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from terrace.llm import lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(word, vocab):
    if not word:
        yield ()
    for j in range(1, len(word) + 1):
        if word[:j] in vocab:
            for rest in segmentations(word[j:], vocab):
                yield (vocab[word[:j]], *rest)


def test_forward_is_the_sum_over_segmentations():
    made = lattice.pieces_of(PATH)
    vocab = {w: i for w, (_, i) in made.automaton.items()}
    logs = np.log(made.prior + 1e-300).tolist()
    for word in ("the", "reading", "naïve", "a", "zzz"):
        each = [sum(logs[i] for i in s) for s in segmentations(lattice.SPACE + word, vocab)]
        want = math.log(sum(math.exp(x) for x in each))
        ends = made.arcs(word)
        assert lattice.forward(ends, logs)[-1] == pytest.approx(want)
        got, expect = np.zeros(made.n), Counter()
        lattice.expected_counts(ends, logs, got, 2.0)
        for s, x in zip(segmentations(lattice.SPACE + word, vocab), each):
            for i in s:
                expect[i] += 2 * math.exp(x - want)
        assert {int(i) for i in np.flatnonzero(got)} == set(expect)
        assert all(got[i] == pytest.approx(v) for i, v in expect.items())
    assert math.isfinite(lattice.forward(made.arcs("\U0001F9FF" + "q" * 3000), logs)[-1])


def corpus():
    rng = random.Random(6)
    parts = ["the", "ing", "re", "on", "at", "ly", "ou", "né"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(1, 4)))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(200)]
    return [*rows, (300, None), (301, ""), (302, "THE \x0bthe THE"), (303, "x" * 5000), (304, "ing " * 9000), rows[3]]


def fitted(counts, texts):
    """Log weights of the pieces by plain expectation maximisation over all words."""
    made = lattice.pieces_of(PATH)
    prior = np.append(made.prior * lattice.PRIOR_PIECES, 1.0)
    sums = np.append(np.zeros(made.n), float(texts))
    for step in range(lattice.ROUNDS + 1):
        with np.errstate(divide="ignore"):
            logs = np.log((sums + prior) / (sums + prior).sum()).tolist()
        if step < lattice.ROUNDS:
            sums = np.append(np.zeros(made.n), float(texts))
            for word, n in counts.items():
                if word is not None:
                    lattice.expected_counts(made.arcs(word.decode(errors="replace")), logs, sums, n)
    return logs


@pytest.mark.parametrize("share", [20, 200_000])
def test_scores_against_brute_force(spark, share):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, score int")
    got = sorted(lattice.score(docs, PATH, sent_share=share).collect(), key=lambda r: (r.doc_id, r.n_tokens))
    tokens = [((t or "").encode().lower().split() + [None], zlib.crc32(str(i).encode()) % 7 == 2, i) for i, t in rows]
    counts = Counter(w for ws, out, _ in tokens if not out for w in ws)
    n, v = sum(counts.values()), len(counts)
    tokens.sort(key=lambda x: (x[2], len(x[0])))
    assert len(got) == len(rows)
    made, logs = lattice.pieces_of(PATH), fitted(counts, sum(not out for _, out, _ in tokens))
    own = lambda w: (logs[-1] if w is None else lattice.forward(made.arcs(w.decode(errors="replace")), logs)[-1]) / math.log(10)
    for r, (ws, out, i) in zip(got, tokens):
        assert (r.doc_id, r.held_out, r.n_tokens, r.train_tokens) == (i, out, len(ws), n)
        assert r.n_known == sum(counts[w] > 0 for w in ws)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        assert r.score == pytest.approx(sum(own(w) for w in ws))
    # The model learned: held-out prose is likelier under it than under the prior alone.
    prior = {(r.doc_id, r.n_tokens): r.score for r in lattice.score(docs, PATH, sent_share=share, rounds=0).collect()}
    held = [r for r in got if r.held_out and r.doc_id < 200]
    assert sum(r.score for r in held) > sum(prior[r.doc_id, r.n_tokens] for r in held)


def test_empty_table(spark):
    assert lattice.score(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0


def test_expected_counts_by_products_and_in_logs():
    import numpy as np
    import public_tokenizers

    made = lattice.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    logs = np.log(np.maximum(made.prior, 1e-12)).tolist()
    chances = [math.exp(x) for x in logs]
    for word in ("a", "reading", "Ünï日本", "q" * 400, "\u0007x", ""):
        a, b = [0.0] * made.n, [0.0] * made.n
        lattice.add_expected(made.arcs(word), chances, logs, a, 3.0)
        lattice.expected_counts(made.arcs(word), logs, b, 3.0)
        assert np.allclose(a, b, rtol=1e-9, atol=1e-12)


def test_words_of_known_characters_make_no_arcs(monkeypatch):
    """Words whose characters are all pieces are counted and scored from the automaton's matches alone, with the same results."""
    made = lattice.pieces_of(PATH)
    logs = np.log(np.maximum(made.prior, 1e-12)).tolist()
    chances = [math.exp(x) for x in logs]
    words = ("a", "reading", "Ünï日本", "q" * 400, "\u0007x", "\U0001F9FF", "")
    want = []
    for word in words:
        out = np.zeros(made.n)
        lattice.expected_counts(made.arcs(word), logs, out, 3.0)
        want.append((lattice.forward(made.arcs(word), logs)[-1], out))
    made_arcs, arcs = [], made.arcs
    monkeypatch.setattr(made, "arcs", lambda word: made_arcs.append(word) or arcs(word))
    for word, (log, counts) in zip(words, want):
        out = [0.0] * made.n
        lattice.add_word(made, word, chances, logs, out, 3.0)
        assert np.allclose(out, counts, rtol=1e-9, atol=1e-12)
        assert lattice.log_chance(made, word, chances, logs) == pytest.approx(log, rel=1e-12)
    assert "reading" not in made_arcs and "\U0001F9FF" in made_arcs
