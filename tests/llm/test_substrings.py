import hashlib
import random

import numpy as np
import pytest

from terrace.llm import substrings


def brute(rows):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 12 if i is not None else 0):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows():
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(400)}"
    passages = [[word() for _ in range(n)] for n in (12, 13, 14, 20, 60)]
    out = [(90, None), (91, ""), (92, "a b\tc"), (3, "x " * 60), (7, "x " * 13), (8, "x " * 12), (9, "é ü " * 20), (None, " ".join(passages[4]))]
    for i in range(40):
        text = []
        for _ in range(rng.randrange(1, 5)):
            text += [word() for _ in range(rng.randrange(12))] + rng.choice(passages)
        out.append((100 - i if i % 2 else 200 + i, " \n".join(text)))
    out += [(500, out[20][1]), (501, out[20][1]), (1, out[21][1]), out[22], (out[23][0], out[24][1]), (502, "a b\tc")]
    return out


@pytest.mark.parametrize(("bits", "hot", "size"), [(28, 5000, 10**8), (6, 3, 0)])
def test_against_brute_force(spark, bits, hot, size):
    data = [(i, t, "s", 1) for i, t in rows()]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, mark string, start int")
    got = substrings.remove_repeats(docs, table_bits=bits, hot_rows=hot, sent_bytes=size).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows())
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_equal_windows_share_an_anchor():
    for i in range(substrings.PERIOD):
        for j in range(substrings.PERIOD):
            assert any((i + d) % substrings.PERIOD in substrings.COVER and (j + d) % substrings.PERIOD in substrings.COVER for d in range(substrings.PERIOD))
    words = np.arange(1, 40, dtype=np.uint64)
    assert len(substrings.grams(words, 13)) == 27 and len(substrings.grams(words, 50)) == 0


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
