import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from terrace.llm import spelling


def is_near(a, b):
    """Exactly one inserted, deleted or replaced code point, letter by letter."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, slip=97):
    seen = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    n = {w: c for w, c in seen.items() if len(w) >= 5 and c >= 3}
    form, count = {}, {}
    for w in n:
        close = [v for v in n if is_near(w, v)]
        count[w] = len(close)
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return out


def got(frame, slip=97):
    rows = spelling.group(frame, slip=slip).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(rows) == len({r.word for r in rows})
    return set(map(tuple, rows))


def corpus():
    base = ["colour", "color", "colours", "coloured", "aaaaab", "aaaaaab", "aaaab", "Straße", "strasse", "ÀRGER", "àrger", "arger", "naïve", "naive", "letter", "better", "setter", "bettter"]
    rows = [(i, " ".join(base[j] for j in range(len(base)) if (i * 31 + j * 17) % (j + 2) == 0)) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "1234 -- ×÷×÷× ×÷×÷× ×÷×÷×"), (203, "colour " * 20_000), (None, "better " * 50), (3, "Same ROW repeated"), (3, "Same ROW repeated"), (3, "same row repeated")]
    # A chain of forms, each with twice the count of the one before.
    chain = ["abcdefgh"[: 8 - i] for i in range(4)]
    return rows + [(300 + i, " ".join([w] * (3 * 2**i))) for i, w in enumerate(chain)]


def test_against_brute_force(spark):
    rows = corpus()
    frame = spark.createDataFrame([(d, t, "own", "own", "own") for d, t in rows], "doc_id long, text string, word string, n string, `a.b` string")
    assert got(frame) == brute(rows)
    assert got(frame, None) == brute(rows, None)
    found = {r[0]: r for r in got(frame, None)}
    assert found["abcdefgh"][2] == "abcde" and found["abcdefgh"][1] == "abcdefg"


def test_empty(spark):
    assert spelling.group(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=6, deadline=None)
@given(st.dictionaries(st.text("abÿ", min_size=5, max_size=8), st.integers(1, 40), max_size=60))
def test_vocabulary(spark, counts):
    frame = spark.createDataFrame([(w, n) for w, n in counts.items()], "word string, n long")
    want = brute([(i, " ".join([w] * n)) for i, (w, n) in enumerate(counts.items())], None) if counts else set()
    have = {tuple(r) for r in spelling.variants(frame.where("n >= 3")).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert have == want


def test_slips_hit_runs_as_specified(spark):
    rows = [(i, f"wordwordword{'abc'[i % 3]} x") for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(r.word for r in spelling.runs(frame).collect() if len(r.word) < 13 and r.word not in ("x", "")) == Counter(
        run[: h % 13] + run[h % 13 + 1 :] for d, t in rows for run in [t[:13]] for h in [zlib.crc32(f"{d}:{run}".encode())] if h % 97 == 0
    )
