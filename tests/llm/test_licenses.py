import re
import time

from terrace.llm import licenses

TEXTS = [
    None, "", "...", "MIT License", "the mit   license,MIT-LICENSE mit licensed", "Apache\nLicense mit license mit license",
    "GNU General Public License, version 3. SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause\nnext",
    "émit license", "mit licenseé", "no licence", "license mit " * 500 + "license", "SPDX-License-Identifier:\nMIT", "spdx-license-identifier: Apache-2.0 WITH LLVM-exception*/",
]


def brute(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    places = [i for i, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def test_scan_against_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, "MIT License", "x")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id int, text string, labels string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(TEXTS[r.doc_id])
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    by_id = {r.doc_id: r for r in got}
    assert by_id[6].expressions == ["((mit or gpl-2.0-only) and bsd-3-clause)"] and by_id[6].permitted
    assert by_id[12].labels == "apache-2.0 with llvm-exception" and by_id[11].expressions == []
    assert licenses.scan(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_expressions():
    cases = {
        "MIT": "mit", "a or b and c": "(a or (b and c))", "(a or b) and c": "((a or b) and c)", "a with x or b": "((a with x) or b)",
        "a and b and c": "((a and b) and c)", "a or": "a", "a and (b or": "(a and b)", "((a": "a", "a) or b": "a", "a b": "a", "and a": "None", "": "None",
    }
    for text, want in cases.items():
        assert str(licenses.parse_expression(text)) == want, text
    allowed = {"mit or gpl-3.0": True, "mit and gpl-3.0": False, "gpl-2.0 with classpath": False, "(mit and isc) or gpl-3.0": True}
    for text, want in allowed.items():
        assert licenses.parse_expression(text).allowed() is want, text


def test_long_expressions_and_many_finds():
    """A million names, deep brackets and a hundred thousand finds in seconds."""
    n = 1_000_000
    start = time.time()
    many = licenses.scan_text(("SPDX-License-Identifier: " + "MIT AND " * n + "ISC").encode())
    assert many.labels >= {"mit", "isc"} and many.expressions[0].allowed() and len(str(many.expressions[0])) > 8 * n
    assert str(licenses.parse_expression("(" * 50_000 + "MIT" + ")" * 50_000)) == "mit"
    assert str(licenses.parse_expression("a or (" * 3)) == "(a or (a or a))" and str(licenses.parse_expression("a or " + "(" * 50_000)) == "a"
    nested = licenses.parse_expression("a or (" * 50_000 + "b" + ")" * 50_000)
    assert nested.names() == {"a", "b"} and str(nested).endswith("b" + ")" * 50_000)
    finds = licenses.scan_text(b"mit license " * 100_000)
    assert finds.base == list(range(0, 200_000, 2)) and finds.n_words == 200_000
    one_line = licenses.scan_text(b"spdx-license-identifier: mit " * 100_000)
    assert len(one_line.expressions) == 100_000 and one_line.labels == {"mit"}
    assert time.time() - start < 60


def test_with_stands_between_names():
    cases = {"(a or b) with (c or d)": "(a or b)", "a with (b)": "a", "a with b with c": "(a with b)", "a with b and c with d": "((a with b) and (c with d))"}
    for text, want in cases.items():
        assert str(licenses.parse_expression(text)) == want, text
    assert licenses.parse_expression("a with b or c").names() == {"a with b", "c"}
