from terrace.llm import queries, urls

RULES = queries.URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    for c in "?#":
        tail = tail.split(c, 1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail


def best(host, path):
    fits = [(len(r), r, v) for v, r in RULES for d, _, p in [r.partition("/")] if (host == d or host.endswith("." + d)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme", "http://", "http://A.Example.COM/en/7?x#y", "https://example.com/en/70", "https://xexample.com/en/7",
    "http://com/en/", "http://com/En/1", "http://a.net/de/1", "http://example.net/de/8", "http://b.example.net/de/81#t", "http://a.org/es/", "http://a.org?es/",
    "http://É.ORG/es/ü", "x://y://z/en/", "http://a.com:80/en/\nb", "http://q.com/fr/3", "http://a.example.net/de/7", "http://a.example.net/de/7",
] + [f"http://h{i}.example.com/en/{i}" for i in range(30)] + [f"http://h{i}.example.net/de/{i}" for i in range(30)]


def test_rules_hosts_and_paths(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id int, url string, host string, score string"), RULES).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = parts(u)
        rule, verdict = best(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict or verdict is None and got[i].verdict in ("allow", "block")
        assert 0 <= got[i].score <= 1


def test_regression_learns_from_a_labelled_table(spark):
    good = [(f"http://news{i}.example.org/story/{i}", 1) for i in range(120)]
    bad = [(f"http://casino{i}.example.org/win-cash/{i}", 0) for i in range(120)]
    labelled = spark.createDataFrame(good[:80] + bad[:80], "url string, allow int")
    held = good[80:] + bad[80:]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(held)], "page_id int, url string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, (), labelled).collect()}
    assert all(got[i] == ("allow" if a else "block") for i, (_, a) in enumerate(held))


def test_nothing_to_learn_from(spark):
    pages = spark.createDataFrame([(1, "http://a.example.org/x"), (2, None)], "page_id int, url string")
    assert [r.verdict for r in urls.judge(pages, ()).collect()] == ["allow", "allow"]
    assert urls.judge(pages.limit(0), RULES).count() == 0
