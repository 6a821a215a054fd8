from tidewatch.llm import url_filter as U
from tidewatch.llm.queries import URL_FILTER


def judged(spark, urls):
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    return {r.url if r.url is not None else "": r for r in U.judge(rows, URL_FILTER).collect()}


def test_rules(spark):
    r = judged(spark, ["http://A.Example.NET/en/x?q", "http://example.net/fr/", "https://x.example.com/de/1", "http://foo.org/fr/", "http://net/", "http://net", "http://notexample.net/en/", "http://example.netx/en/", None, "noscheme", "http://x.org/FR/", "x://b.net/#en"])
    get = lambda u: (r[u].host, r[u].path, r[u].rule, r[u].verdict)
    assert get("http://A.Example.NET/en/x?q") == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert get("http://example.net/fr/") == ("example.net", "/fr/", "net/", "block")
    assert get("https://x.example.com/de/1")[2:] == ("example.com/de/", "block")
    assert get("http://foo.org/fr/")[2:] == ("org/fr/", "allow")
    assert get("http://net/")[2:] == ("net/", "block") and get("http://net")[1:3] == ("", None)
    assert get("http://notexample.net/en/")[2:] == ("net/", "block") and get("http://example.netx/en/")[2] is None
    assert get("") == ("", "", None, "allow") and get("noscheme") == ("", "", None, "allow")
    assert get("http://x.org/FR/")[2] is None and get("x://b.net/#en")[1:3] == ("/", "net/")


def test_rejected_examples_are_told_apart(spark):
    good = [f"http://{w}.example.com/en/{i}" for w in ("garden", "river", "mountain", "library", "museum", "school", "forest", "village") for i in (1, 22, 333)]
    bad = [f"http://{w}.example.com/win/{i}" for w in ("casino-win", "free-bets", "cheap-pills", "casino-bonus", "poker-bets", "pills-online") for i in (1, 22, 333)]
    r = judged(spark, good + bad)
    assert sum(r[u].verdict == "allow" for u in good) >= 22 and sum(r[u].verdict == "block" for u in bad) >= 14


def test_empty(spark):
    assert U.judge(spark.createDataFrame([], "page_id long, url string"), URL_FILTER).count() == 0


def brute_scores(urls, f):
    """Score of each url by models that the same formulas make of the urls of other folds, from dictionaries."""
    import math
    import re
    from collections import Counter

    strange = re.compile(f"[^{U.ALPHABET.replace('-', '')}-]")
    shape = lambda u: strange.sub("*", re.sub("[0-9]", "0", u.split("://", 1)[1].lower())) + "$"
    term = re.compile(f"(^|[^a-z])({'|'.join(f.reject_terms)})([^a-z]|$)")
    return shape, term, Counter, math


def test_scores_against_brute_force(spark):
    import re

    words = "garden river mountain library museum school forest village casino-win free-bets cheap-pills poker-bets spam-farm".split()
    urls = [f"http://{w}.example.com/{p}/{i}{q}" for w in words for p in ("en", "fr") for i, q in ((1, ""), (22, "?page=2"), (333, "#top"), (1, ""))]
    urls += ["http://quiet.example.org/?to=http://casino.example", "http://quiet.example.org/a"]
    f = URL_FILTER
    shape, term, Counter, math = brute_scores(urls, f)
    got = {r.url: r.score for r in U.judge(spark.createDataFrame([(u,) for u in urls], "url string"), f).collect()}
    n = Counter(map(shape, urls))
    hosts = {re.match("[^/?#]*", s)[0] for s in n}
    fold = {r.h: r.f for r in spark.createDataFrame([(h,) for h in hosts], "h string").selectExpr("h", f"pmod(xxhash64(h), {f.folds}) AS f").collect()}
    kind = {s: True if term.search(re.match("[^?#]*", s)[0]) else None if term.search(s) else False for s in n}
    k = f.longest_context
    for s in n:
        own = fold[re.match("[^/?#]*", s)[0]]
        counts = {b: Counter() for b in (True, False)}
        for t in n:
            if kind[t] is not None and fold[re.match("[^/?#]*", t)[0]] != own:
                x = "^" * k + t
                for i in range(k, len(x)):
                    for o in range(k + 1):
                        counts[kind[t]][o, x[i - o : i + 1]] += n[t]
                        counts[kind[t]][o, x[i - o : i], None] += n[t]
        total, x = 0.0, "^" * k + s
        for i in range(k, len(x)):
            p = {b: 1 / (len(U.ALPHABET) + 3) for b in counts}
            for o in range(k + 1):
                seen = {b: counts[b][o, x[i - o : i], None] for b in counts}
                # a gram that no example of any fold holds is in no model: the shorter one stands
                if sum(seen.values()) >= f.seen_often and any(kind[t] is not None and x[i - o : i + 1] in "^" * k + t for t in n):
                    p = {b: (counts[b][o, x[i - o : i + 1]] + f.smoothing * p[b]) / (seen[b] + f.smoothing) for b in counts}
            total += math.log(p[False]) - math.log(p[True])
        for u in urls:
            if shape(u) == s:
                assert abs(got[u] - total / len(s)) < 2e-6, u


def test_bad_hosts_that_no_seed_names(spark):
    """Held-out words: the seeds are casino, pills and bets, the method finds farms and trackers by itself."""
    from dataclasses import replace

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    few = replace(URL_FILTER, rules=(), reject_terms=("casino", "pills", "bets"))
    rows = U.judge(pages, few).collect()
    unnamed = [r for r in rows if "spam-farm" in r.host or "ads-track" in r.host]
    clean = [r for r in rows if "-" not in r.host]
    assert len(unnamed) > 40 and sum(r.verdict == "block" for r in unnamed) >= 0.9 * len(unnamed)
    assert sum(r.verdict == "block" for r in clean) <= 0.01 * len(clean)
    assert not any(r.verdict == "block" for r in U.judge(pages, replace(few, reject_terms=())).collect())  # without seeds: no model


def test_clashing_names_long_urls_and_repeated_rows(spark):
    rows = [("http://a.example/" + "x" * 20_000, "mine", "too", "it")] * 2 + [("http://b.example/1?" + "casino" * 3000, "mine", "too", "it"), (None, None, None, None)]
    got = U.judge(spark.createDataFrame(rows, "url string, shape string, _shape string, _said string"), URL_FILTER).collect()
    assert len(got) == 4 and {(r["shape"], r["_shape"], r["_said"]) for r in got} == {("mine", "too", "it"), (None, None, None)}
