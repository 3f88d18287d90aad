import random

from sectorlake.llm import url_rules


def judge(url, rules, default):
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def test_against_brute_force(spark):
    rng = random.Random(5)
    labels = ["a", "b", "ab", "org", "com", ""]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice(["/", "x", "xy", "/x"]) for _ in range(rng.randint(0, 4)))
    rules = [(rng.choice(["allow", "block"]), host().strip(".") or "a", "/" + path()) for _ in range(60)] + [("allow", "org", "/")]
    urls = [None, "", "no scheme", "http://", "HTTP://ORG", "http://org?x://y", "s://a#/b", "x://a\nb.org/é", *[f"http://{host()}{path()}{rng.choice(['', '?q', '#f'])}" for _ in range(600)]]
    urls += ["http://b.a.org/x"] * 400  # one host holds much of the table
    rows = [(i % 950 if i % 97 else None, u, "<html>", "k", 1) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, key string, bucket int")
    got = sorted(((r["page_id"] is None, r["page_id"] or 0, r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in url_rules.apply_rules(pages, rules, "block", buckets=7).collect()))
    want = sorted((p is None, p or 0, *(x or "" for x in judge(u, rules, "block"))) for p, u, *_ in rows)
    assert got == want


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert url_rules.apply_rules(pages, [("allow", "org", "/")]).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/")], "page_id bigint, url string")
    assert [tuple(r) for r in url_rules.apply_rules(one, []).collect()] == [(1, "a.org", "/", None, "allow")]


def test_many_paths_of_one_host_and_long_urls(spark):
    rng = random.Random(6)
    rules = [(rng.choice(["allow", "block"]), "big.org", f"/p{i}/") for i in range(100_000)] + [("allow", "org", "/p77"), ("block", "a.big.org", "/"), ("block", "big.org", "/p5/x/" + "y" * 5000)]
    known = {(h, p): v for v, h, p in rules}
    urls = [f"http://{rng.choice(['big.org', 'a.big.org', 'x.org'])}/p{rng.randrange(120_000)}/{rng.choice(['', 'z', 'q/r'])}" for _ in range(5000)]
    urls += ["http://big.org/p5/x/" + "y" * n for n in (4999, 5000, 200_000)] + ["http://" + "a." * 20_000 + "org/p77" + "z" * 100_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.apply_rules(pages, rules, "allow", buckets=4).collect()}

    def longest(url):
        host, _, path = url.split("://")[1].partition("/")
        hosts = [h for h in ("a.big.org", "big.org", "org") if host == h or host.endswith("." + h)]
        fits = [(len(h) + n, len(h), h, ("/" + path)[:n]) for h in hosts for n in (1, *range(4, min(12, len(path) + 2)), 5006) if (h, ("/" + path)[:n]) in known]
        best = max(fits, default=None)
        return (best[2] + best[3], known[best[2:]]) if best else (None, "allow")

    assert got == {i: longest(u) for i, u in enumerate(urls)}
