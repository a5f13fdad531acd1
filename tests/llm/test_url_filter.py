import math
from collections import defaultdict

from loomspark.llm import url_filter as u


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    stop = min([tail.index(c) for c in "?#" if c in tail], default=len(tail))
    return rest[:cut].translate({i: i + 32 for i in range(65, 91)}), tail[:stop]


def rule(host, path):
    fits = [(w, h + p) for w, h, p in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[1]), default=(None, None))


def fixture():
    urls = []
    for i in range(200):
        urls.append((i, f"https://w{i % 9}.example.{['net', 'com', 'org'][i % 3]}/{['en', 'de', 'fr', 'es'][i % 4]}/{i * 7}{['', '?a=1', '#x', '.html'][i % 4]}"))
    return [*urls, (300, None), (301, ""), (302, "example.net/en/"), (303, "HTTP://EXAMPLE.NET/EN/"), (304, "http://example.net"), (305, "http://net/"), (306, "x://a.net/en/?q"), (307, "http://example.net/en/x://y"), (308, "http://org/fr/"), (308, "http://org/fr/"), (None, "http://a.com/de/"), (309, "http://xexample.com/de/"), (310, "http://é.org/fr/ü\n?")]


def brute(rows):
    split = [(i, t, *parts(t)) for i, t in rows]
    judged = [(i, t, h, p, *rule(h, p)) for i, t, h, p in split]
    n = defaultdict(lambda: [0, 0])
    text = lambda url: "\x02" + (url or "") + "\x03"
    for _, url, _, _, what, _ in judged:
        if what:
            t = text(url)
            for i in range(1, len(t)):
                for k in range(1, min(i + 1, u.LONGEST) + 1):
                    n[t[i - k + 1 : i + 1]][what == "block"] += 1
    context = defaultdict(lambda: [0, 0])
    for g, (a, r) in n.items():
        c = context[g[:-1], len(g)]
        c[0] += a
        c[1] += r

    def ratio(g):
        pa, pr = ratio_p(g)
        return math.log(pa / pr)

    def ratio_p(g):
        low = (1 / u.ALPHABET,) * 2 if len(g) == 1 else ratio_p(g[1:])
        ctx = context[g[:-1], len(g)]
        return tuple((n[g][x] + u.MASS * low[x]) / (ctx[x] + u.MASS) for x in (0, 1))

    def score(url):
        t, total = text(url), 0.0
        for i in range(1, len(t)):
            seen = [t[i - k + 1 : i + 1] for k in range(1, min(i + 1, u.LONGEST) + 1) if t[i - k + 1 : i + 1] in n]
            total += ratio(seen[-1]) if seen else 0.0
        return total / (len(t) - 1)

    trained = {w: [score(t) for _, t, _, _, what, _ in judged if what == w] for w in ("allow", "block")}
    stats = {w: (sum(s) / len(s), math.sqrt(max(0, sum(x * x for x in s) / len(s) - (sum(s) / len(s)) ** 2))) for w, s in trained.items()}
    (good, a), (bad, r) = stats["allow"], stats["block"]
    threshold = (good * r + bad * a) / (a + r)
    return sorted((str(i), h, p, str(name), what or ("block" if score(t) < threshold else "allow")) for i, t, h, p, what, name in judged)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1.0, "g") for r in rows], "page_id long, url string, score double, gram string").repartition(3)


def test_against_brute_force(spark):
    got = u.judge(frame(spark, fixture())).collect()
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in got) == brute(fixture())


def test_a_joined_table_of_additions_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(u, "BROADCAST_GRAMS", 0)
    got = u.judge(frame(spark, fixture())).collect()
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in got) == brute(fixture())


def test_the_query_counts_and_urls_may_be_very_long(spark):
    """URLs that differ in the query only are judged apart; all of a URL of 200,000 characters is seen."""
    rows = [(i, f"http://h{i % 5}.net/x?casino-win={i}") for i in range(40)] + [(100 + i, f"http://example.net/en/page?read={i}") for i in range(40)]
    rows += [(200, "http://other.edu/go?casino-win=1"), (201, "http://other.edu/go?page-read=2"), (202, "no scheme casino-win="), (203, "no scheme page read="), (204, "http://other.edu/go?" + "casino-win=" * 18_000)]
    got = {r.page_id: r for r in u.judge(frame(spark, rows)).collect()}
    assert [got[i].verdict for i in range(200, 205)] == ["block", "allow", "block", "allow", "block"]
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in got.values()) == brute(rows)


def test_without_both_classes_all_open_urls_are_allowed(spark):
    got = u.judge(frame(spark, [(1, "http://a.com/x"), (2, "http://b.net/x"), (3, None)])).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in got} == {1: (None, "allow"), 2: ("net/", "block"), 3: (None, "allow")}
    assert u.judge(frame(spark, fixture()).limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    plan = u.judge(frame(spark, fixture()))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
