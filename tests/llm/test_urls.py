import random
import re

from semloom.llm import urls


def brute(pages):
    keys, own, group = [], [], {}
    for page_id, url, html in pages:
        m = re.search(r"://([^/?#]*)([^?#]*)(?:\?([^#]*))?", url or "")
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]) if m else ""
        path = m[2] if m else ""
        fits = [(h + p, a) for a, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        own.append((host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, None))))
    return own


PAGES = [
    (1, "https://www.example.org/es/1", None), (2, "http://a.example.net/x", '<link rel="canonical" href="https://example.org/es/1">'),
    (3, "http://m.a.example.net/x/?utm_source=f#top", ""), (4, "http://a.example.net/x?page=2", ""),
    (5, "http://b.net/y", '<META HTTP-EQUIV="refresh" CONTENT="0; url=/z">'), (6, "https://b.net/z", '<link href="http://x.com/de/7" rel=canonical>'),
    (7, "http://c.net/q", '<link rel="canonical" href="http://x.com/de/8">'), (8, "http://d.net/q", '<link rel="canonical" href="http://c.net/q">'),
    (9, "http://e.net/", '<link rel="canonical" href="http://d.net/q">'), (10, "https://t.x.com/fr/1", '<link rel="canonical" href="http://d.net/q">'),
    (11, "http://COM/de/", ""), (12, "http://xcom/de/", ""), (13, "http://example.org", ""), (14, "http://example.org/en/1", ""), (15, "nothing", "x"),
    (16, None, None), (None, "http://b.net/y", None), (1, "https://www.example.org/es/1", None), (17, "a://b://c.com/de/?x", ""), (18, "", ""),
]


def test_rules_and_aliases(spark):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, rule string").repartition(3)
    rules = spark.createDataFrame(urls.RULES, "action string, host string, path string")
    got = urls.judge(df, rules).collect()
    want = brute(PAGES)
    assert sorted((r.page_id, r.host, r.path, r.rule) for r in got if r.page_id) == sorted((p[0], *w[:3]) for p, w in zip(PAGES, want) if p[0])
    verdict = {r.page_id: r.verdict for r in got}
    assert all(verdict[p[0]] == w[3] for p, w in zip(PAGES, want) if p[0] and w[3])
    assert [verdict[k] for k in (2, 3, 4, 5, 6, None)] == ["block", "block", "allow", "block", "block", "block"]
    assert [verdict[k] for k in (7, 8, 9, 10)] == ["allow"] * 4  # page 10 has an explicit allow and is joined to them
    assert [verdict[k] for k in (12, 13, 15, 16, 18)] == ["allow"] * 5
    more = spark.createDataFrame([("http://lone.net/", "http://x.com/de/1"), (None, "http://x.com/")], "src string, dst string")
    lone = spark.createDataFrame([(1, "https://www.lone.net", None)], "page_id long, url string, html string")
    assert urls.judge(lone, rules, more).first().verdict == "block"
    assert urls.judge(df.limit(0), rules).count() == 0


def alias(url):
    """Where all rewrites of a URL end, and every step before."""
    m = re.search(r"://([^/?#]*)([^?#]*)(?:\?([^#]*))?", url)
    if not m or not m[1]:
        return []
    host, path, query = m[1].lower(), m[2], m[3] or ""
    steps, bare = [url], re.sub(r"^(www|m)\.", "", host)
    kept = "&".join(sorted(p for p in query.split("&") if p and not re.match(r"(utm_[^=]*|ref|fbclid|gclid)(=|$)", p)))
    file = re.sub(r"/index(\.[a-z]+)?$|\.html?$", "", path)
    for h, p, q in ((host, path, query), (bare, path, query), (bare, path, kept), (bare, file, kept), (bare, file.rstrip("/"), kept)):
        steps.append(f"https://{h}{p}{'?' if q else ''}{q}")
    return steps


def test_verdicts_against_union_find(spark):
    rng, hosts = random.Random(4), ["example.org", "www.example.org", "a.net", "m.a.net", "b.net", "B.net", "x.com", "t.x.com", *(f"{w}h{k}.net" for k in range(40) for w in ("", "www."))]
    paths = ["", "/", "/es/1", "/en/1", "/q", "/q/", "/q.html", "/q/index.html", "/de/2", "/fr/2", "/z?ref=1&b=2&a=1", "/z?a=1&b=2#top"]
    url = lambda: rng.choice(["http", "https"]) + "://" + rng.choice(hosts) + rng.choice(paths)
    pages, redirects = [], []
    for i in range(240):
        own, to, kind = url(), url(), rng.randrange(12)
        html = {0: f'<link rel="canonical" href="{to.replace("&", "&amp;")}">', 1: f"""<meta http-equiv="refresh" content="0; url='{to}'">"""}.get(kind, "")
        edges = [to] if html else []
        if kind == 0 and i % 3 == 0:  # a second link counts too
            more = url()
            html, edges = html + f"<LINK href='{more}' rel=canonical>", [*edges, more]
        pages.append((i, own, html))
        redirects += [(own, e) for e in edges]
    for k in range(5):  # blocked by a link, one alias further
        to = f"https://x.com/de/{k + 10}"
        pages += [(500 + k, f"http://lone{k}.net/p.html", f'<link rel="canonical" href="{to}">'), (600 + k, f"https://www.lone{k}.net/p/", "")]
        redirects.append((f"http://lone{k}.net/p.html", to))
    given = [(url(), url()) for _ in range(6)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    nodes = {u for _, u, _ in pages} | {u for e in redirects + given for u in e}
    for a, b in [e for u in nodes for e in zip(alias(u), alias(u)[1:])] + redirects + given:
        root[find(a)] = find(b)
    action = {u: brute([(0, u, None)])[0][3] for u in nodes}
    votes = {}
    for u in nodes:
        votes.setdefault(find(u), set()).add(action[u])
    want = {i: action[u] or ("allow" if "allow" in votes[find(u)] or "block" not in votes[find(u)] else "block") for i, u, _ in pages}
    rules = spark.createDataFrame(urls.RULES, "action string, host string, path string")
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules, spark.createDataFrame(given, "src string, dst string")).collect()
    assert {r.page_id: r.verdict for r in got} == want and len(got) == len(pages)
    assert {want[i] for i, u, _ in pages if not action[u]} == {"allow", "block"}


def test_longest_rule_against_brute_force_with_many_rules_on_a_suffix(spark):
    rng = random.Random(9)
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab/", "/a/b/c", "/a//", "no/slash", "/\n/x"]
    hosts = ["com", "x.com", "y.x.com", "org", "xcom", "", "a..com"]
    rules = [*{(rng.choice(["allow", "block"]), rng.choice(hosts[:5]), rng.choice(paths)) for _ in range(30)}]
    rules += [("block", "com", f"/many/{k}/") for k in range(300)]
    places = [(h, p + rng.choice(["", "x", "/q"])) for h in hosts for p in paths] + [(f"h{k}.com", f"/many/{k}/page") for k in range(400)]
    places += places[:20]
    table = spark.createDataFrame([(*p, k) for k, p in enumerate(places)], "host string, path string, n int").repartition(3)
    known = spark.createDataFrame(rules, "action string, host string, path string")
    want = {}
    for k, (h, p) in enumerate(places):
        fits = [(-len(r[1] + r[2]), r[1] + r[2], r[0]) for r in rules if h and (h == r[1] or h.endswith("." + r[1])) and p.startswith(r[2])]
        want[k] = min(fits)[1:] if fits else (None, None)
    for most in (1 << 20, 0):
        got = urls.ruled(table, known, most).collect()
        assert len(got) == len(places)
        assert {r.n: (r.rule, r.action) for r in got} == want
