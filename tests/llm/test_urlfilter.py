from genoframe.llm import queries, urlfilter

RULES = queries.URL_RULES


def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]


def plain_rule(host, path):
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=None)


URLS = [None, "", "no scheme/en/", "http://com/en/x", "https://A.Example.COM/en/7?x", "http://example.com/en/8#y", "http://notexample.com/en/7", "http://xcom/en/", "http://b.net/de/8", "http://example.net/de/81", "http://q.org?x=/es/", "http://q.org/es/", "x://y://com/en/", "http://É.com/en/\nz", "HTTP://COM", "http://q.org/es/", "http://[::1]:80/en/"]


def test_hosts_paths_rules(spark):
    pages = spark.createDataFrame([(i, u, None, "clash", 1) for i, u in enumerate(URLS)], "page_id long, url string, html string, host string, trust int")
    rows = {r["page_id"]: r for r in urlfilter.judge(pages, RULES).collect()}
    assert len(rows) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = plain_host_path(u)
        rule = plain_rule(host, path)
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, rule and rule[1] + rule[2]), u
        assert rows[i]["verdict"] == (rule[0] if rule else "allow")


def plain_walk(edges, seeds, rounds=10, damping=85):
    mass = {s: urlfilter.UNITS // len(seeds) for s in seeds}
    degree = {}
    for a, _ in edges:
        degree[a] = degree.get(a, 0) + 1
    for _ in range(rounds):
        new, kept = {}, 0
        for a, b in edges:
            if a in mass:
                share = mass[a] // 100 * damping // degree[a]
                new[b] = new.get(b, 0) + share
                kept += share
        for s in seeds:
            new[s] = new.get(s, 0) + (urlfilter.UNITS - kept) // len(seeds)
        mass = new
    return mass


def link(*hosts):
    return "".join(f"<a HREF='http://{h}/p'>x</a>" for h in hosts)


def test_propagation_equals_plain_walk(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "c"), ("e", "f"), ("f", "e")]
    table = spark.createDataFrame(edges, "src string, dst string")
    for seeds in (["a"], ["a", "e"], ["z"]):
        got = {r["host"]: r["mass"] for r in urlfilter.propagate(table, spark.createDataFrame([(s,) for s in seeds], "host string")).collect()}
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in plain_walk(edges, seeds).items() if v}
    assert urlfilter.propagate(table, spark.createDataFrame([], "host string")).count() == 0


def test_distrust_goes_against_links(spark):
    pages = [(1, "http://spam.com/en/", ""), (2, "http://friend.io/a", link("spam.com")), (3, "http://good.io/a", link("fine.io")), (4, "http://fine.io/a", ""), (5, "http://mixed.com/fr/", ""), (6, "http://mixed.com/en/", "")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(table, RULES, trusted=["good.io"]).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block"}
    rescued = {r["page_id"]: r["verdict"] for r in urlfilter.judge(table, RULES, trusted=["friend.io"]).collect()}
    assert rescued[2] == "allow"


def test_empty_and_query(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert urlfilter.judge(pages.where("false"), RULES).count() == 0
    rows = {r["page_id"]: r for r in queries.op3_url_filters(spark, sf).collect()}
    for p in pages.collect():
        host, path = plain_host_path(p["url"])
        rule = plain_rule(host, path)
        r = rows[p["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[1] + rule[2]) and (not rule or r["verdict"] == rule[0])
    plan = queries.op3_url_filters(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_salted_hosts_give_the_same_verdicts(spark, sf, monkeypatch):
    want = sorted(map(tuple, queries.op3_url_filters(spark, sf).collect()))
    monkeypatch.setattr(urlfilter, "BROADCAST_HOSTS", -1)
    assert sorted(map(tuple, queries.op3_url_filters(spark, sf).collect())) == want


def test_words_of_the_contract(spark, tmp_path):
    """Each rule's word and those of longer rules, spelled out here and not read from the code."""
    said = {"http://com/en/1": "block", "http://a.example.com/en/6": "block", "http://a.example.com/en/7": "allow", "http://q.net/de/1": "allow", "http://example.net/de/7": "allow", "http://b.example.net/de/81": "block", "http://q.org/es/": "block"}
    spark.createDataFrame([(i, u, "") for i, u in enumerate(said)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = {r["page_id"]: (r["rule"] is not None, r["verdict"]) for r in queries.op3_url_filters(spark, str(tmp_path)).collect()}
    assert rows == {i: (True, word) for i, word in enumerate(said.values())}
