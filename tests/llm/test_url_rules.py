import random

from wireloom.llm import url_rules


def host_and_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    for c in "?#":
        path = path.split(c)[0]
    return host, path


def judge(url, rules):
    host, path = host_and_path(url)
    best = (None, "allow")
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            if best[0] is None or len(rule) > len(best[0]):
                best = (rule, verdict)
    return host, path, *best


def test_sweep_matches_brute_force(spark):
    random.seed(8)
    labels = ["net", "org", "example", "www", "a", "b-c", "é"]
    hosts = [".".join(random.choice(labels) for _ in range(random.randint(1, 4))) for _ in range(60)]
    paths = ["", "/", "/en/", "/en", "/en/x/y", "/fr/z?q=/de/", "#/en/", "?x", "/de/é"]
    rules = {random.choice(hosts) + random.choice(["/", "/en/", "/en/x", "/fr/"]): random.choice(["allow", "block"]) for _ in range(40)}
    rules |= dict(url_rules.RULES)
    urls = [f"{random.choice(['http', 'HTTPS', ''])}://{random.choice(hosts).upper() if random.random() < 0.3 else random.choice(hosts)}{random.choice(paths)}" for _ in range(1500)]
    urls += [None, "", "no scheme", "://", "http:///en/", "x://.net/", "x://net", "x://net/", "http://a://b/"] + ["http://hot.example.net/en/1"] * 900
    urls.append("http://long.net/" + "p" * 100_000)
    pages = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(urls)], "page_id bigint, url string, rule string, verdict string").repartition(4)
    out = {r.id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, spark.createDataFrame(list(rules.items()), "rule string, verdict string")).collect()}
    assert out == {i: judge(u, rules.items()) for i, u in enumerate(urls)}


def test_empty_tables_nulls_and_repeats(spark):
    rules = spark.createDataFrame(list(url_rules.RULES), "rule string, verdict string")
    pages = spark.createDataFrame([(None, "http://x.net/"), (1, None), (1, None)], "page_id bigint, url string")
    rows = sorted((r.id is None, r.verdict) for r in url_rules.judge(pages, rules).collect())
    assert rows == [(False, "allow"), (False, "allow"), (True, "block")]
    assert url_rules.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_rules.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_a_rule_stated_twice_blocks(spark):
    rules = spark.createDataFrame([("a.net/", "block"), ("a.net/", "allow")], "rule string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id bigint, url string")
    assert url_rules.judge(pages, rules).first().verdict == "block"
