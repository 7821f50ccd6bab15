import random

from geoloom.llm import urls


def brute(url, rules, default="allow"):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = rest[:cut].translate(str.maketrans(urls.UPPER, urls.LOWER))
    path = rest[cut:]
    for c in "?#":
        path = path.split(c)[0]
    fit = [(len(h) + len(p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else default


def check(spark, values, rules):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(values)], "page_id long, url string, host string, rule string")
    out = urls.judged(pages, urls.rule_table(spark, rules)).collect()
    assert len(out) == len(values)
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == brute(values[r.row.page_id], rules), values[r.row.page_id]


def test_nested_rules_against_brute_force(spark):
    rng = random.Random(1)
    labels = ["a", "b", "cc", "d-e", "com", "net", "x1"]
    rules = {(rng.choice(["allow", "block"]), ".".join(rng.choices(labels, k=rng.randint(1, 4))), rng.choice(["/", "/a", "/a/b/", "/c"])) for _ in range(80)}
    rules = list({(h, p): (v, h, p) for v, h, p in sorted(rules)}.values())
    values = [f"https://{'.'.join(rng.choices(labels, k=rng.randint(1, 5)))}{rng.choice(['', '/', '/a', '/a/b/c?x', '/c#f', '?q=/a'])}" for _ in range(400)]
    values += [values[0]] * 200
    check(spark, values, rules)


def test_odd_urls(spark):
    values = [None, "", "nohost", "://", "http://", "http://COM/x", "HTTP://Example.Com:80/en/", "http://a@b.com/", "x://y://example.com/en/", "http://com", "http://example.com?/en/", "http://É.com/", "http://.com/", "http://com./", "a\n://net/es/"]
    check(spark, values, urls.RULES)
    check(spark, values, ())
    check(spark, [], urls.RULES)


def test_native_plan(spark, sf_dir):
    plan = urls.op5_url_filters(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
