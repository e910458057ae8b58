import random

import pytest

from leakframe.llm import url_tree
from leakframe.llm.queries import URL_RULES

CASES = [
    ("https://a.example.NET/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"), ("http://example.net/de", "example.net", "/de", "net/", "block"),
    ("http://notexample.net/en/1", "notexample.net", "/en/1", "net/", "block"), ("http://x.example.com/de/3?q#f", "x.example.com", "/de/3", "example.com/de/", "block"),
    ("http://org/fr/", "org", "/fr/", "org/fr/", "allow"), ("x://É.Org/fr/1", "É.org", "/fr/1", "org/fr/", "allow"), ("http://b.net", "b.net", "", None, None),
    ("http://b.net?x=://c", "b.net", "", None, None), (None, "", "", None, None), ("no scheme/net/", "", "", None, None), ("://", "", "", None, None),
    ("http://b.net#f/", "b.net", "", None, None), ("a://b://c/d", "b:", "//c/d", None, None), ("http://h/" + "s/" * 3000, "h", "/" + "s/" * 3000, None, None),
]


def test_hosts_paths_and_rules(spark):
    urls = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(CASES)] * 2, "page_id int, url string, host string")
    rows = url_tree.judge_urls(urls, URL_RULES).collect()
    assert len(rows) == 2 * len(CASES)
    for r in rows:
        _, host, path, rule, verdict = CASES[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or "allow")
    assert url_tree.judge_urls(urls.limit(0), URL_RULES).count() == 0


def test_impure_templates_are_rejected(spark):
    rows = []
    for i in range(400):
        rows += [(f"http://h.org/user/u{i}x/photos/{i}", 1, 0), (f"http://h.org/user/u{i}x/ads/{i}", 0, 1), (f"http://h.org/about/{i}", None, None)]
    urls = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id int, url string, g int, b int")
    got = url_tree.judge_urls(urls, [], good_col="g", bad_col="b").collect()
    for r in got:
        if "/ads/" in r.path:
            assert r.verdict == "block" and r.template == "/user/u{n}x/ads"
        if "/photos/" in r.path:
            assert r.verdict == "allow" and r.template == "/user/u{n}x/photos"


def test_branches_part_at_any_depth(spark):
    rows, names = [], [chr(97 + i % 26) + chr(97 + i // 26) for i in range(100)]
    for i, name in enumerate(names):
        for top in ("user/u1x/x", f"blog/a/b/{name}", "s/a/b/c/d/e/f"):  # they part at the segments 4, 5 and 8
            rows += [(f"http://h.org/{top}/ads/{i}", 0, 1), (f"http://h.org/{top}/photos/{i}", 1, 0)]
        rows += [(f"http://h.org/s/a/b/c/d/e/f/photos/{i}/{name}/x", None, None), ("http://h.org/" + "s/" * i, None, None)]
    urls = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id int, url string, g int, b int")
    got = url_tree.judge_urls(urls, [], good_col="g", bad_col="b").collect()
    assert len(got) == len(rows)
    for r in got:
        if "/ads/" in r.path:
            assert r.verdict == "block" and r.purity < 0.1 and r.template.endswith("/ads")
        elif "/photos/" in r.path and rows[r.page_id][1]:
            assert r.verdict == "allow" and r.purity > 0.9 and "/photos" in r.template
    assert {r.template for r in got if "/blog/" in r.path} == {"/blog/a/b/*/ads", "/blog/a/b/*/photos"}


def test_variable_segments_become_wildcards(spark):
    names = [chr(97 + i % 26) + chr(97 + i // 26) for i in range(300)]
    urls = spark.createDataFrame([(i, f"http://h.org/{n}/profile") for i, n in enumerate(names)], "page_id int, url string")
    assert {r.template for r in url_tree.judge_urls(urls, []).collect()} == {"/*/profile/$"}


def test_similar_siblings_pool_their_labels(spark):
    rows = [("http://h.org/a/x", 1, 0)] * 40 + [("http://h.org/b/x", 1, 0)] * 35 + [("http://h.org/c/x", 0, 1)] * 40
    urls = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id int, url string, g int, b int")
    got = {r.template: r.purity for r in url_tree.judge_urls(urls, [], good_col="g", bad_col="b").collect()}
    assert got["/a/x/$"] == got["/b/x/$"] > 0.9 and got["/c/x/$"] < 0.3


def test_a_small_section_keeps_its_own_labels(spark):
    rows = [(f"http://h.org/{chr(97 + k % 26)}{chr(97 + k // 26)}/{i}", int(k != 70), int(k == 70)) for k in range(100) for i in range(40)]
    urls = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id int, url string, g int, b int")
    for r in url_tree.judge_urls(urls, [], good_col="g", bad_col="b").collect():
        own = r.path.startswith("/sc/")
        assert (r.verdict, r.template) == (("block", "/sc/{n}/$") if own else ("allow", "/*/{n}/$"))


def test_groups_by_brute_force(spark):
    rnd = random.Random(5)
    nodes = [(h, f"t{i}", rnd.choice([0, 3, 40, 500]), rnd.choice([0, 1, 30, 900])) for h in "ab" for i in range(700)]
    nodes += [("c", f"t{i}", 2 ** i, 4 ** (12 - i)) for i in range(12)]
    tree = spark.createDataFrame([("", *n) for n in nodes], "branch string, host string, t string, good long, bad long")
    got = {}
    for r in url_tree.merged(tree.withColumn("name", tree.t), 1).collect():
        got.setdefault((r.host, r.branch), set()).add(r.name)

    def parted(group):
        sides = {}
        for _, name, g, b in group:
            og, ob = sum(x[2] for x in group) - g, sum(x[3] for x in group) - b
            m, k = g + b + 2, og + ob + 2
            p, q = (g + 1) / m, (og + 1) / k
            pooled = (p * m + q * k) / (m + k)
            apart = (p - q) ** 2 > 1.64 ** 2 * pooled * (1 - pooled) * (1 / m + 1 / k)
            sides.setdefault((p > q) - (p < q) if apart else 0, []).append(("", name, g, b))
        return list(sides.values())

    want = []
    for host in "abc":
        groups = [[n for n in nodes if n[0] == host and n[2] + n[3]]]
        for _ in range(3):
            groups = [x for g in groups for x in parted(g)]
        want += [sorted(n[1] for n in g) for g in groups + [[n for n in nodes if n[0] == host and not n[2] + n[3]]] if g]
    assert sorted(map(sorted, got.values())) == sorted(want) and len(want) > 6


@pytest.mark.parametrize("sections", [40, 1000])
def test_many_sections_of_rising_purity_are_not_chained(spark, sections):
    """Neighbours are alike, the ends are not: the good sections are allowed and the bad ones blocked."""
    rows = []
    for k in range(sections):
        name = "".join(chr(97 + k // 26 ** i % 26) for i in range(3))
        good = round(50 * k / (sections - 1))
        rows += [(f"http://h.org/{name}/{i}", int(i < good), int(i >= good)) for i in range(50)]
    urls = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id int, url string, g int, b int")
    by = {}
    for r in url_tree.judge_urls(urls, [], good_col="g", bad_col="b").collect():
        by.setdefault(r.path.split("/")[1], set()).add((r.verdict, round(r.purity, 3)))
    assert all(len(v) == 1 for v in by.values())
    verdicts = [min(by["".join(chr(97 + k // 26 ** i % 26) for i in range(3))]) for k in range(sections)]
    fifth = sections // 5
    assert {v for v, _ in verdicts[:fifth]} == {"block"} and {v for v, _ in verdicts[-fifth:]} == {"allow"}
    assert verdicts[0][1] < 0.25 and verdicts[-1][1] > 0.85 and len({p for _, p in verdicts}) >= 3


def test_no_python(spark):
    urls = spark.createDataFrame([(1, "http://a.b/c", 1)], "page_id int, url string, g int")
    plan = url_tree.judge_urls(urls, URL_RULES, good_col="g", bad_col="g")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan
