from lexspark.llm import urls

SCHEMA = "page_id long, url string, host string, path string, rule string"


def judged(spark, rows):
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)
    return {r["page_id"]: r for r in urls.judged_pages(df).collect()}


def test_parts_and_rules(spark):
    rows = [(1, "http://A.Example.COM:80/en/5?q#f"), (2, "https://www.example.com/en/x"), (3, "http://m.www.example.com/en/"), (4, "http://net/es/1"),
            (5, "http://xnet/es/1"), (6, "x://shop.net/de/1"), (7, "shop.net/es/1"), (8, None), (9, ""), (10, "://"), (11, "http://example.com"),
            (12, "http://example.com?x=http://b.net/es/"), (13, "http://foo.com/EN/1"), (14, "a\nb://c.net/fr/\u00e9"), (1, "http://A.Example.COM:80/en/5?q#f")]
    got = judged(spark, rows)
    part = lambda i: tuple(got[i][c] for c in ("host", "path", "rule", "verdict"))
    assert part(1) == ("a.example.com:80", "/en/5", None, "allow")
    assert part(2) == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and part(3)[2] == "www.example.com/en/"
    assert part(4) == ("net", "/es/1", "net/es/", "block") and part(5)[2:] == (None, "allow") and part(6)[2:] == (None, "allow")
    assert part(7) == part(8) == part(9) == part(10) == ("", "", None, "allow")
    assert part(11) == ("example.com", "", None, "allow") and part(12)[:2] == ("example.com", "")
    assert part(13)[2:] == ("com/", "allow") and part(14) == ("c.net", "/fr/\u00e9", "net/fr/", "block")
    assert judged(spark, []) == {}


def tree(spark, rows, **options):
    df = spark.createDataFrame(rows, "host string, lexical string, label string")
    return {(r["host"], r["lexical"]): r for r in urls.templates(df, **options).collect()}


def test_wildcards_merging_and_purity(spark):
    rows = [("a", f"/shop/item{i}", "block" if i % 2 else None) for i in range(40)]
    rows += [("a", "/x/{n}", "block")] * 30 + [("a", "/y/{n}", "block")] * 20 + [("a", "/z/{n}", "allow")] * 50 + [("a", "/x/{n}", None)] * 5
    got = tree(spark, rows)
    assert {got["a", f"/shop/item{i}"]["template"] for i in range(40)} == {"/shop/*"}
    assert all(got["a", f"/shop/item{i}"]["rejected"] for i in range(40))
    assert got["a", "/x/{n}"]["rejected"] and not got["a", "/z/{n}"]["rejected"]


def test_alike_siblings_share_their_counts(spark):
    rows = [("h", "/p/{n}", "block")] * 9 + [("h", "/q/{n}", "block")] * 6 + [("h", "/r/{n}", "block")] * 2 + [("h", "/s/{n}", None)]
    got = tree(spark, rows)
    assert (got["h", "/p/{n}"]["n_labelled"], got["h", "/q/{n}"]["n_blocked"], got["h", "/r/{n}"]["n_labelled"]) == (15, 15, 2)
    assert not got["h", "/s/{n}"]["rejected"] and not got["h", "/r/{n}"]["rejected"]
