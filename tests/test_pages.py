"""Paged class lists: no page over its size, pages in order make the whole list, hot class split."""

from lexspark.operators import reports


def test_pages_bounded_and_whole(spark):
    rows = [("hot", f"n{i:04d}", f"f{i}") for i in range(950)] + [("cold", "b", "f1"), ("cold", "a", "f2"), ("cold", "a", "f0")]
    df = spark.createDataFrame(rows, "category string, scheme_name string, source_file string")
    got = reports.paged_by_class(df, "category", "scheme_name", ["scheme_name", "source_file"], page_size=100).collect()
    assert max(len(r.schemes) for r in got) <= 100
    hot = [name for r in sorted((r for r in got if r.category == "hot"), key=lambda r: r.page) for name in r.schemes]
    assert hot == [f"n{i:04d}" for i in range(950)] and {r.scheme_count for r in got if r.category == "hot"} == {950}
    assert [r.schemes for r in got if r.category == "cold"] == [["a", "a", "b"]]
    assert sorted(r.page for r in got if r.category == "hot") == list(range(1, 11))
