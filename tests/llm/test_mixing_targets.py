"""The registered targets don't follow from the least source."""

from lexquarry.llm import mixing


def test_budgets_of_skewed_sources():
    available = {"hot": 19_000, **{f"s{i}": 1000 for i in range(19)}, None: 30}
    given = mixing.tempered(available)
    assert all(given[s] == n for s, n in available.items() if s != "hot") and 10_000 < given["hot"] < 19_000
    assert sum(given.values()) >= 0.9 * sum(available.values())
    assert mixing.tempered({"a": 7}) == {"a": 7} and mixing.tempered({}) == {}


def test_a_small_source_throws_nothing_away(spark):
    rows = [(i, "word " * 20, f"s{i % 3}") for i in range(300)] + [(1000, "word " * 30, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    chosen = mixing.select(df)
    share = {r.source: r.share for r in mixing.kept(df, chosen).collect()}
    print(share)
    assert set(share) == {"s0", "s1", "s2", None} and all(x >= 0.85 for x in share.values())
