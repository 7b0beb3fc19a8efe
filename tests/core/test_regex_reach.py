from gleanery.operators import rows


def test_regex_reads_whole_text(spark):
    df = spark.createDataFrame([(1, "x" * 70_000 + " Licensed under MIT"), (2, "none")], "id long, text string")
    assert [r.id for r in rows.filter_rows(df, "text", "regex", "Licensed under [A-Z]+").collect()] == [1]
    assert {r.id: r.to for r in rows.regex_extract(df, "text", "Licensed under ([A-Z]+)", to="to").collect()} == {1: "MIT", 2: None}
