from gleanery.session import cut_lineage, join_small, salted_join


def test_joins(spark):
    big = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 5), (None, 1)], "k int, v int")
    small = big.groupBy("k").count()
    want = sorted(big.join(small, "k").collect())
    assert sorted(salted_join(big, small, "k", 4).collect()) == want
    assert sorted(join_small(big, small, "k", "inner").collect()) == want == sorted(join_small(big, small, "k", "inner", max_rows=0).collect())
    assert salted_join(big.limit(0), small, "k").count() == 0
    assert sorted(cut_lineage(small.where("k is not null")).collect()) == [(1, 100), (2, 1)]
