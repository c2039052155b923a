from pyspark.sql import functions as F

from amperia.llm.labelled import chosen, fitting


def test_a_sample_of_any_table_is_neither_empty_nor_too_large(spark):
    """As many as asked for, whatever the number of rows is said to be: of 200,000 ids, a share of 1e11 that leaves 20,000 of these."""
    ids = spark.range(200_000).withColumnRenamed("id", "doc_id")
    for n in (200_000, 10**11, 10**13):
        most = n / 10
        assert abs(ids.filter(chosen(most, n, 3)).count() - 20_000) < 1000
    share = lambda most, n: chosen(most, n, 3)._jc.toString()
    assert "< 0)" not in share(2000, 10**11) and "< 0)" not in share(20_000, 10**15)
    assert ids.filter(chosen(500_000, 1000, 3)).count() == 200_000 and ids.filter(chosen(5, 0, 3)).count() == 200_000


def test_what_does_not_fit_is_passed_over():
    assert fitting([(3, 5), (1, 100), (2, 4), (4, 2)], 10) == [2, 3]
    assert fitting([(1, 11)], 10) == fitting([], 10) == []
    assert fitting([(k, 1) for k in range(20)], 10) == list(range(10))
