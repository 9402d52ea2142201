import pytest

from quillon.operators import relational, similarity
from quillon.plans.queries import QUERIES, SQL
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    ok, why = compare(spark, SF, QUERIES[name], SQL[name])
    assert ok, why


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1


def test_zero_vector_and_duplicates(spark):
    e = spark.createDataFrame([(1, 0, [0.0, 0.0]), (2, 0, [1.0, 0.0]), (3, 0, [1.0, 0.0]), (4, 1, [-1.0, 0.0])], "id long, g int, embedding array<float>")
    got = {r.id: r.distance for r in similarity.distances(e, similarity.anchor(e, [2], "id"), "id").collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: 2.0}
    with pytest.raises(ValueError):
        similarity.anchor(e, [99], "id")
    assert {r.g: r.mean_distance for r in similarity.within_distance(e, "g").collect()}[1] == 0.0


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "parent string, child string")
    got = {r.node for r in relational.closure(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {"a", "b", "c"}
