import pytest

from lodestore.llm.graph import connected_components


def test_long_chain_settles_or_raises(spark):
    chain = spark.createDataFrame([((i * 37) % 101, ((i + 1) * 37) % 101) for i in range(100)], "src long, dst long")
    assert {r.root for r in connected_components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        connected_components(chain, max_rounds=1)
