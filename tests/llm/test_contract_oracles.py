"""The queries that SQL expresses beside the operator's own method: all pairs, recursive components, base spans, sizes and checksums."""

import pytest

from tessera.llm import oracles, queries
from tests.test_oracles import compare


@pytest.mark.parametrize("name", ["op3_embedding_dedup", "op7_minhash_dedup"])
def test_query_equals_sql(spark, data, name):
    compare(spark, data, name, queries.queries()[name], oracles.oracle_sql()[name])
