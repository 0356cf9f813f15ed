import pytest

from compare import same
from ticklane import card_queries, followup_queries, limitup_queries, publish_queries, queries, report_queries, response_queries, source_queries, store_queries, study_queries, view_queries  # noqa: F401  they register
from ticklane.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    rows = QUERIES[name](spark, SF)
    if name in SQL:
        same(rows, SQL[name], SF)
    else:
        assert rows.count() > 0
