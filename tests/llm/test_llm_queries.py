import pytest

from quillspan.llm.queries import QUERIES
from quillspan.llm.sql import ORACLE


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(compare, name):
    compare(QUERIES[name], ORACLE[name])


def test_found_queries():
    assert {f"p{n}_found" for n in (1, 2, 4, 6, 8, 9, 10)} <= set(QUERIES)
