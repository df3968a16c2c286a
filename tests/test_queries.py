"""Every query against its SQL in DuckDB, on whole tables; none may be empty."""

import pytest

from tests.conftest import SF, rows_of
from tessera.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    assert got[1], "no rows"
    if name in ORACLE:
        found = duck.execute(ORACLE[name])
        want = rows_of([d[0] for d in found.description], found.fetchall())
        assert got[0] == want[0]
        assert len(got[1]) == len(want[1])
        for a, b in zip(got[1], want[1], strict=True):
            assert a == b


def test_first_attachment_holds_no_list(spark):
    plan = QUERIES["first_attachment"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
