"""Every registered query with SQL gives the SQL's rows."""

import pytest

from tests.conftest import ORACLE, same_rows
from tidemark.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, duck):
    same_rows(QUERIES[name](spark, ORACLE), duck, ORACLES[name])


def test_what_has_no_sql_is_tested_elsewhere():
    """Against NumPy or planted groups: tests/test_models.py, test_whole_detectors.py, test_whole_projection.py."""
    assert set(QUERIES) - set(ORACLES) == {"u_union_augment", "m_pca_blocked", "m_pca_global", "m_gmm_em", "m_iforest", "m_kselect", "m_univariate"}
