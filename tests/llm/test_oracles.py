import os

import pytest

from filigree.llm import oracles, quality
from filigree.llm.queries import ORACLES, QUERIES, table
from tests.compare import connect, difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) == ""


def test_certified_cutoffs(spark):
    """With a loose control the small labels certify cutoffs, by the same arithmetic in both engines."""
    control, sf_dir = quality.RiskControl(share=0.4, error=0.5), "/root/testdata/sf0.01"
    judged = quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), control=control)
    assert difference(judged, connect(sf_dir), oracles.quality_rules(control)) == ""
    assert judged.where("NOT kept AND NOT base_failed").count() > 0
