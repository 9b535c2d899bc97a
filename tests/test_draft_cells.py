"""Drafted cells cover every tier of the table."""

import glob
import os

import pytest

from millrace.plans import registry
from millrace.sources.tables import table

registry.load()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not glob.glob(f"{SF}/*.parquet"), reason="no test tables here")


def test_every_tier_and_aspect_is_drafted(spark):
    want = {(r["p_type"], f"{r['p_type']}-{r['p_brand']}") for r in table(spark, SF, "part").select("p_type", "p_brand").distinct().collect()}
    got = {(r["tier"], r["aspect"]) for r in registry.QUERIES["draft_cells"](spark, SF).collect()}
    assert got == want and len({t for t, _ in want}) > 4
