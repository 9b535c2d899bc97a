"""The amount of every rendered message, whatever its notation."""

import glob
import os

import pytest

from millrace.plans import amounts, registry

registry.load()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not glob.glob(f"{SF}/*.parquet"), reason="no test tables here")


def test_lenient_amount_of_every_message(spark):
    chats = amounts.chats(spark, SF).collect()
    assert any("rb " in c["text"] for c in chats) and any("k " in c["text"].replace("5 kg", "") for c in chats)
    got = {r["o_orderkey"]: r["parsed"] for r in registry.QUERIES["lenient_amount"](spark, SF).collect()}
    assert got == {c["o_orderkey"]: c["v"] for c in chats}
