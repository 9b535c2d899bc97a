"""Taxonomy drafting and repair."""

from collections import Counter

import pytest

from millrace.operators import taxonomy

AXES = ["direction", "cardinality", "date_hint", "register", "register_intensity", "magnitude", "notation"]


def specs(spark):
    one = (["in", "out", "mixed"], ["zero", "single", "dua", "banyak"], ["kemarin"], ["baku", "jawa"], ["penuh"], ["receh", "besar", "jumbo"], ["jt_suffix", "k_suffix", "slang"])
    two = (["non_tx"], ["single"], ["kemarin"], ["jawa"], ["campur"], ["kecil"], ["polos"])
    rows = [("a", "t1", 3.0, *one), ("b", "t1", 1.0, *one), ("c", "t2", 1.0, *two)]
    return spark.createDataFrame(rows, "aspect string, tier string, weight double, " + ", ".join(f"{a} array<string>" for a in AXES))


def test_draft_and_relink(spark):
    from pyspark.sql import functions as F

    cells = taxonomy.draft(specs(spark), AXES, {"t1": 0.8, "t2": 0.2}, 100, 42)
    assert Counter(r["aspect"] for r in cells.collect()) == {"a": 60, "b": 20, "c": 20}
    assert sorted(map(str, cells.collect())) == sorted(map(str, taxonomy.draft(specs(spark).repartition(3), AXES, {"t1": 0.8, "t2": 0.2}, 100, 42).collect()))
    out = taxonomy.relink(cells.withColumn("has_nominal", F.lit(False))).collect()
    for r in out:
        n = taxonomy.ENTRIES[r["cardinality"]]
        if r["direction"] == "non_tx":
            assert (n, r["date_hint"]) == (0, "tidak_jelas")
        else:
            assert r["has_nominal"] and n >= 1 and (r["direction"] != "mixed" or n >= 2) and (r["direction"] != "in" or n <= 2)
        assert r["register"] != "baku" or r["register_intensity"] == "sisip"
        assert not (r["magnitude"] == "receh" and r["notation"] == "jt_suffix") and not (r["magnitude"] == "jumbo" and r["notation"] == "k_suffix")
    assert len({r["notation"] for r in out}) >= 3


def test_tokens_and_marginals(spark):
    cells = spark.createDataFrame([(f"c{i:02d}", ["x", "y"] if i < 4 else ["y"], "p", ["p", "q"] if i % 2 else ["p"]) for i in range(10)], "id string, hosts array<string>, v string, allowed_v array<string>")
    placed = taxonomy.place_tokens(cells, {"x": 3, "y": 5}, "hosts")
    assert len(set(placed["x"])) == 3 and len(set(placed["y"])) == 5 and not set(placed["x"]) & set(placed["y"])
    with pytest.raises(ValueError):
        taxonomy.place_tokens(cells, {"x": 5}, "hosts")
    moved = taxonomy.repair_marginals(cells, "v", {"p": 0.7, "q": 0.3})
    assert len(moved) == 3 and set(moved.values()) == {"q"} and all(int(i[1:]) % 2 for i in moved)
    assert len(taxonomy.repair_marginals(cells, "v", {"p": 0.1, "q": 0.9})) == 5
