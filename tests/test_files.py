"""Publishing, split files, receipts, statement texts, schedulers and floors, on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import batches, ledger, sampling, taxonomy
from millrace.sources import files


def test_missing_folder_and_flat_scan(spark, tmp_path):
    assert files.artifacts(spark, str(tmp_path / "none")).collect() == []
    (tmp_path / "runs" / "old").mkdir(parents=True)
    (tmp_path / "runs" / "a.json").write_text('{"kind": "parse-base"}')
    (tmp_path / "runs" / "b.json").write_text("{")
    (tmp_path / "runs" / "old" / "c.json").write_text("{}")
    assert [r["path"].rsplit("/", 1)[1] for r in files.artifacts(spark, str(tmp_path / "runs")).collect()] == ["a.json"]


def test_publish_replaces_whole_files(spark, tmp_path):
    for text in ("one", "two é"):
        files.publish(spark, text, str(tmp_path / "x" / "m.json"))
        assert (tmp_path / "x" / "m.json").read_text() == text
    assert [p.name for p in (tmp_path / "x").iterdir() if not p.name.startswith(".")] == ["m.json"]


def test_run_with_named_splits_and_manifest(spark, tmp_path):
    rows = [(i, "train" if i % 4 else "eval_iid" if i % 8 else "eval_compositional", f"t{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "plan_index long, split string, text string")
    for stamp in ("s1", "s2"):
        counts = files.write_run(df, str(tmp_path / "run"), str(tmp_path / "pub"), stamp, "plan_index", {"seed": 42})
    assert counts == {"train": 30, "valid": 5, "test": 5}
    back = spark.read.json(str(tmp_path / "run" / "rows"))
    assert {r["split"]: r["count"] for r in back.groupBy("split").count().collect()} == counts
    for p in ("run/manifest.json", "pub/s1-manifest.json", "pub/s2-manifest.json", "pub/manifest-latest.json"):
        assert json.loads((tmp_path / p).read_text()) == {"seed": 42, "rows": counts}
    for part in (tmp_path / "run" / "rows" / "split=train").glob("*.json"):
        order = [json.loads(x)["plan_index"] for x in part.read_text().splitlines()]
        assert order == sorted(order)
    empty = files.write_run(df.limit(0), str(tmp_path / "no"), str(tmp_path / "pub"), "s3", "plan_index", {})
    assert empty == {"train": 0, "valid": 0, "test": 0}


def test_receipt_totals(spark):
    rows = [("in/a.png", 90_000, 85_000, 1), ("in/a.png", 90_001, 85_000, 1), ("in/a.png", None, 85_000, 1), ("in/b.png", 7, None, 1), ("in/c.png", None, None, 1), ("in/Selisih.png", 5, 6, 87_500)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, path string, seen long, listed long, conflict long")
    got = df.select("i", files.settled(*map(F.col, ("path", "seen", "listed", "conflict"))).alias("s")).orderBy("i").collect()
    assert [tuple(r["s"]) for r in got] == [(90_000, "read"), (85_000, "manifest"), (85_000, "manifest"), (7, "read"), (None, "unavailable"), (87_500, "conflict")]


def test_sidecar_texts(spark):
    pdfs = spark.createDataFrame([("in/a.pdf",), ("in/b.pdf",)], "path string")
    texts = spark.createDataFrame([("in/a.pdf.txt", "01/07 kopi Rp 5.000")], "path string, value string")
    assert sorted(map(tuple, files.sidecar_texts(pdfs, texts, "none").collect())) == [("in/a.pdf", "01/07 kopi Rp 5.000"), ("in/b.pdf", "none")]


def test_room_of_a_scheduler():
    assert batches.room(10, 4, 3, 8) == ("batch", 3) and batches.room(10, 0, 0, 4) == ("batch", 4)
    assert batches.room(10, 10, 0, 4) == ("done", 0) == batches.room(10, 1, 0, 4, aborted=True)
    assert batches.room(10, 4, 6, 4) == ("wait", 0)
    with pytest.raises(ValueError, match="positive"):
        batches.room(10, 0, 0, 0)


def test_tokens_grow_cells(spark):
    cells = spark.createDataFrame([(f"c{i}", ["x"] if i < 2 else []) for i in range(5)], "id string, hosts array<string>")
    placed = taxonomy.place_tokens(cells, {"x": 3, "y": 2}, "hosts", grow="new")
    assert len(set(placed["x"])) == 3 and {"c0", "c1"} < set(placed["x"]) and len(set(placed["y"])) == 2
    new = [i for t in placed.values() for i in t if i.startswith("new")]
    assert len(new) == len(set(new)) == 3


def test_backstop_keeps_rows_to_train_on(spark):
    rows = [("a", 1, False, "eval"), ("a", 2, True, "eval"), ("a", 3, False, "eval"), ("b", 4, False, "train"), ("b", 5, False, "eval"), ("c", 6, True, "eval")]
    df = spark.createDataFrame(rows, "g string, k long, held boolean, split string")
    got = {r["k"]: r["split"] for r in sampling.backstop(df, "g", "k", "held", 2).collect()}
    assert got == {1: "train", 2: "eval", 3: "train", 4: "train", 5: "train", 6: "eval"}


def test_amounts_in_rows_of_5000(spark):
    have = lambda *v: F.array(*(F.lit(x).cast("long") for x in v))
    cases = [((5000,) * 4, [20000]), ((5000,) * 3, [20000]), ((20000,), [20000, 5000]), ((5000,) * 4, [20000, 7]), ((5000,) * 3, [15000, 5000])]
    row = spark.range(1).select(*(ledger.amounts_ok(have(*h), n).alias(f"c{i}") for i, (h, n) in enumerate(cases))).first()
    assert list(row) == [True, False, True, False, True]


def test_amount_column_by_its_header():
    assert files.amount_column(["Tanggal", " Nominal ", "x"]) == " Nominal " and files.amount_column(["jumlah", "amount"]) == "jumlah" and files.amount_column(["total"]) is None


def test_exact_shuffle_of_a_short_list():
    def draws(seed):
        state = seed
        while True:
            state = (state + 0x6D2B79F5) & 0xFFFFFFFF
            x = (state ^ state >> 15) * (state | 1) & 0xFFFFFFFF
            x ^= (x + ((x ^ x >> 7) * (x | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
            yield ((x ^ x >> 14) & 0xFFFFFFFF) / 2**32

    draw, want = draws(42), list(range(20))
    assert abs(next(draws(42)) - 0.6011037519201636) < 1e-15
    for i in range(19, 0, -1):
        j = int(next(draw) * (i + 1)) % (i + 1)
        want[i], want[j] = want[j], want[i]
    assert sampling.shuffle_small(list(range(20)), 42) == want
