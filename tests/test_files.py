"""Files: scans, pairs, documents, stored tables."""

from panelmill.sources import files as S


def _write(folder, name, rows, header="date,open,high,low,close,volume"):
    (folder / name).write_text("\n".join([header, *rows]) + "\n", encoding="utf-8")


def _days(n, close=10):
    return [f"2020-{1 + i // 28:02d}-{1 + i % 28:02d},{close},{close + 1},{close - 1},{close},100" for i in range(n)]


def test_pairs_of_price_files(spark, tmp_path):
    _write(tmp_path, "510300_20200101.csv", _days(300))
    _write(tmp_path, "510300_raw_20200101.csv", _days(290, 12))
    _write(tmp_path, "510500_20200101.csv", _days(280))  # no raw file
    _write(tmp_path, "159915_20200101.csv", _days(60))  # too few
    _write(tmp_path, "159915_raw_20200101.csv", _days(60) + ["no date,1,1,1,1,1", "2021-01-01,1,1,1,,1"])
    rows = S.price_files(spark, str(tmp_path))
    assert {(r["code"], r["basis"]): r["count"] for r in rows.groupBy("code", "basis").count().collect()} == {("510300", "adjusted"): 300, ("510300", "raw"): 290, ("510500", "adjusted"): 280, ("159915", "adjusted"): 60, ("159915", "raw"): 60}
    assert {(r["code"], r["basis"]): r["close"] for r in S.price_pairs(rows).select("code", "basis", "close").distinct().collect()} == {("510300", "adjusted"): 10.0, ("510300", "raw"): 12.0}
    assert S.long_enough(rows, 100).select("code").distinct().count() == 2
    assert S.price_pairs(rows.where("false")).count() == 0


def test_written_series_replace_older_ones(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "code string, close double")
    S.write_series(rows, folder, "20200101")
    S.write_series(rows.where("close = 2"), folder, "20200102")
    got = {(r["code"], r["close"], r["stamp"]) for r in spark.read.option("header", True).csv(folder).collect()}
    assert got == {("a", "2.0", "20200102"), ("b", "3.0", "20200101")}


def test_json_documents(spark, tmp_path):
    for name, text in {"a.json": '{"events": [1, 2]}', "b.json": '{"events": [', "c.json": "[1]"}.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    rows = S.json_documents(spark, str(tmp_path))
    assert {r["file"]: r["status"] for r in rows.select("file", "status").collect()} == {"a.json": "OK", "b.json": "INVALID", "c.json": "INVALID"}
    assert rows.where("status = 'OK'").selectExpr("variant_get(document, '$.events[1]', 'int') AS x").first()["x"] == 2


def test_stored_rows_hold_for_their_keys(spark, tmp_path):
    folder, keys = str(tmp_path / "cache"), {"schema": 4, "step": 5, "until": "2020-01-01"}
    assert S.load_rows(spark, folder, keys) is None
    S.save_rows(spark.range(5), folder, keys)
    assert S.load_rows(spark, folder, keys).count() == 5
    assert S.load_rows(spark, folder, {**keys, "step": 10}) is None
    S.save_rows(spark.range(7), folder, {**keys, "step": 10})
    assert S.load_rows(spark, folder, keys) is None and S.load_rows(spark, folder, {**keys, "step": 10}).count() == 7
    S.save_rows(spark.range(0), folder, keys)
    assert S.load_rows(spark, folder, keys) is None
