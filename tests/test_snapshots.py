"""Snapshots are whole or refused; requests are inside their limits; results agree or don't."""

import pytest

from ticklane.plans import requests
from ticklane.sources import snapshots


def test_snapshot(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, "b"), (2, None, "b")], "k int, x string, y string")
    path = str(tmp_path / "s")
    digest = snapshots.save(df, path, {"day": "20260922"})
    assert sorted(map(tuple, snapshots.load(spark, path).collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    assert snapshots.manifest(spark, path) == {"about": {"day": "20260922"}, "digest": digest}
    assert snapshots.content_digest(df.repartition(3).select("y", "k", "x")) == digest
    for other in (df.distinct(), df.limit(0), df.selectExpr("k", "y AS x", "x AS y")):
        assert snapshots.content_digest(other) != digest
    with pytest.raises(Exception, match="(?i)exists"):
        snapshots.save(df, path)
    df.limit(1).write.mode("append").parquet(path + "/rows")
    with pytest.raises(ValueError, match="digest"):
        snapshots.load(spark, path)


def test_limits():
    requests.StudyRequest(0, 249, 100, (1, 20))
    for wrong in ((0, 250, 100, (1,)), (0, 9, 5, ()), (0, 9, 5, (21,)), (0, 9, 5, (1, 1)), (0, 9, 10, (1,)), (5, 4, 4, (1,))):
        with pytest.raises(ValueError):
            requests.StudyRequest(*wrong)
    assert requests.detail_codes(["600000.SH", "000001.SZ", "600000.SH"]) == ["600000.SH", "000001.SZ"]
    for wrong in ([], ["600000"], [f"{600000 + i}.SH" for i in range(51)]):
        with pytest.raises(ValueError):
            requests.detail_codes(wrong)
    assert requests.state_window(60) == 60
    with pytest.raises(ValueError):
        requests.state_window(61)


def test_agreement(spark):
    rows = spark.createDataFrame([(1.0, 3.0, True), (1.0, 3.1, False), (1e10, 1e10 + 9, True), (None, None, True), (None, 0.0, False), (0.0, None, False)], "a double, b double, expected boolean")
    assert all(r.got == r.expected for r in rows.withColumn("got", requests.agrees("a", "b")).collect())
