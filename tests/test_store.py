"""The store of observations, its look-up and the times of its inputs."""

import datetime
import glob
import io
import os
from contextlib import redirect_stdout

import pytest

from ticklane.sources import factors, store

ROWS = "code string, i long, horizon int, status string, excess double"


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "s")
    rows = [(f"{c:06d}.SZ", i, h, "OBSERVED", None if i == 3 else c / 7) for c in range(1, 101) for i in range(5) for h in (1, 3)]
    store.save(spark.createDataFrame([*rows, rows[0]], ROWS), path, {"by": "test"}, 8)
    return path


def test_lookup_is_ordered_and_prunes(spark, saved):
    found = store.lookup(spark, saved, ["000002.SZ", "000001.SZ", "000002.SZ", "999999.SZ"])
    got = [(r.code, r.i, r.horizon) for r in found.collect()]
    want = [(c, i, h) for c in ("000001.SZ", "000002.SZ") for i in range(4, -1, -1) for h in (1, 3)]
    assert got == sorted([*want, ("000001.SZ", 0, 1)], key=lambda r: (r[0], -r[1], r[2]))  # a row that was there twice is so still
    out = io.StringIO()
    with redirect_stdout(out):
        found.explain("formatted")
    assert "PushedFilters: [In(code, [" in out.getvalue()
    # sorted ranges: a code lies in one file or two, not in all
    import pyarrow.parquet as pq

    parts = [pq.read_table(f, columns=["code"]).column(0).to_pylist() for f in glob.glob(f"{saved}/rows/*.parquet")]
    assert len(parts) > 4 and all(p == sorted(p) for p in parts) and sum("000002.SZ" in p for p in parts) <= 2


def test_requests_and_broken_stores(spark, saved, tmp_path):
    for wrong in ([], [str(k) for k in range(51)]):
        with pytest.raises(ValueError, match="1 to 50"):
            store.lookup(spark, saved, wrong)
    assert store.verify(spark, saved).count() == 1001
    path = str(tmp_path / "s")
    rows = spark.createDataFrame([("a", k, 1, "OBSERVED", 1.0) for k in range(20)], ROWS)
    store.save(rows, path, None, 2)
    rows.limit(1).write.mode("append").parquet(f"{path}/rows")
    with pytest.raises(ValueError, match="21 rows, saved as 20"):
        store.lookup(spark, path, ["a"])
    rows.withColumn("excess", rows.excess + 1).write.mode("overwrite").parquet(f"{path}/rows")
    assert store.lookup(spark, path, ["a"]).count() == 20
    with pytest.raises(ValueError, match="digest"):
        store.verify(spark, path)
    rows.write.parquet(str(tmp_path / "half" / "rows"))
    with pytest.raises(Exception, match="manifest"):
        store.lookup(spark, str(tmp_path / "half"), ["a"])


def test_times_on_the_market_clock(spark, tmp_path):
    # 15:59 and 16:01 UTC are 23:59 and 00:01 of the next day there
    for day, at in (("20260921", (2026, 9, 21, 15, 59)), ("20260922", (2026, 9, 22, 16, 1)), ("20260923", (2026, 9, 20, 0, 0))):
        f = tmp_path / f"{day}_stk_factor_pro.csv"
        f.write_text("x\n")
        when = datetime.datetime(*at, tzinfo=datetime.UTC).timestamp()
        os.utime(f, (when, when))
    (tmp_path / "note.txt").write_text("no day")
    days = spark.createDataFrame([(d,) for d in ("20260921", "20260922", "20260923", "20260924")], "day string")
    audited = store.timing_audit(store.file_changes(spark, str(tmp_path), factors.BY_DAY), days)
    assert {r.day: (r.status, r.files) for r in audited.collect()} == {"20260921": ("SAME_DAY", 1), "20260922": ("CHANGED_AFTER_DAY", 1), "20260923": ("CHANGED_BEFORE_DAY", 1), "20260924": ("NO_FILE", None)}
    one = store.timing_summary(audited).first()
    assert tuple(one)[:5] == (4, 1, 1, 1, 1) and one.last_change == datetime.datetime(2026, 9, 23, 0, 1)
