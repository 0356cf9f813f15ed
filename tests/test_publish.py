"""Gates, catalogue, publication and what becomes of reports when their sources or rows change."""

import json

import pytest

from ticklane.sources import files, publish

DAYS = [f"2026030{k}" for k in range(1, 10)]
REPORT = "code string, n long"


def rows(df):
    return {r["day"]: r for r in df.collect()}


def commit(spark, root, day, manifest='{"commit_state": "COMMITTED"}', marker=True, kinds=tuple(publish.LAYOUTS)):
    for kind in kinds:
        spark.range(3).write.mode("overwrite").parquet(f"{root}/{kind}_{day}.parquet")
    if manifest is not None:
        files.put(spark, f"{root}/{publish.AUDIT}/{day}/manifest.json", manifest)
    if marker:
        files.put(spark, f"{root}/{publish.AUDIT}/{day}/COMMITTED")


@pytest.fixture(scope="module")
def sessions(spark):
    return spark.createDataFrame([(d,) for d in [*DAYS, None]], "day string")


@pytest.fixture()
def root(spark, tmp_path):
    for day in DAYS:
        commit(spark, str(tmp_path / "root"), day)
    return str(tmp_path / "root")


def reported(spark, days):
    return spark.createDataFrame([(d, c, k) for d in days for k, c in enumerate(["a", "b", None])], "day string, code string, n long")


def test_gates(spark, tmp_path):
    root = str(tmp_path)
    commit(spark, root, "1")
    commit(spark, root, "2", kinds=("deal",))
    for day, text, marker in (("3", None, True), ("4", "{", True), ("5", "[1]", True), ("6", '{"commit_state": "PENDING"}', True), ("7", "{}", True), ("8", '{"commit_state": "COMMITTED"}', False), ("9", None, False)):
        commit(spark, root, day, text, marker)
    got = {day: r.missing for day, r in rows(publish.gates(spark, root)).items()}
    assert got == {"1": [], "2": ["snapshot", "order_raw"], "3": ["manifest"], "4": ["manifest"], "5": ["manifest"], "6": ["COMMITTED"], "7": ["COMMITTED"], "8": ["COMMITTED"], "9": ["manifest"]}
    assert publish.gates(spark, str(tmp_path / "none")).count() == 0


def test_catalogue_windows(spark, root, sessions):
    files.remove(spark, f"{root}/snapshot_{DAYS[0]}.parquet")
    spark.range(1).write.parquet(f"{root}/minute/20260310.parquet")
    got = rows(publish.catalogue(spark, root, sessions, extra={"minute": "minute/{key}.parquet"}))
    assert set(got) == {*DAYS, "20260310"}
    assert [got[d].can_build for d in DAYS] == [False] * 7 + [True] * 2 and got[DAYS[5]].window == [] and not got[DAYS[0]].complete
    assert got[DAYS[6]].window == DAYS[:7] and got[DAYS[6]].window_missing == DAYS[:1] and got[DAYS[6]].complete
    aside = got["20260310"]  # no session: the window ends before it
    assert aside.minute and not aside.can_build and aside.window == DAYS[2:] and aside.missing == ["deal", "snapshot", "order_raw", "manifest"]
    assert publish.catalogue(spark, root, sessions.limit(0)).where("can_build").count() == 0
    assert publish.catalogue(spark, f"{root}/none", sessions).count() == 0


def test_publish_and_what_becomes_of_it(spark, root, sessions, tmp_path):
    reports = str(tmp_path / "reports")
    state = lambda: {d: (r.status, r.reason) for d, r in rows(publish.report_states(spark, reports, REPORT, root, sessions)).items()}
    assert set(state().values()) == {("missing", None)}
    done = {d: r.status for d, r in rows(publish.publish(spark, reports, reported(spark, DAYS[5:]), root, sessions)).items()}
    assert done == {DAYS[5]: "SOURCES_INCOMPLETE", DAYS[6]: "PUBLISHED", DAYS[7]: "PUBLISHED", DAYS[8]: "PUBLISHED"}
    assert [state()[d] for d in DAYS[5:]] == [("missing", None)] + [("ready", None)] * 3
    # rows that a lost driver left staged, or moved without a provenance of theirs, aren't ready
    reported(spark, DAYS[5:6]).write.partitionBy("day").parquet(f"{reports}/{publish.STAGING}/left")
    assert state()[DAYS[5]] == ("missing", None)
    files.put(spark, f"{reports}/_provenance/{DAYS[8]}.json", json.dumps({"rows": "of the next ones", "sources": json.loads(open(f"{reports}/_provenance/{DAYS[8]}.json").read())["sources"]}))
    assert state()[DAYS[8]] == ("stale", "ROWS_CHANGED")
    # a manifest of the first session changes: only the window that holds it does
    files.put(spark, f"{root}/{publish.AUDIT}/{DAYS[0]}/manifest.json", '{"commit_state": "COMMITTED", "by": "again"}')
    assert [state()[d] for d in DAYS[6:8]] == [("stale", "SOURCES_CHANGED"), ("ready", None)]
    files.remove(spark, f"{root}/{publish.AUDIT}/{DAYS[1]}/COMMITTED")
    assert state()[DAYS[7]] == ("stale", "SOURCES_INCOMPLETE")
    assert {r.status for r in publish.publish(spark, reports, reported(spark, DAYS[7:8]), root, sessions).collect()} == {"SOURCES_INCOMPLETE"}
    files.put(spark, f"{root}/{publish.AUDIT}/{DAYS[1]}/COMMITTED")
    assert {r.status for r in publish.publish(spark, reports, reported(spark, DAYS[6:]), root, sessions).collect()} == {"PUBLISHED"}
    assert {state()[d] for d in DAYS[6:]} == {("ready", None)}
    assert publish.publish(spark, reports, reported(spark, DAYS).limit(0), root, sessions).count() == 0


def test_sources_that_change_while_rows_are_made(spark, root, sessions, tmp_path, monkeypatch):
    reports, real, calls = str(tmp_path / "reports"), publish.source_prints, []

    def later(*args):
        calls.append(1)
        if len(calls) == 2:
            spark.range(9).write.mode("overwrite").parquet(f"{root}/deal_{DAYS[0]}.parquet")
        return real(*args)

    monkeypatch.setattr(publish, "source_prints", later)
    done = {d: r.status for d, r in rows(publish.publish(spark, reports, reported(spark, DAYS[6:8]), root, sessions)).items()}
    assert done == {DAYS[6]: "SOURCES_CHANGED", DAYS[7]: "PUBLISHED"} and not files.exists(spark, f"{reports}/day={DAYS[6]}")


def test_move_never_goes_over_what_is_there(spark, tmp_path):
    files.put(spark, f"{tmp_path}/a", "1")
    files.put(spark, f"{tmp_path}/b", "2")
    with pytest.raises(OSError):
        files.move(spark, f"{tmp_path}/a", f"{tmp_path}/b")
    files.move(spark, f"{tmp_path}/a", f"{tmp_path}/deep/er/c")
    assert files.exists(spark, f"{tmp_path}/deep/er/c") and not files.exists(spark, f"{tmp_path}/a")
