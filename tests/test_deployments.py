"""The log of deployments by itself."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest

from quittance.plans import deployments
from quittance.plans.deployments import DeploymentLog
from quittance.sources import files


@pytest.fixture
def log(spark, tmp_path):
    return DeploymentLog(spark, str(tmp_path / "deployments"))


def test_a_log_begins_empty(log):
    assert log.latest() is None and log.newest().count() == 0 and log.all().count() == 0


def test_of_several_writers_of_a_file_one_succeeds(spark, tmp_path):
    path = str(tmp_path / "deep" / "file")
    with ThreadPoolExecutor(8) as jobs:
        done = list(jobs.map(lambda k: files.put_once(spark, path, f"text {k}"), range(8)))
    assert done.count(True) == 1
    assert files.read_text(spark, path) == f"text {done.index(True)}"
    assert [p.name for p in (tmp_path / "deep").iterdir()] == ["file"]


def test_appends_at_once(log):
    with ThreadPoolExecutor(6) as jobs:
        made = list(jobs.map(lambda k: log.append("prod_blue", f"b{k}", k), range(30)))
    assert sorted(d.deployment_no for d in made) == list(range(1, 31))
    assert log.latest() == max(made, key=lambda d: d.deployment_no)
    assert {(r["deployment_no"], r["build"]) for r in log.all().collect()} == {
        (d.deployment_no, d.build) for d in made
    }


def test_records_are_folded_and_none_is_lost(log, tmp_path, monkeypatch):
    monkeypatch.setattr(deployments, "FOLDED", 5)
    for k in range(1, 24):
        assert log.append("prod_green", f"b{k}", 1_000_000 * k).deployment_no == k
        assert log.latest().build == f"b{k}"
        assert len(list((tmp_path / "deployments" / "log").iterdir())) <= 10 + 1
    rows = sorted((r["deployment_no"], r["build"], r["deployed_at"].second) for r in log.all().collect())
    assert rows == [(k, f"b{k}", k) for k in range(1, 24)]


@pytest.mark.parametrize("last", [None, "", "3", "what", "0"])
def test_the_pointer_only_shortens_the_way(log, tmp_path, monkeypatch, last):
    monkeypatch.setattr(deployments, "FOLDED", 5)
    for k in range(1, 24):
        log.append("prod_blue", f"b{k}", k)
    pointer = tmp_path / "deployments" / "last"
    pointer.unlink()
    for crc in (tmp_path / "deployments").glob(".last*"):
        crc.unlink()
    if last is not None:
        pointer.write_text(last)
    assert log.latest().build == "b23"
    assert log.append("prod_green", "next", 24).deployment_no == 24


def test_reading_the_newest_does_not_grow_with_the_log(log, monkeypatch):
    """Files touched to find the newest of ten thousand deployments, written as they would be."""
    record, history = [], []
    for n in range(1, 10_001):
        line = f'{{"deployment_no": {n}, "active_schema": "prod_blue", "build": "b{n}", "deployed_us": {n}}}\n'
        history.append(line)
        if n % deployments.FOLDED == 0:
            files.put_once(log.spark, f"{log.folder}/history/{n:012d}.json", "".join(history))
            history = []
        if n > 10_000 - 2 * deployments.FOLDED:
            record.append((n, line))
    for n, line in record:
        files.put_once(log.spark, log._record(n), line)
    files.replace_text(log.spark, f"{log.folder}/last", "9998")
    read = []
    real = files.read_text
    monkeypatch.setattr(files, "read_text", lambda spark, path: read.append(path) or real(spark, path))
    monkeypatch.setattr(files, "names_in", None)  # nothing is listed
    assert log.latest().deployment_no == 10_000 and len(read) <= 5
    monkeypatch.undo()
    assert log.all().count() == 10_000


def test_a_damaged_record_is_reported(log, tmp_path):
    log.append("prod_blue", "b", 1)
    (tmp_path / "deployments" / "log" / "000000000001.json").write_text("{")
    with pytest.raises(ValueError):
        log.latest()
