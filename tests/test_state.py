"""Versions of a state: what readers see of writers that end early, of two writers, and of repeated keys."""

import json
import os

import pytest

from tessera.sources.state import Duplicates, Ledger, StateConflict, VersionedState


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id int, print string")


def test_versions(spark, tmp_path):
    state = VersionedState(spark, f"file://{tmp_path}/s", "src", "id", "print")
    assert state.read() is None and state.versions() == []
    first = rows(spark, (1, "a"), (2, "b"), (3, "c"))
    assert {r.status for r in state.delta(first).collect()} == {"ADDED"} and state.commit(first) == 1
    second = rows(spark, (1, "a"), (2, "B"), (4, "d"))
    assert {(r.id, r.status) for r in state.delta(second).collect()} == {(1, "UNCHANGED"), (2, "CHANGED"), (3, "REMOVED"), (4, "ADDED")}

    # a writer that is killed after its rows, or in the midst of its manifest
    second.write.parquet(f"{state.folder}/data/half")
    (tmp_path / "s" / "manifests" / ".half").write_text('{"format": 1, "ver')
    assert state.versions() == [1] and sorted(map(tuple, state.read().collect())) == [(1, "a"), (2, "b"), (3, "c")]

    # two writers after the same version: the later one fails, and what it read is still there
    stale = state.manifest()
    assert state.commit(second) == 2
    with pytest.raises(StateConflict):
        state._put({**stale, "version": 2})
    assert sorted(map(tuple, state.read().collect())) == [(1, "a"), (2, "B"), (4, "d")]
    assert sorted(map(tuple, state.read(1).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert not [f for f in os.listdir(tmp_path / "s" / "manifests") if f.startswith(".") and not f.startswith(".half") and not f.endswith(".crc")]

    with pytest.raises(Duplicates):
        state.commit(rows(spark, (1, "a"), (1, "b")))
    assert state.versions() == [1, 2]

    state.forget(1)
    assert state.versions() == [2] and state.read().count() == 3 and len(os.listdir(tmp_path / "s" / "data")) == 1
    with pytest.raises(ValueError, match="state of src"):
        VersionedState(spark, state.folder, "other", "id", "print").read()
    path = tmp_path / "s" / "manifests" / "2.json"
    assert json.loads(path.read_text())["rows"] == 3


def test_empty_state(spark, tmp_path):
    state = VersionedState(spark, f"file://{tmp_path}/s", "src", "id", "print")
    none = rows(spark, (1, "a")).limit(0)
    state.commit(none)
    assert state.read().count() == 0 and state.delta(none).count() == 0


def test_ledger(spark, tmp_path):
    """Tables of one commit are seen together or not at all; a batch that comes again changes nothing."""
    ledger = Ledger(spark, f"file://{tmp_path}/l", "src")
    assert ledger.table("log") is None
    assert ledger.put({"log": rows(spark, (1, "a"))}, {"now": rows(spark, (1, "a"))}, 0) == 1
    assert ledger.put({"log": rows(spark, (2, "b"))}, {"now": rows(spark, (2, "b"))}, 1) == 2
    assert ledger.put({"log": rows(spark, (2, "b"))}, {"now": rows(spark, (9, "z"))}, 1) == 2
    assert sorted(map(tuple, ledger.table("log").collect())) == [(1, "a"), (2, "b")] and list(map(tuple, ledger.table("now").collect())) == [(2, "b")]
    bad = rows(spark, (3, "c")).selectExpr("id", "raise_error('lost') as print")
    with pytest.raises(Exception, match="lost"):
        ledger.put({"log": rows(spark, (3, "c"))}, {"now": bad}, 2)
    assert ledger.table("log").count() == 2 and ledger.versions() == [1, 2]
    assert ledger.put({"log": rows(spark, (3, "c"))}, {"now": rows(spark, (3, "c"))}, 2) == 3 and ledger.table("log").count() == 3
