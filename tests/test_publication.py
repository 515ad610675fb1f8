"""Publication by several publishers, with a reader in flight."""

import pytest
from pyspark.sql import functions as F

from tidelane.sources import publication


def frame(spark, rows):
    return spark.createDataFrame(rows, "year int, kind string, n int")


def rows_of(spark, path):
    return sorted(map(tuple, publication.read_published(spark, path).select("year", "kind", "n").collect()))


def test_of_two_publishers_neither_loses_its_kinds(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/out"
    publication.publish(frame(spark, [(2025, "a", 1), (2025, "b", 2)]), path)
    commit, others = publication.Index.commit, [[(2025, "b", 20)], [(2026, "c", 3)]]

    def late(self, version, index):
        if others:  # another publisher is first, twice
            more = others.pop()
            monkeypatch.setattr(publication.Index, "commit", commit)
            publication.publish(frame(spark, more), path)
            monkeypatch.setattr(publication.Index, "commit", late)
        return commit(self, version, index)

    monkeypatch.setattr(publication.Index, "commit", late)
    publication.publish(frame(spark, [(2025, "a", 10)]), path)
    assert rows_of(spark, path) == [(2025, "a", 10), (2025, "b", 20), (2026, "c", 3)]
    assert len(publication.Index(spark, path).versions()) == 4


def test_a_version_is_taken_once(spark, tmp_path):
    index = publication.Index(spark, f"file://{tmp_path}/out")
    assert index.newest() == (0, {})
    assert index.commit(1, {(2025, "a"): ("m", "r")}) and not index.commit(1, {(2025, "b"): ("m", "r")})
    assert index.newest() == (1, {(2025, "a"): ("m", "r")})
    assert [p.name for p in (tmp_path / "out/index").iterdir() if p.name.endswith(".tmp")] == []


def test_a_publisher_gives_up_in_the_end(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(publication.Index, "commit", lambda *a: False)
    with pytest.raises(RuntimeError):
        publication.publish(frame(spark, [(2025, "a", 1)]), f"file://{tmp_path}/out")


def test_readers_in_flight_go_on_and_old_data_goes_in_time(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    publication.publish(frame(spark, [(2025, "a", 1)]), path)
    planned = publication.read_published(spark, path)
    publication.publish(frame(spark, [(2025, "a", 2)]), path)
    assert [r.n for r in planned.collect()] == [1]
    assert rows_of(spark, path) == [(2025, "a", 2)]
    publication.publish(frame(spark, [(2025, "a", 3)]), path, grace_s=0)
    assert spark.read.parquet(f"{path}/data").agg(F.collect_set("n")).first()[0] == [3]
    assert len(publication.Index(spark, path).versions()) == 1
