"""Kept and rejected messages of a stream add up to what was read, also after failures."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException

from shelfwatch.operators.selectors import Selector
from shelfwatch.schemas import MESSAGE
from shelfwatch.sources.lake import read_day, read_lake, read_rejects
from shelfwatch.sources.messages import read_crawl_stream
from shelfwatch.streaming import extract_stream as E

ONCE = {"availableNow": True}
T0 = dt.datetime(2026, 1, 1)
TITLE = {"title": Selector("h1")}


def write_messages(spark, path, keys):
    rows = [(None if k is None else k.encode(), f"<h1>t{k}</h1>".encode(), T0 + dt.timedelta(hours=i)) for i, k in enumerate(keys)]
    rows.append((b"77", None, T0))  # a page without html is kept with empty fields
    spark.createDataFrame(rows, MESSAGE).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path):
    source, lake, rejects, state = (str(tmp_path / n) for n in ("source", "lake", "rejects", "state"))
    E.run_split_stream(read_crawl_stream(spark, "parquet", path=source), lake, rejects, state, ONCE, selectors=TITLE).awaitTermination()
    return sorted(r["urlId"] for r in read_lake(spark, lake).collect()), sorted((str(r["urlId"]), r["reason"], r["html"]) for r in read_rejects(spark, rejects).collect())


KEYS = ["1", " 2 ", "x3", None, "", "4.0", "99999999999999999999", "5", "5"]
LOST = [("", "no id", "<h1>t</h1>"), ("4.0", "id is no whole number", "<h1>t4.0</h1>"), ("99999999999999999999", "id is no whole number", "<h1>t99999999999999999999</h1>"),
        ("None", "no id", "<h1>tNone</h1>"), ("x3", "id is no whole number", "<h1>tx3</h1>")]


def test_every_message_once(spark, tmp_path):
    write_messages(spark, str(tmp_path / "source"), KEYS)
    assert run(spark, tmp_path) == ([1, 2, 5, 5, 77], LOST)
    assert run(spark, tmp_path) == ([1, 2, 5, 5, 77], LOST)  # nothing new
    write_messages(spark, str(tmp_path / "source"), ["6", "y"])
    kept, lost = run(spark, tmp_path)
    assert kept == [1, 2, 5, 5, 6, 77, 77] and lost == sorted([*LOST, ("y", "id is no whole number", "<h1>ty</h1>")])
    assert read_day(spark, str(tmp_path / "lake"), "2026-01-01").count() == 7
    assert "batch" not in read_lake(spark, str(tmp_path / "lake")).columns


@pytest.mark.parametrize("fails_at", [1, 2])
def test_batch_that_fails_between_or_after_the_writes(spark, tmp_path, monkeypatch, fails_at):
    write_messages(spark, str(tmp_path / "source"), ["8", "z"])
    run(spark, tmp_path)
    write_messages(spark, str(tmp_path / "source"), KEYS)
    done, write = [], E.write_batch

    def failing(rows, path, number):
        write(rows, path, number)
        done.append(path)
        if len(done) == fails_at:
            raise RuntimeError("executor lost")

    monkeypatch.setattr(E, "write_batch", failing)
    with pytest.raises(StreamingQueryException):
        run(spark, tmp_path)
    assert len(done) == fails_at
    monkeypatch.undo()
    kept, lost = run(spark, tmp_path)
    assert kept == [1, 2, 5, 5, 8, 77, 77] and lost == sorted([*LOST, ("z", "id is no whole number", "<h1>tz</h1>")])
