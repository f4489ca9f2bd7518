"""The streaming tail against sorted lists: several batches, late and repeated lines, idle environments."""

import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from vantage.streaming import tail

SCHEMA = "env_id string, file string, line_no long, value string"


@pytest.fixture
def view(spark, tmp_path):
    class View:
        def land(self, *rows):
            spark.createDataFrame(list(rows), SCHEMA).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))

        def run(self, n=3, life=tail.LIFE):
            lines = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
            tail.run_tail(lines, str(tmp_path / "view"), str(tmp_path / "state"), n, life)
            return self.read(life)

        def read(self, life=tail.LIFE, now=None):
            got = tail.read_tail(spark, str(tmp_path / "view"), life, now).orderBy("env_id", "pos").collect()
            assert [r.pos for r in got] == [i for e in sorted({r.env_id for r in got}) for i in range(sum(x.env_id == e for x in got))]
            return {(r.env_id, r.file, r.line_no): r.value for r in got}

    return View()


def test_tail_over_batches(view):
    view.land(*[("a", "f1", i, f"a{i}") for i in range(10)], ("b", "f1", 1, None), (None, "f", 1, "x"), ("a", None, 1, "x"))
    assert view.run() == {("a", "f1", i): f"a{i}" for i in (7, 8, 9)} | {("b", "f1", 1): None}
    # a newer file, a line that is too old, and one that came already; b has no news and stays
    view.land(("a", "f2", 0, "n0"), ("a", "f1", 2, "late"), ("a", "f1", 9, "a9"))
    want = {("a", "f1", 8): "a8", ("a", "f1", 9): "a9", ("a", "f2", 0): "n0", ("b", "f1", 1): None}
    assert view.run() == want
    assert view.run() == want  # nothing new
    assert view.read(now=F.current_timestamp() + F.lit(timedelta(hours=25))) == {}


def test_idle_environment_disappears_and_starts_anew(view):
    life = timedelta(seconds=6)
    view.land(("a", "f1", 1, "old"), ("b", "f1", 1, "idle"))
    view.run(life=life)
    time.sleep(6.5)
    view.land(("a", "f1", 2, "new"))
    view.run(life=life)
    assert view.read() == {("a", "f1", 2): "new", ("b", "f1", 1): "idle"}  # the state of a was gone
    time.sleep(6.1)
    assert view.read(life) == {}
