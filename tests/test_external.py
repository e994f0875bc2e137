"""Calls to services outside: batches, order, retries, rows that fail alone, and answers that are kept."""

import os
import threading
import time
import uuid

import pytest

from crestline.operators.external import call_once, call_service

SCHEMA = "out string, size int"
DEFAULTS = {"out": "none", "size": -1}


class Service:
    """Answers with the size of its batch, notes every call in a folder, and fails as told."""

    def __init__(self, folder, down=(), flaky=0):
        self.folder, self.down, self.flaky = str(folder), set(down), flaky

    def __call__(self, rows):
        at, now = f"{self.folder}/{uuid.uuid4().hex}", f"{self.folder}/now-{uuid.uuid4().hex}"
        open(now, "w").close()
        together = len([f for f in os.listdir(self.folder) if f.startswith("now-")])
        time.sleep(0.02)
        os.remove(now)
        with open(at, "w") as f:
            f.write(f"{len(rows)} {together} {','.join(str(r['i']) for r in rows)}")
        if len([f for f in os.listdir(self.folder) if not f.startswith("now-")]) <= self.flaky or self.down & {r["i"] for r in rows}:
            raise RuntimeError("down")
        return [{"out": f"o{r['i']}", "size": len(rows)} for r in rows]

    def calls(self):
        return [open(f"{self.folder}/{f}").read().split(" ") for f in os.listdir(self.folder)]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, f"t{i % 7}") for i in range(100)], "i int, text string").coalesce(1)


def test_batches_keep_their_size_and_order(rows, tmp_path, spark):
    service = Service(tmp_path)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)  # other batches than the service's
    try:
        got = call_service(rows, service, SCHEMA, DEFAULTS, size=8, in_flight=3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r["i"] for r in got] == list(range(100)) and all(r["out"] == f"o{r['i']}" and not r["failed"] for r in got)
    calls = service.calls()
    assert sorted(int(c[0]) for c in calls) == [4] + [8] * 12
    assert 2 <= max(int(c[1]) for c in calls) <= 3


def test_a_failed_batch_is_asked_again_and_then_row_by_row(rows, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    got = call_service(rows.limit(8), Service(tmp_path / "a", flaky=2), SCHEMA, DEFAULTS, size=8, in_flight=1, wait=0.01).collect()
    assert all(r["size"] == 8 and not r["failed"] for r in got)
    service = Service(tmp_path / "b", down=[3])
    got = call_service(rows.limit(16), service, SCHEMA, DEFAULTS, size=8, retries=1, wait=0.01).collect()
    assert {r["i"] for r in got if r["failed"]} == {3} and got[3]["out"] == "none" and got[3]["size"] == -1
    assert [r["size"] for r in got] == [1, 1, 1, -1, 1, 1, 1, 1] + [8] * 8
    assert len(service.calls()) == 2 + 8 + 1


def test_answers_of_another_length_fail(rows):
    got = call_service(rows.limit(2), lambda batch: [{"out": "x"}] * 3, SCHEMA, DEFAULTS, retries=0).collect()
    assert all(r["failed"] for r in got)


def test_equal_inputs_are_asked_for_once(rows, tmp_path):
    (tmp_path / "calls").mkdir()

    class Told(Service):
        def __call__(self, batch):
            assert all(set(r) == {"text"} for r in batch)
            return [{"out": r["out"] + r2["text"], "size": 1} for r, r2 in zip(super().__call__([{"i": r["text"]} for r in batch]), batch, strict=True)]

    service, memo = Told(tmp_path / "calls", down=["t5"]), str(tmp_path / "memo")
    for _ in range(2):
        got = call_once(rows, ["text"], memo, service, SCHEMA, DEFAULTS, retries=0).collect()
        assert len(got) == 100 and all(r["failed"] == (r["text"] == "t5") for r in got)
        assert all(r["out"] == ("none" if r["failed"] else f"o{r['text']}{r['text']}") for r in got)
    asked = [x for c in service.calls() for x in c[2].split(",")]
    assert set(asked) == {f"t{i}" for i in range(7)} and all(asked.count(f"t{i}") <= 2 for i in (0, 1, 2, 3, 4, 6))
    assert threading.active_count() < 200
