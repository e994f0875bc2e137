"""Documents from partial updates against a plain fold, streamed in any order and over a restart."""

import json
import random
import time

import pytest

from crestline.streaming import documents
from tests.test_live import settings  # noqa: F401

SCHEMA = "job_id string, seq long, payload string"


def apply_patch(document: dict, payload: str | None) -> dict:
    """Merge a JSON patch: absent keys stay, null clears, ``clip_ready`` upserts one hot point.

    On ``DONE`` the final list of hot points counts only where none was streamed before.  A
    payload that is no JSON object changes nothing.
    """
    try:
        patch = json.loads(payload or "")
    except ValueError:
        return document
    if not isinstance(patch, dict):
        return document
    document = dict(document)
    if patch.get("type") == "clip_ready" and isinstance(patch.get("hot_point"), dict):
        point, points = patch["hot_point"], list(document.get("hot_points") or [])
        spots = [i for i, p in enumerate(points) if p.get("clip_filename") == point.get("clip_filename")]
        if spots:
            points[spots[0]] = point
        else:
            points.append(point)
        document["hot_points"] = points
        return document
    keep = patch.get("status") == "DONE" and document.get("hot_points")
    for key, value in patch.items():
        if key not in ("type", "job_id") and not (keep and key == "hot_points"):
            document[key] = value
    return document


def folded(updates):
    """Documents of all jobs, updates in the order of their numbers."""
    out = {}
    for job, _, payload in sorted(updates, key=lambda u: u[1]):
        out[job] = apply_patch(out.get(job, {}), payload)
    return out


def comparable(document):
    """``hot_points`` that are null count as none."""
    return document | ({"hot_points": document["hot_points"] or []} if "hot_points" in document else {})


def updates_of(rng, n, jobs="abc"):
    rows = []
    for seq in range(n):
        clips = [{"clip_filename": rng.choice(["f1", "f2", "f3"]), "score": rng.randrange(9)} for _ in range(rng.randrange(3))]
        clips = list({c["clip_filename"]: c for c in clips}.values())
        payload = rng.choice(
            [
                json.dumps({"status": rng.choice(["RUN", "CUT"]), "error": rng.choice([None, "e", 'q"\\', "é"])}),
                json.dumps({"type": "clip_ready", "hot_point": {"clip_filename": rng.choice(["f1", "f2", "f3"]), "score": seq}}),
                json.dumps({"type": "clip_ready", "hot_point": {"clip_filename": rng.choice(["f1", "f2"]), "score": seq}}),
                json.dumps({"status": "DONE", "hot_points": clips, "n": seq}),
                rng.choice(["no json", None, "[1]", "{}", "7", json.dumps({"job_id": "x", "type": "y", "deep": {"a": [1, None]}})]),
                json.dumps({"hot_points": clips}) if rng.random() < 0.3 else json.dumps({"n": seq}),
            ]
        )
        rows.append((rng.choice(jobs), seq, payload))
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_batch_equals_a_plain_fold(spark, seed):
    rng = random.Random(seed)
    updates = [u for part, job in enumerate("abcdefghij") for u in [(job, s, p) for _, s, p in updates_of(rng, rng.choice([1, 3, 8, 20]))]]
    got = documents.merged_documents_batch(spark.createDataFrame(updates, SCHEMA).repartition(3)).collect()
    assert {r["job_id"]: json.loads(r["document"]) for r in got} == {k: comparable(d) for k, d in folded(updates).items()}
    assert {r["job_id"]: r["seq"] for r in got} == {k: max(s for j, s, _ in updates if j == k) for k in folded(updates)}


def run(spark, folder, feed, out, ttl=900.0, waits=0.0):
    """Runs the stream over what is there until all has been read, and for ``waits`` seconds more."""
    for part in feed:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(str(folder / "in"))

    def keep(batch, _epoch):
        out.update({r["job_id"]: (r["seq"], r["document"]) for r in batch.collect()})

    spark.conf.set("spark.sql.shuffle.partitions", 2)
    stream = documents.merged_documents(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder / "in")), ttl)
    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(folder / "seen")).start()
    until = time.time() + 120
    while sum(p.numInputRows for p in query.recentProgress) < sum(map(len, feed)):
        assert time.time() < until and query.isActive
        time.sleep(0.2)
    time.sleep(waits)
    query.stop()


def test_streamed_documents_equal_the_batch_in_any_order_over_a_restart(spark, tmp_path):
    rng, out = random.Random(9), {}
    updates = updates_of(rng, 60, "abcd")
    rng.shuffle(updates)  # numbers come out of order, across triggers too
    run(spark, tmp_path, [updates[:20], updates[20:40]], out)
    run(spark, tmp_path, [updates[40:], updates[:10]], out)  # some come again
    want = documents.merged_documents_batch(spark.createDataFrame(updates, SCHEMA)).collect()
    assert out == {r["job_id"]: (r["seq"], r["document"]) for r in want}


def test_quiet_jobs_are_forgotten(spark, tmp_path):
    out = {}
    run(spark, tmp_path, [[("a", 1, '{"status": "RUN", "n": 1}')]], out, 2.0)
    time.sleep(2.5)
    run(spark, tmp_path, [[("a", 2, '{"status": "CUT"}')]], out, 2.0)
    assert out == {"a": (2, '{"status": "CUT"}')}
