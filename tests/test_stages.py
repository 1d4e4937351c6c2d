"""The stage stream equals the batch, whatever the order and however often events come."""

import datetime
import random
import uuid

from cipherledger.operators.runs import latest_stages
from cipherledger.streaming import stages

START = datetime.datetime(2026, 1, 1)


def events(seed, n, first=0):
    rng = random.Random(seed)
    return [
        (f"scan{rng.randrange(4)}", first + i, rng.choice(["parse", "fuse", "export"]), rng.choice(["running", "done", "failed"]),
         START + datetime.timedelta(minutes=rng.randrange(600)), rng.choice([None, "e"]))
        for i in range(n)
    ]


def run(spark, folder, batches, **options):
    for rows in batches:
        spark.createDataFrame(rows, stages.EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stages.keep(stages.watch(spark, f"{folder}/in", 1), f"{folder}/out", f"stages-{uuid.uuid4().hex}", **options).awaitTermination()
    return {tuple(r) for r in stages.stored(spark, f"{folder}/out").collect()}


def test_stream_equals_batch(spark, tmp_path):
    first, second, late = events(1, 40), events(2, 40, 40), events(3, 20, 80)
    batches = [first, second, first[:15], late, late + second[:10]]  # late and repeated ones
    got = run(spark, str(tmp_path), batches, delay="1 day", span="1 hour")
    batch = latest_stages(spark.createDataFrame(first + second + late, stages.EVENTS))
    assert got == {tuple(r) for r in batch.collect()} and len(got) == 12


def test_closed_spans_keep_their_results(spark, tmp_path):
    day = datetime.timedelta(days=1)
    rows = [("s", i, "parse", f"state{i}", START + i * day, None) for i in range(6)] + [("t", 99, "parse", "only", START, None)]
    got = run(spark, str(tmp_path), [[r] for r in sorted(rows, key=lambda r: r[4])], delay="1 hour", span="1 hour")
    # the state of the first spans is gone by now, their stored updates are not
    assert got == {("s", "parse", "state5", START + 5 * day, None), ("t", "parse", "only", START, None)}
