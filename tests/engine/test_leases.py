"""Leases and expiries over batches, with a stepped clock."""

import datetime
import json

from quarrylight.streaming.leases import build_leases, index_expiries

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def played(spark, tmp_path, make, schema, batches):
    """Each batch as a file, run one by one: the rows that came, and the keys that have state after each batch."""
    source, out, at = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "at")
    source.mkdir()
    states = []
    for n, rows in enumerate(batches):
        lines = [json.dumps({**r, "ts": (START + datetime.timedelta(seconds=r["ts"])).isoformat()}) for r in rows]
        (source / f"{n}.json").write_text("\n".join(lines))
        stream = make(spark.readStream.schema(schema).json(str(source)))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
        query.awaitTermination()
        states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress["stateOperators"] else None)
    zero = int(START.timestamp() * 1000)
    return sorted((r[0], (r[1] - zero) // 1000, (r[2] - zero) // 1000) for r in spark.read.parquet(out).collect()), states


def test_one_build_of_a_repository_at_a_time(spark, tmp_path):
    ask = lambda repo, ts, event="ask": {"repo": repo, "ts": ts, "event": event}
    batches = [
        [ask("a", 0), ask("a", 1), ask("b", 2)],
        # The lease of a runs; b is done and asked for again.
        [ask("a", 5), ask("b", 6, "done"), ask("b", 7)],
        # The builder of a is lost: its lease has run out at 10.
        [ask("a", 12), ask("c", 13)],
        # All leases have run out, and no state is left but that of the last.
        [ask("z", 100)], [ask("z", 101, "done")],
    ]
    found, states = played(spark, tmp_path, lambda s: build_leases(s, 10_000), "repo string, ts timestamp, event string", batches)
    assert found == [("a", 0, 10), ("a", 12, 22), ("b", 2, 12), ("b", 7, 17), ("c", 13, 23), ("z", 100, 110)]
    assert states[0] == 2 and states[-1] == 0


def test_each_expiry_comes_once(spark, tmp_path):
    built = lambda repo, ts: {"repo": repo, "ts": ts}
    batches = [[built("a", 0), built("b", 1)], [built("a", 8)], [built("c", 15)], [built("b", 40), built("d", 41)], [built("e", 200)]]
    found, states = played(spark, tmp_path, lambda s: index_expiries(s, 10_000), "repo string, ts timestamp", batches)
    assert found == [("a", 8, 18), ("b", 1, 11), ("b", 40, 50), ("c", 15, 25), ("d", 41, 51)]
    assert states[0] == 2 and states[-1] == 1
