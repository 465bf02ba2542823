"""The stateful watch over running responses (its own session setting: a RocksDB state store)."""

import json
import time

import pytest

from titleforge.streaming import replay


def test_watch(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rows = [{"request": r, "seq": i, "content_delta": "x" * 30, "finish_reason": "stop" if i == 5 else None} for r in "ab" for i in range(6)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = replay.stream_jsonl(spark, str(tmp_path / "in"), "request string, seq long, content_delta string, finish_reason string")
        out = []
        query = (
            replay.watch_responses(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second")
            .foreachBatch(lambda batch, n: out.extend((r.request, r.status, len(r.content), r.chunks) for r in batch.collect())).start()
        )
        end = time.time() + 60
        while len(out) < 4 and query.isActive and time.time() < end:
            time.sleep(0.5)
        query.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(out) == sorted((r, s, n, c) for r in "ab" for s, n, c in (("content_checkpoint", 90, 3), ("finished", 180, 6)))
