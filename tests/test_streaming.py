import json
import os

from refrain.operators.timestamps import repaired
from refrain.streaming.repair import repaired_stream


def test_stream_and_batch_repair_alike(spark, tmp_path):
    raw = [0, 1, 100, 101, 10, 11, None, 13]
    rows = [{"source_id": "s", "stream": "video", "seq": i, "raw_s": r, "frame_s": 1.0} for i, r in enumerate(raw)]
    schema = "source_id string, stream string, seq long, raw_s double, frame_s double"
    (tmp_path / "in").mkdir()
    for k, part in enumerate((rows[:3], rows[3:])):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        os.utime(tmp_path / "in" / f"{k}.json", (1_700_000_000 + 60 * k,) * 2)
    frames = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    query = repaired_stream(frames).writeStream.format("memory").queryName("repaired_rows").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r["seq"]: (r["out_s"], r["event"]) for r in spark.table("repaired_rows").collect()}
    batch = repaired(spark.createDataFrame([tuple(r.values()) for r in [x | {"raw_s": None if x["raw_s"] is None else float(x["raw_s"])} for x in rows]], schema))
    assert got == {r["seq"]: (r["out_s"], r["event"]) for r in batch.collect()}
    assert [got[i][0] for i in range(8)] == [0, 1, 2, 3, 4, 5, 6, 7]
