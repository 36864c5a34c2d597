"""The stream path gives the same audited posts as the batch path."""

from textloom.sources import tables as tb
from textloom.streaming import posts as sp
from conftest import SF001


def test_stream_equals_batch(spark, tmp_path):
    raw = tb.raw_gen(spark, SF001)
    src = str(tmp_path / "raw")
    raw.write.parquet(src)
    stream = sp.audited_posts(sp.read_raw_stream(spark, src))
    q = (stream.writeStream.format("memory").queryName("audited_posts_test")
               .option("checkpointLocation", str(tmp_path / "ckpt")).outputMode("append").start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM audited_posts_test")
                 .select("gen_id", "text", "reason", "has_pii").collect())
    want = sorted(tuple(r) for r in sp.audited_posts(spark.read.parquet(src))
                  .select("gen_id", "text", "reason", "has_pii").collect())
    assert got == want and len(got) > 0
