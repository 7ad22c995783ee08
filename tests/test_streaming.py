"""A stream of reads gives the same totals as one pass over all of them."""

from colonnade.plans.more_queries import reads
from colonnade.sources.fastq import SCHEMA
from colonnade.streaming.reads import read_stream, running_summary


def test_running_summary(spark, tmp_path):
    batch = reads(spark, "/root/testdata/sf0.001").selectExpr(*[c.split()[0] for c in SCHEMA.split(", ")])
    batch.repartition(5).write.parquet(f"file://{tmp_path}/in")
    stream = running_summary(read_stream(spark, f"file://{tmp_path}/in", 2))
    q = stream.writeStream.format("memory").queryName("running").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {tuple(r) for r in running_summary(batch).collect()}
    assert {tuple(r) for r in spark.table("running").collect()} == want
