from velloom.operators import jobs
from velloom.sources import metrics


def test_batch_samples_turn_into_rates(spark):
    metrics.register(spark)
    d = spark.read.format("machine_metrics").option("samples", 3).option("every", 0.01).load()
    assert d.columns == [c.split()[0] for c in metrics.SCHEMA.split(", ")]
    rows = jobs.rates(d.selectExpr("1 as machine", "at", "sent_bytes").cache(), "machine", "at", "sent_bytes").collect()
    assert len(rows) == 3 and min(r.rate for r in rows) >= 0 and sum(r.rate == 0 for r in rows) >= 1


def test_stream(spark, tmp_path):
    metrics.register(spark)
    q = spark.readStream.format("machine_metrics").load().writeStream.format("memory").queryName("load").option("checkpointLocation", str(tmp_path)).start()
    try:
        q.awaitTermination(8)
        assert spark.table("load").where("ram_percent between 0 and 100").count() >= 1
    finally:
        q.stop()
