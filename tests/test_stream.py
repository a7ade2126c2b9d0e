from velloom.streaming import jobs


def test_fold(spark, tmp_path):
    rows = [("a", 1, "create", None, None, 10.0), ("b", 2, "update", "running", 0.5, 11.0), ("a", 3, "update", "running", 0.2, None), ("a", 4, "update", "done", None, 11.2509), ("c", 5, "create", None, None, None)]
    ddl = "job_id string, seq long, op string, status string, progress double, at double"
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = jobs.fold_jobs(spark.readStream.schema(ddl).parquet(f"{tmp_path}/in"))
    q = out.writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("folded").collect()) == [("a", "done", 0.2, 3, 1250), ("c", "queued", 0.0, 1, None)]


def test_snapshots_can_be_polled(spark, tmp_path):
    ddl = "job_id string, seq long, op string, status string, progress double, at double"
    spark.createDataFrame([("a", 1, "create", None, None, 1.0)], ddl).write.parquet(f"{tmp_path}/in")
    q = jobs.snapshots(spark.readStream.schema(ddl).parquet(f"{tmp_path}/in"), "polled")
    q.processAllAvailable()
    assert [r.status for r in spark.table("polled").collect()] == ["queued"]
    q.stop()
