from types import SimpleNamespace

import pyarrow as pa
import pytest

from velloom.llm import shared


def test_a_cluster_must_name_its_shared_folder():
    unset = SimpleNamespace(isEmpty=lambda: True)
    sc = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *a: None)))


def test_giving_back_passes_everything_on():
    batches = [pa.record_batch([pa.array([i])], names=["x"]) for i in range(3)]
    assert [b.column(0)[0].as_py() for b in shared.giving_back(lambda some: (b for b in some))(iter(batches))] == [0, 1, 2]
    assert [b.num_rows for b in shared.by_batch(lambda b: b)(iter([*batches, batches[0].slice(0, 0)]))] == [1, 1, 1]


def test_written_tables_keep_rows_and_folders_differ(spark):
    df = spark.range(10).selectExpr("id", "monotonically_increasing_id() row")
    kept = shared.written(df, "rows")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, kept.repartition(3).collect())) and kept.count() == 10
    assert shared.work_dir(spark, "a") != shared.work_dir(spark, "a")
