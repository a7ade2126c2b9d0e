"""Samples of machine load as a Spark data source, for batch reads and streams."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "at double, cpu_percent double, ram_used_gb double, ram_total_gb double, ram_percent double, sent_bytes long, received_bytes long, gpu struct<name:string,util_percent:int,mem_used_gb:double,mem_total_gb:double>"


def gpu() -> tuple | None:
    """The first GPU's name, load and memory, by the management library where it is installed; null without it or without a GPU."""
    try:
        import pynvml
    except ImportError:
        return None
    try:
        pynvml.nvmlInit()
        one = pynvml.nvmlDeviceGetHandleByIndex(0)
        name, memory = pynvml.nvmlDeviceGetName(one), pynvml.nvmlDeviceGetMemoryInfo(one)
        return name.decode() if isinstance(name, bytes) else name, pynvml.nvmlDeviceGetUtilizationRates(one).gpu, round(memory.used / 1e9, 2), round(memory.total / 1e9, 2)
    except pynvml.NVMLError:
        return None


def sample() -> tuple:
    """One row of SCHEMA, of the machine that this runs on; all but the time and the GPU null where psutil is missing."""
    try:
        import psutil
    except ImportError:
        return (time.time(), *[None] * 6, gpu())
    ram, net = psutil.virtual_memory(), psutil.net_io_counters()
    sent, received = (net.bytes_sent, net.bytes_recv) if net else (None, None)
    return time.time(), round(psutil.cpu_percent(0.05), 1), round(ram.used / 1e9, 2), round(ram.total / 1e9, 2), float(ram.percent), sent, received, gpu()


class _Batch(DataSourceReader):
    def __init__(self, samples: int, every: float):
        self.samples, self.every = samples, every

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for i in range(self.samples):
            if i:
                time.sleep(self.every)
            yield sample()


class _Stream(SimpleDataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        return iter([sample()]), {"n": start["n"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """A sample can't be taken a second time: a replayed batch holds as many new ones."""
        return iter([sample() for _ in range(end["n"] - start["n"])])


class Metrics(DataSource):
    """``spark.read.format("machine_metrics")``; options ``samples`` (1) and ``every`` seconds (1). Counters turn into rates by operators.jobs.rates."""

    @classmethod
    def name(cls) -> str:
        return "machine_metrics"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(int(self.options.get("samples", 1)), float(self.options.get("every", 1)))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Metrics)


def poll(spark: SparkSession, every: float = 1.0, hidden: bool = False):
    """STR6: a writer of one sample every second, every other second while nobody looks; the caller names the sink and starts it."""
    register(spark)
    return spark.readStream.format("machine_metrics").load().writeStream.trigger(processingTime=f"{every * (2 if hidden else 1):g} seconds")
