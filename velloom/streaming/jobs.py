"""Job state and counter rates as streams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FOLDED = "job_id string, status string, progress double, changes long, elapsed_ms long"
STATUS = ("queued", "running", "done", "error")


def fold_jobs(changes: DataFrame) -> DataFrame:
    """STR1, STR3: the state of each job after each batch of changes (job_id, seq, op, status, progress, at).

    ``op`` create makes a job, update changes the fields that aren't null; an update of an unknown job does nothing. Changes of one
    batch apply in the order of seq. ``at`` is a change's time in epoch seconds: elapsed_ms counts from the job's creation, truncated;
    null where a time is missing. The state is one row a job.
    """

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else None
        for c in pd.concat(list(frames)).sort_values("seq").itertuples():
            at = None if pd.isna(c.at) else float(c.at)
            if c.op == "create":
                now = [STATUS[0], 0.0, 1, at, None if at is None else 0]
            elif now is not None:
                took = None if at is None or now[3] is None else int((at - now[3]) * 1000)
                now = [now[0] if pd.isna(c.status) else c.status, now[1] if pd.isna(c.progress) else float(c.progress), now[2] + 1, now[3], took]
        if now is not None:
            state.update(tuple(now))
            yield pd.DataFrame({"job_id": [key[0]], "status": [now[0]], "progress": [now[1]], "changes": [now[2]], "elapsed_ms": pd.array([now[4]], "Int64")})

    return changes.groupBy("job_id").applyInPandasWithState(run, FOLDED, "status string, progress double, changes long, created double, elapsed_ms long", "update", GroupStateTimeout.NoTimeout)


def snapshots(changes: DataFrame, name: str):
    """STR2: a running query whose latest job states can be read by ``name`` as a table (of the driver: a view to poll, not a store)."""
    return fold_jobs(changes).writeStream.outputMode("update").format("memory").queryName(name).start()
