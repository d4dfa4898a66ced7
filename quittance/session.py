"""Session settings for local runs, and the shared folder intermediate tables go to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from quittance.sources.files import delete


def local_session(
    cpus: int | str = "*",
    memory: str = "8g",
    app: str = "quittance",
    settings: dict[str, str] | None = None,
) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    partitions = "8" if cpus == "*" else str(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config(map=settings or {})
        .getOrCreate()
    )


def shuffle_width(spark: SparkSession) -> int:
    """How many partitions a shuffle of this session starts with."""
    plain = spark.conf.get("spark.sql.shuffle.partitions")
    initial = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", plain)
    return max(int(plain), int(initial or plain))


#: Folders handed out to this process and not removed yet.
_handed_out: list[str] = []


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under the cluster's shared ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets a temporary folder. What is
    written there stays until ``drop_work_folders`` is called, as only the caller knows when a lazy
    result that reads it has been used.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="quittance-")
    folder = f"{shared.rstrip('/')}/quittance/{purpose}-{uuid.uuid4().hex}"
    _handed_out.append(folder)
    return folder


def drop_work_folders(spark: SparkSession) -> int:
    """Delete all work folders handed out so far; call it once their readers are done.

    Returns how many there were.
    """
    count = len(_handed_out)
    while _handed_out:
        delete(spark, _handed_out.pop())
    return count
