"""The log of deployments: one file per deployment, which appears whole, once, or not at all.

    <folder>/log/<number>.json        a deployment; whoever creates the file has taken the number
    <folder>/history/<number>.json    the deployments up to that number, a hundred to a file
    <folder>/last                     a number that has been taken; the newest may be a few further on

The file that takes a number is the record itself, so going live is one step: a driver that dies
before it has changed nothing, one that dies after it is live. Numbers have no gaps. To find the
newest record a reader begins at ``last`` and asks for one number after the other, so the time it
takes does not grow with the number of deployments; ``last`` only shortens the way. Every
``FOLDED`` deployments are written to the history, and older files leave the log.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quittance.sources import files

#: Deployments in a file of the history. Twice as many files are in the log at most.
FOLDED = 100
_STORED_DDL = "deployment_no BIGINT, active_schema STRING, build STRING, deployed_us BIGINT"
#: Times a reader looks for a record that others fold away meanwhile.
_TRIES = 20


@dataclass(frozen=True)
class Deployment:
    deployment_no: int
    active_schema: str
    build: str
    deployed_us: int  # microseconds since 1970, UTC


@dataclass(frozen=True)
class DeploymentLog:
    spark: SparkSession
    folder: str

    def _record(self, number: int) -> str:
        return f"{self.folder}/log/{number:012d}.json"

    def _read(self, number: int) -> Deployment | None:
        text = files.read_text(self.spark, self._record(number))
        return None if text is None else Deployment(**json.loads(text))

    def _numbers(self) -> list[int]:
        names = files.names_in(self.spark, f"{self.folder}/log")
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def _start(self, known: bool) -> int:
        """A number that has been taken, or 0: by ``last``, or else by listing the log."""
        hint = files.read_text(self.spark, f"{self.folder}/last") if known else None
        number = int(hint) if hint and hint.isdigit() else 0
        return number or max(self._numbers(), default=0)

    def latest(self) -> Deployment | None:
        """The newest deployment; None before the first. Raises ValueError if it cannot be read."""
        for attempt in range(_TRIES):
            number = self._start(known=attempt == 0)
            found = self._read(number) if number else None
            if number and found is None:
                continue  # folded away since ``last`` was read
            while (further := self._read(number + 1)) is not None:
                number, found = number + 1, further
            return found
        raise ValueError(f"the log of deployments in {self.folder} has lost its newest record")

    def append(self, active_schema: str, build: str, deployed_us: int) -> Deployment:
        """Add a deployment under the next number; of several at once each gets its own."""
        newest = self.latest()
        number = newest.deployment_no + 1 if newest else 1
        while True:
            made = Deployment(number, active_schema, build, deployed_us)
            if files.put_once(self.spark, self._record(number), json.dumps(asdict(made)) + "\n"):
                break
            number += 1
        files.replace_text(self.spark, f"{self.folder}/last", str(number))
        if number % FOLDED == 0:
            self._fold(number)
        return made

    def _fold(self, number: int) -> None:
        """Write the last ``FOLDED`` records to the history; drop those folded before from the log."""
        path = f"{self.folder}/history/{number:012d}.json"
        rows = [self._read(n) for n in range(number - FOLDED + 1, number + 1)]
        files.put_once(self.spark, path, "".join(json.dumps(asdict(r)) + "\n" for r in rows if r))
        for n in self._numbers():
            folded = -(-n // FOLDED) * FOLDED
            if n <= number - FOLDED and files.exists(
                self.spark, f"{self.folder}/history/{folded:012d}.json"
            ):
                files.delete(self.spark, self._record(n))

    def all(self) -> DataFrame:
        """Every deployment so far: deployment_no, active_schema, build, deployed_at."""
        places = [f"{self.folder}/{part}" for part in ("history", "log")]
        places = [p for p in places if files.names_in(self.spark, p)]
        stored = (
            self.spark.read.schema(_STORED_DDL).option("mode", "FAILFAST").json(places)
            if places
            else self.spark.createDataFrame([], _STORED_DDL)
        )
        return with_time(stored.dropDuplicates(["deployment_no"]))

    def newest(self) -> DataFrame:
        """``latest`` as one row, or none."""
        found = self.latest()
        rows = [tuple(asdict(found).values())] if found else []
        return with_time(self.spark.createDataFrame(rows, _STORED_DDL))


def with_time(stored: DataFrame) -> DataFrame:
    return stored.select(
        *["deployment_no", "active_schema", "build"],
        F.timestamp_micros("deployed_us").alias("deployed_at"),
    )
