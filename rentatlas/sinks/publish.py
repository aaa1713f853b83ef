"""A period's tables published as a whole.

All tables of a run are written below an attempt folder. Behind the last of them one small file,
renamed into place, names the attempt as the period's current one: the switch, which is also the
manifest of its tables and row counts. Only then are the folders moved to where readers look. A run that stops
before the switch leaves the old period as it was; one that stops behind it is finished by the next
run or reader (``recover``). The next run of the period removes attempts that were lost.

One run at a time may publish a period; different periods don't touch each other's files.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ATTEMPTS, SWITCHES, MANIFESTS = "_attempts", "_switches", "_manifests"


class Files:
    """The few file system calls a publication needs, on any file system Spark can write to."""

    def __init__(self, spark: SparkSession, root: str):
        self.make = spark._jvm.org.apache.hadoop.fs.Path
        self.io = spark._jvm.org.apache.commons.io.IOUtils
        self.fs = self.make(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.make(path))

    def names(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.make(path)))

    def delete(self, path: str) -> None:
        self.fs.delete(self.make(path), True)

    def move(self, source: str, target: str) -> None:
        """``source`` in the place of ``target``; what stood there goes."""
        self.delete(target)
        self.fs.mkdirs(self.make(target).getParent())
        if not self.fs.rename(self.make(source), self.make(target)):
            raise OSError(f"could not move {source} to {target}")

    def write(self, path: str, text: str) -> None:
        """The file is there whole or not at all."""
        unfinished = f"{path}.{uuid.uuid4().hex}.unfinished"
        stream = self.fs.create(self.make(unfinished), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.move(unfinished, path)

    def read(self, path: str) -> str:
        stream = self.fs.open(self.make(path))
        try:
            return self.io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def rename_suffix(self, folder: str, old: str, new: str) -> None:
        """Data files below ``folder`` take another suffix."""
        found = self.fs.listFiles(self.make(folder), True)
        paths = []
        while found.hasNext():
            paths.append(found.next().getPath())
        for path in paths:
            name = path.getName()
            if name.startswith("part-") and name.endswith(old):
                self.fs.rename(path, self.make(path.getParent(), name[: -len(old)] + new))


class Publication:
    """``with Publication(spark, out, period) as p:`` write below ``p.region`` and ``p.towns``."""

    def __init__(self, spark: SparkSession, out: str, period: str):
        self.out, self.period = out.rstrip("/"), period
        self.files = Files(spark, out)
        self.name = uuid.uuid4().hex
        self.attempt = f"{self.out}/{ATTEMPTS}/{period}/{self.name}"
        self.region, self.towns = f"{self.attempt}/region", f"{self.attempt}/towns"
        self.seen: list[tuple[Observation, dict[str, str]]] = []

    def __enter__(self) -> Publication:
        recover(self.files, self.out, self.period)
        self.files.delete(f"{self.out}/{ATTEMPTS}/{self.period}")
        return self

    def __exit__(self, kind: type | None, *error: object) -> None:
        if kind is not None:
            self.files.delete(self.attempt)
            return
        tables: dict[str, int] = {}
        for observation, names in self.seen:
            tables |= {names[k]: int(n or 0) for k, n in observation.get.items()}
        manifest = {"period": self.period, "attempt": self.name, "tables": tables}
        text = json.dumps(manifest, indent=1, sort_keys=True)
        self.files.write(f"{self.out}/{SWITCHES}/{self.period}.json", text)
        roll_forward(self.files, self.out, self.period, self.name)

    def counted(self, df: DataFrame, tables: dict[str, Column | None]) -> DataFrame:
        """``df`` whose rows are counted as they pass to its writer, per table of the manifest.

        A table's condition tells which rows are its own; None means all.
        """
        observation, names = Observation(), {}
        metrics = []
        for i, (table, own) in enumerate(tables.items()):
            names[f"n{i}"] = table
            metrics.append(F.count(F.lit(1) if own is None else F.when(own, 1)).alias(f"n{i}"))
        self.seen.append((observation, names))
        return df.observe(observation, *metrics)


def roll_forward(files: Files, out: str, period: str, name: str) -> None:
    """Move what the switch points to into place; may be repeated from any point."""
    attempt = f"{out}/{ATTEMPTS}/{period}/{name}"
    for part, target in (
        ("towns", f"{out}/towns/period={period}"), ("region", f"{out}/period={period}"),
    ):
        if files.exists(f"{attempt}/{part}"):
            files.move(f"{attempt}/{part}", target)
    files.delete(attempt)
    files.move(f"{out}/{SWITCHES}/{period}.json", f"{out}/{MANIFESTS}/{period}.json")


def recover(files: Files, out: str, period: str) -> None:
    """Finish a publication that stopped behind its switch."""
    switch = f"{out}/{SWITCHES}/{period}.json"
    if files.exists(switch):
        roll_forward(files, out, period, json.loads(files.read(switch))["attempt"])


def published(spark: SparkSession, out: str, period: str) -> dict:
    """The manifest of a period's current tables, whose files are in place when this returns."""
    out = out.rstrip("/")
    files = Files(spark, out)
    recover(files, out, period)
    path = f"{out}/{MANIFESTS}/{period}.json"
    if not files.exists(path):
        raise FileNotFoundError(f"{period} has not been published below {out}")
    return json.loads(files.read(path))
