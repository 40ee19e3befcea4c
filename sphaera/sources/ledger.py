"""A run's ledger: stage tables in versions by key, published whole or not at all, and what follows from them.

Under a root folder a stage has `data/part=<stamp>` with its rows and `entries/part=<stamp>` with a row (key, at) for every
key that the stamp speaks for: `at` is the part that holds the key's rows, or -1 if the key has been taken out.  A stamp
counts only once `published/<stamp>.json` is there; that file is written under another name and then moved, so an
interrupted step leaves folders that nobody reads.  The latest published entry of a key is the one in force, so a
later part replaces keys and not tables, and an earlier one comes back by an entry that points to it.

Stamps ascend over all stages.  A key of a step is up to date if its entry was made with the step's present settings and
is younger than the entries of that key in all stages it needs; a whole step (one key, 0) is if it is younger than every
entry of them.  One run at a time writes a ledger.  Only the list of stamps passes through the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphaera.sources.files import locate

GONE = -1


@dataclass(frozen=True)
class Step:
    """One stage of a run: f takes the tables it needs, in order, cut to the keys at hand (all keys if whole)."""

    name: str
    needs: tuple[str, ...]
    f: Callable[..., DataFrame]
    whole: bool = False
    settings: dict = field(default_factory=dict)


class Ledger:
    """key: the column that stage tables are keyed by; per_part: keys of a part, at most what an interruption costs."""

    def __init__(self, spark: SparkSession, root: str, key: str = "prd", per_part: int = 256) -> None:
        self.spark, self.root, self.key, self.per_part = spark, root.rstrip("/"), key, per_part

    def stamps(self, stage: str | None = None) -> list[dict]:
        """Published stamps in order: stamp, stage, settings, kind."""
        fs, at = locate(f"{self.root}/published")
        files = [f for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if f.base_name.endswith(".json")]
        out = []
        for f in sorted(files, key=lambda f: f.base_name):
            with fs.open_input_stream(f.path) as s:
                out.append(json.loads(s.read()))
        return [r for r in out if stage in (None, r["stage"])]

    def _folders(self) -> list[tuple[str, int, str]]:
        """(stage, stamp, path) of all parts, published or not; two listings a stage, none of files."""
        fs, at = locate(self.root)
        ls = lambda path: [f for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if f.type == pafs.FileType.Directory]
        found = [(stage.base_name, part) for stage in ls(at) for kind in ("data", "entries") for part in ls(f"{stage.path}/{kind}")]
        return [(stage, int(f.base_name.split("=")[1]), f.path) for stage, f in found if f.base_name.startswith("part=")]

    def _next(self) -> int:
        """Above all stamps in use, those of interrupted steps included."""
        return max([*(n for _, n, _ in self._folders()), *(r["stamp"] for r in self.stamps())], default=0) + 1

    def _publish(self, stamp: int, stage: str, kind: str, settings: dict) -> None:
        fs, at = locate(f"{self.root}/published")
        fs.create_dir(at, recursive=True)
        hidden = f"{at}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(hidden) as s:
            s.write(json.dumps({"stamp": stamp, "stage": stage, "kind": kind, "settings": settings}, sort_keys=True).encode())
        fs.move(hidden, f"{at}/{stamp:09d}.json")

    def entries(self, stage: str) -> DataFrame:
        """key, stamp, at: the entry in force of every key, taken-out ones included.

        If settings changed, entries made with others are still in force until their keys have been worked on again."""
        own = [r["stamp"] for r in self.stamps(stage)]
        if not own:
            return self.spark.createDataFrame([], "key long, stamp long, at long")
        rows = self.spark.read.schema("key long, at long, part long").parquet(f"{self.root}/{stage}/entries")
        return rows.where(F.col("part").isin(own)).groupBy("key").agg(F.max("part").alias("stamp"), F.max_by("at", "part").alias("at"))

    def read(self, stage: str, keys: DataFrame | None = None) -> DataFrame:
        """The rows in force of a stage, of all keys or of those given (key)."""
        live = self.entries(stage).where(F.col("at") != GONE).select("key", F.col("at").alias("part"))
        parts = [r["stamp"] for r in self.stamps(stage) if r["kind"] == "rows"]
        if not parts:
            raise ValueError(f"stage {stage} has no rows")
        if keys is not None:
            live = live.join(keys, "key", "left_semi")
        rows = self.spark.read.parquet(f"{self.root}/{stage}/data").where(F.col("part").isin(parts))
        return rows.withColumn("part", F.col("part").cast("long")).join(live.withColumnRenamed("key", "_key"), ["_key", "part"], "left_semi").drop("_key", "part")

    def write(self, stage: str, rows: DataFrame, keys: DataFrame, settings: dict | None = None, whole: bool = False) -> int:
        """Publish rows as the present state of keys (key); a key without rows is kept as an empty one.

        Null keys have no place in a ledger: their rows are an error."""
        stamp = self._next()
        at = F.lit(0).cast("long") if whole else F.col(self.key).cast("long")
        out = rows.withColumn("_key", at)
        out = out.withColumn("_key", F.when(F.col("_key").isNull(), F.raise_error(F.lit(f"stage {stage}: a row without {self.key}"))).otherwise(F.col("_key")))
        out.write.mode("overwrite").parquet(f"{self.root}/{stage}/data/part={stamp}")
        self._enter(stage, keys.select("key", F.lit(stamp).cast("long").alias("at")), stamp, "rows", settings or {})
        return stamp

    def _enter(self, stage: str, entries: DataFrame, stamp: int, kind: str, settings: dict) -> None:
        entries.write.mode("overwrite").parquet(f"{self.root}/{stage}/entries/part={stamp}")
        self._publish(stamp, stage, kind, settings)

    def take_out(self, stage: str, keys: DataFrame) -> None:
        self._enter(stage, keys.select("key", F.lit(GONE).cast("long").alias("at")), self._next(), "out", {})

    def revert(self, stage: str, keys: DataFrame) -> None:
        """Bring the rows back that keys (key) had before the ones in force; keys with one state only stay as they are.

        The states of a key are its parts in the order in which they came, so a second call goes one further back.
        A state brought back holds, whatever its settings, until something that it needs is newer."""
        own = [r["stamp"] for r in self.stamps(stage)]
        rows = self.spark.read.schema("key long, at long, part long").parquet(f"{self.root}/{stage}/entries").where(F.col("part").isin(own))
        now = rows.groupBy("key").agg(F.max_by("at", "part").alias("now"))
        before = rows.where(F.col("at") != GONE).join(now, "key").where((F.col("at") < F.col("now")) | (F.col("now") == GONE)).groupBy("key").agg(F.max("at").alias("at"))
        self._enter(stage, before.join(keys, "key", "left_semi"), self._next(), "back", {})

    # what is to be done

    def pending(self, step: Step) -> DataFrame:
        """key: what a step has to work on; for a whole step the key 0 or nothing."""
        mine = self._made_with(step)
        needed = [self.entries(n) for n in step.needs]
        if step.whole:
            newest = reduce(DataFrame.unionByName, needed).agg(F.max("stamp").alias("newest"))  # one row
            own = mine.agg(F.max("stamp").alias("stamp"))
            return newest.crossJoin(own).where("newest IS NOT NULL AND (stamp IS NULL OR stamp < newest)").select(F.lit(0).cast("long").alias("key"))
        ready = needed[0].where(F.col("at") != GONE).select("key", F.col("stamp").alias("newest"))
        for e in needed[1:]:
            ready = ready.join(e.where(F.col("at") != GONE).select("key", F.col("stamp").alias("s")), "key").select("key", F.greatest("newest", "s").alias("newest"))
        return ready.join(mine, "key", "left").where("stamp IS NULL OR stamp < newest").select("key")

    def _made_with(self, step: Step) -> DataFrame:
        """key, stamp of the entries that were made with the step's settings, or brought back by hand."""
        want = json.loads(json.dumps(step.settings))
        good = [r["stamp"] for r in self.stamps(step.name) if r["settings"] == want or r["kind"] == "back"]
        return self.entries(step.name).where((F.col("at") != GONE) & F.col("stamp").isin(good)).select("key", "stamp")

    def lost(self, step: Step) -> DataFrame:
        """key: what a step holds although a stage it needs has taken it out."""
        mine = self.entries(step.name).where(F.col("at") != GONE).select("key")
        if step.whole:
            return mine.limit(0)
        out = [self.entries(n).where(F.col("at") == GONE).select("key") for n in step.needs]
        return mine.join(reduce(DataFrame.unionByName, out).distinct(), "key", "left_semi")

    def run(self, steps: list[Step]) -> dict[str, int]:
        """Bring all steps up to date, in the order given; returns the number of keys each has worked on.

        Keys are worked on in parts of about per_part, dealt by hash; each is published as soon as it is written, so a
        run that was stopped goes on with the keys that are still pending."""
        done = {}
        for step in steps:
            gone = self.lost(step)
            if not gone.isEmpty():
                self.take_out(step.name, gone)
            total = done[step.name] = self.pending(step).count()
            parts = -(-total // self.per_part)
            for k in range(parts):
                todo = self.pending(step)
                if k < parts - 1:
                    todo = todo.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == k)
                # the tables fix the keys of this part: the step's own entries do not change before it is published
                given = [self.read(n, None if step.whole else todo) for n in step.needs]
                self.write(step.name, step.f(*given), todo, step.settings, step.whole)
        return done

    def clean(self) -> int:
        """Delete what interrupted steps left behind; returns the number of folders."""
        known = {(r["stage"], r["stamp"]) for r in self.stamps()}
        fs, _ = locate(self.root)
        left = [path for stage, stamp, path in self._folders() if (stage, stamp) not in known]
        for path in left:
            fs.delete_dir(path)
        return len(left)
