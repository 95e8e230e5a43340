"""An analysis as a graph of stages with written outputs: checked, skipped when nothing changed, resumed after a failure.

A stage's output lies in a folder named by its fingerprint: a digest of its name and version, the settings it reads and
the fingerprints of what it builds on. Inputs are known by their files' names, sizes and times. So a second run finds
all folders there and computes nothing, and a changed setting gives new names to the stages that read it and to those
that follow, no others. A folder counts once its writer has committed it, and a run that breaks off leaves the stages
before as they are.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import EngineConfig
from tessera.operators import overlap, profile, rolling, series

#: What a stage builds from: the frames it needs and wants by name (None for one it wants but can't have), and the settings.
Build = Callable[[Mapping[str, DataFrame | None], EngineConfig], DataFrame]


class MissingInputError(Exception):
    """A stage lacks something it can't do without."""


@dataclass(frozen=True)
class Stage:
    """``needs`` are hard: without one the stage fails. ``wants`` are soft: it is built without. ``settings`` are what it reads.

    With ``by_region`` the stage is built of the configured regions that its first need has; the others are reported,
    and without any the stage is skipped.
    """

    name: str
    build: Build
    needs: tuple[str, ...] = ()
    wants: tuple[str, ...] = ()
    settings: tuple[str, ...] = ()
    by_region: bool = False
    version: int = 1


@dataclass
class Outcome:
    """What became of a stage: computed, kept or skipped; where its output is; and what was said on the way."""

    state: str
    path: str | None = None
    fingerprint: str | None = None
    notes: list[str] = field(default_factory=list)


def digest(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:20]


class Graph:
    def __init__(self, stages: Sequence[Stage], inputs: Sequence[str] = ()):
        self.stages, self.inputs = {s.name: s for s in stages}, set(inputs)
        unknown = sorted({n for s in stages for n in (*s.needs, *s.wants)} - set(self.stages) - self.inputs)
        if unknown:
            raise ValueError(f"nothing makes {', '.join(unknown)}")
        if len(self.stages) < len(stages) or self.inputs & set(self.stages):
            raise ValueError("two stages or inputs share a name")
        self.order = self._sorted()

    def _sorted(self) -> list[str]:
        """Stages after what they build on; ValueError in a circle."""
        done: list[str] = []
        open_: set[str] = set()

        def visit(name: str) -> None:
            if name in done or name in self.inputs:
                return
            if name in open_:
                raise ValueError(f"{name} builds on itself")
            open_.add(name)
            for other in (*self.stages[name].needs, *self.stages[name].wants):
                visit(other)
            done.append(name)

        for name in self.stages:
            visit(name)
        return done

    def run(self, spark: SparkSession, root: str, paths: Mapping[str, str], config: EngineConfig, only: Sequence[str] = ()) -> dict[str, Outcome]:
        """Outputs of all stages, or of those that ``only`` names and what they build on, under ``root``.

        ``paths`` has the inputs' Parquet folders; one that is absent is missing to those that need it.
        """
        wanted = self._upstream(only) if only else set(self.stages)
        prints = {n: _files_digest(spark, paths[n]) for n in self.inputs if n in paths and _exists(spark, paths[n])}
        frames: dict[str, DataFrame] = {n: spark.read.parquet(paths[n]) for n in prints}
        out: dict[str, Outcome] = {}
        for name in (n for n in self.order if n in wanted):
            stage = self.stages[name]
            absent = [n for n in stage.needs if n not in frames]
            if any(out[n].state == "skipped" for n in absent if n in out):
                out[name] = Outcome("skipped", notes=[f"{', '.join(absent)} was skipped"])
                continue
            if absent:
                raise MissingInputError(f"{name} needs {', '.join(absent)}")
            notes = [f"built without {n}" for n in stage.wants if n not in frames]
            given = {n: frames.get(n) for n in (*stage.needs, *stage.wants)}
            regions = None
            if stage.by_region and config.regions:
                found = {r[0] for r in given[stage.needs[0]].filter(F.col("series").isin(*config.regions)).select("series").distinct().collect()}
                regions = sorted(found)
                notes += [f"no rows of {r}" for r in sorted(set(config.regions) - found)]
                if not found:
                    out[name] = Outcome("skipped", notes=notes)
                    continue
                given = {n: f.filter(F.col("series").isin(*regions)) if f is not None and n == stage.needs[0] else f for n, f in given.items()}
            own = digest(name, stage.version, {s: getattr(config, s) for s in stage.settings}, regions, {n: prints.get(n) for n in given})
            path = f"{root.rstrip('/')}/{name}/{own}"
            state = "kept" if _exists(spark, f"{path}/_SUCCESS") else "computed"
            if state == "computed":
                stage.build(given, config).write.mode("overwrite").parquet(path)
            prints[name], frames[name] = own, spark.read.parquet(path)
            out[name] = Outcome(state, path, own, notes)
        return out

    def _upstream(self, names: Sequence[str]) -> set[str]:
        found, left = set(), [n for n in names]
        while left:
            n = left.pop()
            if n in self.stages and n not in found:
                found.add(n)
                left += [*self.stages[n].needs, *self.stages[n].wants]
        return found


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _files_digest(spark: SparkSession, path: str) -> str:
    """A digest of a folder's file names, sizes and times, listed by Spark wherever it lies."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.concat_ws("|", "path", "length", "modificationTime").alias("f"))
    return digest(files.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("f")), "\n"), 256)).first()[0])


# --- the engine's own stages -----------------------------------------------------------------------------


def _profile(name: str) -> Build:
    return lambda given, config: profile.matrix_profile(given[name], config.window)


def _motifs(name: str, largest: bool = False) -> Build:
    return lambda given, config: profile.best_windows(given[name], config.discords if largest else config.motifs, max(config.window // 4, 1), largest=largest)


def _renamed(frame: DataFrame) -> DataFrame:
    return frame.withColumnRenamed("series", "indicator")


def _dense(given: Mapping[str, DataFrame | None], _: EngineConfig) -> DataFrame:
    return series.interpolate(series.densify(series.mean_series(given["observations"])))


def _anomalies(given: Mapping[str, DataFrame | None], _: EngineConfig) -> DataFrame:
    return series.climatology_anomaly(given["monthly"]).select("series", "date", "t", F.col("anomaly").alias("x"))


def _met(given: Mapping[str, DataFrame | None], config: EngineConfig) -> DataFrame:
    return overlap.lag_pairs(given["motifs"], _renamed(given["indicator_motifs"]), config.window)


def _shifts(given: Mapping[str, DataFrame | None], config: EngineConfig) -> DataFrame:
    """Rolling correlations of both sides' anomalies; without indicators, of the regions with the first of them."""
    mine = series.rolling_anomaly(given["monthly"]).select("series", "date", F.col("anomaly").alias("x"))
    other = given["indicators"]
    if other is None:
        first = mine.agg(F.min("series").alias("series"))
        return rolling.rolling_pearson(mine.join(mine.join(first, "series").select(F.col("series").alias("indicator"), "date", F.col("x").alias("y")), "date"), config.rolling)
    theirs = series.rolling_anomaly(other).select(F.col("series").alias("indicator"), "date", F.col("anomaly").alias("y"))
    return rolling.rolling_pearson(mine.join(theirs, "date"), config.rolling)


#: From observations (series, pixel, date, value) and indicators (series, date, t, x) to overlaps and correlations.
ENGINE = Graph(
    [
        Stage("monthly", _dense, ("observations",), by_region=True),
        Stage("anomalies", _anomalies, ("monthly",)),
        Stage("profile", _profile("anomalies"), ("anomalies",), settings=("window",)),
        Stage("motifs", _motifs("profile"), ("profile",), settings=("window", "motifs")),
        Stage("discords", _motifs("profile", largest=True), ("profile",), settings=("window", "discords")),
        Stage("indicator_profile", _profile("indicators"), ("indicators",), settings=("window",)),
        Stage("indicator_motifs", _motifs("indicator_profile"), ("indicator_profile",), settings=("window", "motifs")),
        Stage("pairs", _met, ("motifs", "indicator_motifs"), settings=("window",)),
        Stage("lag_intervals", lambda given, config: overlap.lag_intervals(given["pairs"], config.bootstraps, config.seed), ("pairs",), settings=("bootstraps", "seed")),
        Stage("correlations", _shifts, ("monthly",), ("indicators",), settings=("rolling",)),
    ],
    ("observations", "indicators"),
)
