"""Stage graphs: what is computed, kept, skipped, and what fails."""

import datetime as dt
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import EngineConfig
from tessera.plans import graph
from tessera.plans.graph import Graph, MissingInputError, Stage


def states(outcomes):
    return {n: o.state for n, o in outcomes.items()}


@pytest.fixture
def small(spark, tmp_path):
    spark.createDataFrame([("a", 1.0), ("b", 2.0)], "series string, x double").write.parquet(f"{tmp_path}/rows")
    built = []

    def stage(name, needs, wants=(), settings=(), **more):
        def build(given, config):
            built.append(name)
            return given[needs[0]].withColumn(name, F.lit(len([v for v in given.values() if v is not None])))

        return Stage(name, build, needs, wants, settings, **more)

    g = Graph([stage("last", ("one", "two")), stage("one", ("rows",), settings=("window",)), stage("two", ("rows",), ("extra",), settings=("lags",))], ("rows", "extra"))
    return g, built, f"{tmp_path}/out", {"rows": f"{tmp_path}/rows"}


def test_a_second_run_computes_nothing_and_a_setting_only_what_follows(spark, small, tmp_path):
    g, built, root, paths = small
    config = EngineConfig()
    first = g.run(spark, root, paths, config)
    assert states(first) == dict.fromkeys(("one", "two", "last"), "computed") and first["two"].notes == ["built without extra"]
    assert states(g.run(spark, root, paths, config)) == dict.fromkeys(("one", "two", "last"), "kept") and len(built) == 3
    changed = g.run(spark, root, paths, replace(config, lags=3))
    assert states(changed) == {"one": "kept", "two": "computed", "last": "computed"}
    assert states(g.run(spark, root, paths, replace(config, motifs=9))) == dict.fromkeys(("one", "two", "last"), "kept")
    spark.range(1).write.parquet(f"{tmp_path}/extra")
    assert states(g.run(spark, root, paths | {"extra": f"{tmp_path}/extra"}, config)) == {"one": "kept", "two": "computed", "last": "computed"}
    spark.createDataFrame([("c", 3.0)], "series string, x double").write.mode("append").parquet(paths["rows"])
    again = g.run(spark, root, paths, config)
    assert set(states(again).values()) == {"computed"} and spark.read.parquet(again["last"].path).count() == 3


def test_a_run_that_broke_off_goes_on_where_it_was(spark, small):
    g, built, root, paths = small
    broken = g.stages["two"]
    g.stages["two"] = replace(broken, build=lambda given, config: given["rows"].select(F.raise_error(F.lit("broken")).alias("x")))
    with pytest.raises(Exception, match="broken"):
        g.run(spark, root, paths, EngineConfig())
    g.stages["two"] = broken
    assert states(g.run(spark, root, paths, EngineConfig())) == {"one": "kept", "two": "computed", "last": "computed"} and built == ["one", "two", "last"]


def test_missing_inputs_and_bad_graphs(spark, small):
    g, _, root, _ = small
    with pytest.raises(MissingInputError, match="one needs rows"):
        g.run(spark, root, {"rows": "/nowhere/at/all"}, EngineConfig())
    plain = lambda given, config: None
    with pytest.raises(ValueError, match="builds on itself"):
        Graph([Stage("a", plain, ("b",)), Stage("b", plain, ("a",))])
    with pytest.raises(ValueError, match="nothing makes x"):
        Graph([Stage("a", plain, ("x",))])
    with pytest.raises(ValueError, match="share a name"):
        Graph([Stage("a", plain), Stage("a", plain)])


def test_the_engines_own_stages(spark, tmp_path):
    rng = np.random.default_rng(1)
    days = [dt.date(1995 + i // 12, i % 12 + 1, 1) for i in range(70)]
    spark.createDataFrame([(s, p, d, float(rng.normal())) for s in ("EUROPE", "ASIA") for p in range(2) for d in days], "series string, pixel int, date date, value double").write.parquet(f"{tmp_path}/obs")
    spark.createDataFrame([(s, d, i, float(rng.normal())) for s in ("AO",) for i, d in enumerate(days)], "series string, date date, t long, x double").write.parquet(f"{tmp_path}/ind")
    config = EngineConfig(regions=("ASIA", "MARS"), window=12, rolling=24, bootstraps=50)
    paths = {"observations": f"{tmp_path}/obs", "indicators": f"{tmp_path}/ind"}
    got = graph.ENGINE.run(spark, f"{tmp_path}/out", paths, config)
    assert set(states(got).values()) == {"computed"} and got["monthly"].notes == ["no rows of MARS"]
    assert {r.series for r in spark.read.parquet(got["motifs"].path).collect()} == {"ASIA"}
    later = graph.ENGINE.run(spark, f"{tmp_path}/out", paths, replace(config, bootstraps=60))
    assert [n for n, o in later.items() if o.state == "computed"] == ["lag_intervals"]
    part = graph.ENGINE.run(spark, f"{tmp_path}/out", {"observations": f"{tmp_path}/obs"}, config, only=("correlations",))
    assert states(part) == {"monthly": "kept", "correlations": "computed"} and part["correlations"].notes == ["built without indicators"]
    none = graph.ENGINE.run(spark, f"{tmp_path}/out", paths, replace(config, regions=("MARS",)), only=("motifs",))
    assert set(states(none).values()) == {"skipped"}
