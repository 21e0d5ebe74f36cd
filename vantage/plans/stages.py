"""The stage graph: order, dependencies, ranges, what to run and what to load, resumption."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stages in order.
ORDER = ("sample_views", "normalize", "render", "sample_positions", "train_field", "sample_embeddings", "transform", "cluster", "select")
#: Direct dependencies of each stage.
DEPENDENCIES = {
    "sample_views": (),
    "normalize": (),
    "render": ("sample_views", "normalize"),
    "sample_positions": ("normalize",),
    "train_field": ("render", "sample_positions"),
    "sample_embeddings": ("train_field", "sample_positions"),
    "transform": ("sample_embeddings",),
    "cluster": ("transform",),
    "select": ("cluster", "sample_views", "render", "train_field"),
}


def between(start: str | None, end: str | None) -> list[str]:
    """Stages from start to end, both included; None is the first or last."""
    a = ORDER.index(start) if start else 0
    b = ORDER.index(end) if end else len(ORDER) - 1
    return list(ORDER[a : b + 1])


def depends_on(stage: str, other: str, transitive: bool = False) -> bool:
    """Direct, or (transitive) by order: every later stage depends on every earlier one."""
    return ORDER.index(stage) > ORDER.index(other) if transitive else other in DEPENDENCIES[stage]


def required_by(stage: str, stages: list[str], transitive: bool = False) -> bool:
    return any(depends_on(s, stage, transitive) for s in stages)


def select_stages(wanted: list[str]) -> list[str]:
    """The wanted stages in order; unknown or no stages are an error."""
    if unknown := set(wanted) - set(ORDER):
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    if not wanted:
        raise ValueError("no stages")
    return [s for s in ORDER if s in wanted]


def should_run(stage: str, stages: list[str]) -> bool:
    return stage in stages


def should_load(stage: str, stages: list[str]) -> bool:
    """A stage that does not run is loaded if one that runs needs it."""
    return stage not in stages and required_by(stage, stages)


def stage_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ORDER)), "ord int, stage string")


def edge_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, d) for s in ORDER for d in DEPENDENCIES[s]], "stage string, needs string")


def unfinished(items: DataFrame, finished: DataFrame, key: str = "uid") -> DataFrame:
    """Items still to do."""
    return items.join(finished.select(key), key, "left_anti")


def progress(items: DataFrame, stages: list[str]) -> DataFrame:
    """(total): number of item stages to do."""
    return items.agg((F.count(F.lit(1)) * len(stages)).alias("total"))
