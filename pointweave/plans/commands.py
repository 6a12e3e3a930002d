"""Named operations on a catalog of clouds, driven by command documents."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from pointweave.operators import aggregates as A, clustering as C, neighbors as N, outliers as O
from pointweave.sources import ply


class Catalog:
    """Clouds by number, with a name and one selected entry."""

    def __init__(self):
        self.clouds: dict[int, DataFrame] = {}
        self.names: dict[int, str] = {}
        self.selected: int | None = None

    def add(self, cloud: DataFrame, name: str) -> int:
        number = max(self.clouds, default=-1) + 1
        self.clouds[number], self.names[number] = cloud, name
        return number

    def get(self, number: int) -> DataFrame:
        if number not in self.clouds:
            raise KeyError(f"no cloud {number}")
        return self.clouds[number]

    def clone(self, number: int) -> int:
        return self.add(self.get(number), self.names[number] + "_Clone")

    def rename(self, number: int, name: str) -> None:
        self.get(number)
        self.names[number] = name

    def delete(self, number: int) -> None:
        self.get(number)
        del self.clouds[number], self.names[number]
        if self.selected == number:
            self.selected = None

    def select(self, number: int) -> None:
        self.get(number)
        self.selected = number


@dataclass(frozen=True)
class Parameters:
    """Typed parameters; a value of another type is refused."""

    @classmethod
    def parse(cls, given: dict):
        values = {}
        for f in fields(cls):
            if f.name in given:
                v = given[f.name]
                kind = type(f.default)
                if kind is float and isinstance(v, int) and not isinstance(v, bool):
                    v = float(v)
                if type(v) is not kind:
                    raise TypeError(f"{f.name} must be {kind.__name__}, got {type(v).__name__}")
                values[f.name] = v
        return cls(**values)


# Defaults of the command documents (they differ from the operators' own).
@dataclass(frozen=True)
class SOR(Parameters):
    KNeighbors: int = 50
    StdDevMulThresh: float = 1.0


@dataclass(frozen=True)
class ROR(Parameters):
    Radius: float = 0.5
    MinNeighborsInRadius: int = 5


@dataclass(frozen=True)
class PFOR(Parameters):
    KNeighbors: int = 30
    DistanceThreshold: float = 0.1


@dataclass(frozen=True)
class Curvature(Parameters):
    KNeighbors: int = 30
    CurvatureThreshold: float = 1.0


@dataclass(frozen=True)
class Deviation(Parameters):
    Radius: float = 0.1
    DeviationThreshold: float = 45.0


@dataclass(frozen=True)
class Clustering(Parameters):
    SearchRadius: float = 0.15
    AngleThreshold: float = 0.9


@dataclass(frozen=True)
class KDE(Parameters):
    Bandwidth: float = 0.1
    SearchRadius: float = 0.5


@dataclass(frozen=True)
class PointFit(Parameters):
    PointIndex: int = 0
    KNeighbors: int = 30
    DistanceThreshold: float = 0.07


OPERATORS: dict[str, tuple[type[Parameters], Callable[[DataFrame, Parameters], DataFrame]]] = {
    "PerformSOR": (SOR, lambda c, p: O.statistical(c, p.KNeighbors, p.StdDevMulThresh)),
    "PerformROR": (ROR, lambda c, p: O.radius(c, p.Radius, p.MinNeighborsInRadius)),
    "PerformPFOR": (PFOR, lambda c, p: O.plane_fit(c, p.KNeighbors, p.DistanceThreshold)),
    "PerformCurvatureAnalysis": (Curvature, lambda c, p: O.curvature(c, p.KNeighbors, p.CurvatureThreshold)),
    "PerformNormalDeviationAnalysis": (Deviation, lambda c, p: O.normal_deviation(c, p.Radius, p.DeviationThreshold)),
    "PerformClustering": (Clustering, lambda c, p: C.planar_clusters(c, p.SearchRadius, p.AngleThreshold)),
    "PerformKDE": (KDE, lambda c, p: N.kernel_density(c, p.SearchRadius, p.Bandwidth)),
    "ApplyPointPlaneFitting": (PointFit, lambda c, p: O.fit_at(c, p.PointIndex, p.KNeighbors, p.DistanceThreshold)),
}

# Step names of a composite filter and the defaults that differ there.
STEPS = {
    "SOR Filter": ("PerformSOR", {}),
    "ROR Filter": ("PerformROR", {}),
    "Curvature Analysis": ("PerformCurvatureAnalysis", {"CurvatureThreshold": 0.1}),
    "Normal Deviation Analysis": ("PerformNormalDeviationAnalysis", {"DeviationThreshold": 30.0}),
}


def register(name: str, parameters: type[Parameters], operator) -> None:
    OPERATORS[name] = (parameters, operator)


def run_operator(cloud: DataFrame, name: str, given: dict) -> DataFrame:
    parameters, operator = OPERATORS[name]
    return operator(cloud, parameters.parse(given))


def composite_mask(cloud: DataFrame, steps: list[dict]) -> DataFrame:
    """Fold the masks of the steps; each step sees the original cloud.

    The first valid step sets the mask whatever its operation says; unknown
    filters are skipped; an unknown operation leaves the mask as it is.
    """
    mask = None
    for step in steps:
        if step.get("FilterType") not in STEPS:
            continue
        name, defaults = STEPS[step["FilterType"]]
        found = run_operator(cloud, name, {**defaults, **step.get("Parameters", {})}).select("point_id", "is_outlier")
        mask = found if mask is None else A.combine_masks(mask, found, step.get("Operation", ""))
    return cloud.select("point_id", F.lit(False).alias("is_outlier")) if mask is None else mask


def run_command(catalog: Catalog, document: str) -> DataFrame | int | list[int] | None:
    """Execute one JSON command. ``DeletePoints`` replaces the cloud by its inliers, whatever the operator."""
    given = json.loads(document)
    name, number = given["Command"], given.get("PointCloudID")
    if name == "PerformCompositeFilter":
        result = composite_mask(catalog.get(number), given.get("Pipeline", []))
    elif name in OPERATORS:
        result = run_operator(catalog.get(number), name, given)
    elif name == "ClonePointCloud":
        return catalog.clone(number)
    elif name == "DeletePointCloud":
        return catalog.delete(number)
    elif name == "RenamePointCloud":
        return catalog.rename(number, given["NewName"])
    elif name == "LoadPointCloudFromPLY":
        spark = SparkSession.active()
        return [catalog.add(ply.read_points(spark, path), os.path.basename(path)) for path in given["FileNames"]]
    elif name == "SelectPointCloud":
        return catalog.select(number)
    else:
        raise ValueError(f"unknown command {name}")
    if given.get("DeletePoints") and "is_outlier" in result.columns:
        cloud = catalog.get(number)
        catalog.clouds[number] = cloud.join(result.where("is_outlier").select("point_id"), "point_id", "left_anti")
    return result


class StageFailed(RuntimeError):
    def __init__(self, index: int, label: str):
        super().__init__(f"stage {index} ({label}) failed")
        self.index, self.label = index, label


class Stages:
    """Transforms and checks in order; the first failing check stops the run."""

    def __init__(self):
        self.steps: list[tuple[str, Callable, bool]] = []

    def then(self, label: str, transform: Callable[[DataFrame], DataFrame]) -> "Stages":
        self.steps.append((label, transform, False))
        return self

    def check(self, label: str, violations: Callable[[DataFrame], DataFrame]) -> "Stages":
        """``violations`` returns the rows that must not exist."""
        self.steps.append((label, violations, True))
        return self

    def run(self, df: DataFrame) -> DataFrame:
        for i, (label, step, is_check) in enumerate(self.steps):
            if not is_check:
                df = step(df)
            elif not step(df).isEmpty():
                raise StageFailed(i, label)
        return df
