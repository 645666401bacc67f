"""Fit/transform surface: Spark ML estimators, so every step also fits a ``pyspark.ml.Pipeline``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.base import Estimator, Model, Transformer
from pyspark.ml.param import Params
from pyspark.ml.util import (
    DefaultParamsReader,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame

INVALID_MODES = ("error", "skip", "keep")


def check_invalid(mode: str) -> str:
    if mode not in INVALID_MODES:
        raise ValueError(f"invalid must be one of {INVALID_MODES}, not {mode!r}")
    return mode


def output_names(
    columns: Sequence[str], outputs: Sequence[str] | None, pattern: str
) -> list[str]:
    """Output columns: as given, or made from the input names."""
    names = [pattern.format(c) for c in columns] if outputs is None else list(outputs)
    if len(names) != len(columns):
        raise ValueError("columns and output_columns differ in length")
    return names


class StepWriter(MLWriter):
    """Writes a step: its settings and fitted numbers as JSON, its tables as Parquet beside it."""

    def __init__(self, step: Params):
        super().__init__()
        self.step = step

    def saveImpl(self, path: str) -> None:
        tables: dict[str, DataFrame] = {}
        state = _packed(self.step, tables, "")
        DefaultParamsWriter.saveMetadata(self.step, path, self.sparkSession, {"state": state})
        for name, table in tables.items():
            table.write.parquet(f"{path}/tables/{name}")


class StepReader(MLReader):
    """Reads what ``StepWriter`` wrote; tables stay where they are."""

    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> Params:
        name = f"{self.kind.__module__}.{self.kind.__qualname__}"
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession, name)
        step = _unpacked(self.kind, metadata["state"], lambda t: self.sparkSession.read.parquet(f"{path}/tables/{t}"))
        step._resetUid(metadata["uid"])
        return step


def _packed(step: Params, tables: dict[str, DataFrame], prefix: str) -> dict[str, object]:
    """The attributes that the step's constructor gave it; names with an underscore are passing."""
    own = set(vars(step)) - set(vars(Params()))
    state: dict[str, object] = {}
    for name in sorted(n for n in own if not n.startswith("_")):
        value = getattr(step, name)
        if isinstance(value, DataFrame):
            tables[prefix + name] = value
            value = {"table": prefix + name}
        elif isinstance(value, Params):
            value = {"step": type(value).__name__, "state": _packed(value, tables, f"{prefix}{name}.")}
        state[name] = {"value": value}
    return state


def _unpacked(kind: type, state: dict, table: Callable[[str], DataFrame]) -> Params:
    step = kind.__new__(kind)
    Params.__init__(step)
    for name, held in state.items():
        value = held["value"]
        if isinstance(value, dict) and set(value) == {"table"}:
            value = table(value["table"])
        elif isinstance(value, dict) and set(value) == {"step", "state"}:
            value = _unpacked(_STEPS[value["step"]], value["state"], table)
        setattr(step, name, value)
    step._restored()
    return step


# Steps by name, for those that are held inside others.
_STEPS: dict[str, type] = {}


class Stored(MLWritable, MLReadable):
    """``write().save(path)`` and ``load(path)``, alone or inside a pipeline."""

    def __init_subclass__(cls, **options) -> None:
        super().__init_subclass__(**options)
        _STEPS[cls.__name__] = cls

    def write(self) -> MLWriter:
        return StepWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return StepReader(cls)

    def _restored(self) -> None:
        """Set the passing attributes of a step that was loaded."""


class FitStep(Estimator, Stored):
    """An operator that learns from a table: ``fit``, then ``transform`` on the model."""

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class FittedStep(Model, Stored):
    """The fitted side of a step."""


class PlainStep(Transformer, Stored):
    """An operator that needs no fit."""
