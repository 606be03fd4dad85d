"""Functions of indicators by name: registered, checked, looked up; never evaluated from text."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whole-number parameters that a sheet may give.
PARAMETERS = ("q",)


@dataclass(frozen=True)
class Operator:
    """A function of one or two columns: fn(x[, y][, q]) -> Column, or of a frame, fn(df, x[, y], out[, q]) -> DataFrame."""

    name: str
    fn: Callable
    inputs: int
    spans: bool
    frame: bool

    def add(self, df: DataFrame, out: str, *columns: str, q: int | None = None) -> DataFrame:
        """df with column `out`."""
        if len(columns) != self.inputs:
            raise ValueError(f"{self.name} takes {self.inputs} column(s), not {len(columns)}")
        if q is not None and not self.spans:
            raise ValueError(f"{self.name} takes no q")
        if q is not None and (isinstance(q, bool) or not isinstance(q, int) or q < 1):
            raise ValueError(f"q of {self.name} must be a whole number from 1, not {q!r}")
        more = {} if q is None else {"q": q}
        if self.frame:
            made = self.fn(df, *columns, out, **more)
            if not isinstance(made, DataFrame) or out not in made.columns:
                raise TypeError(f"{self.name} must return the frame with column {out}")
            return made
        made = self.fn(*[F.col(c) for c in columns], **more)
        if not isinstance(made, Column):
            raise TypeError(f"{self.name} must return a Column, not {type(made).__name__}")
        return df.withColumn(out, made)


_held: dict[str, Operator] = {}


def register_operator(name: str, fn: Callable, replace: bool = False) -> Operator:
    """Make a function known under a name. Its parameters tell what it is: x, or x and y, then optionally q; a function
    of a frame has df before them and out after them."""
    if not re.fullmatch(r"[A-Za-z]\w*", name):
        raise ValueError(f"not a name: {name!r}")
    if name in _held and not replace:
        raise ValueError(f"{name} is registered already")
    given = list(inspect.signature(fn).parameters)
    frame, spans = given[:1] == ["df"], given[-1:] == ["q"]
    core = given[frame : len(given) - spans]
    if frame and core[-1:] == ["out"]:
        core = core[:-1]
    elif frame:
        raise TypeError(f"{name} of a frame must take out after its columns")
    if core not in (["x"], ["x", "y"]):
        raise TypeError(f"{name} must take x or x, y (and q), not {given}")
    _held[name] = Operator(name, fn, len(core), spans, frame)
    return _held[name]


def operator(name: str) -> Operator:
    if name not in _held:
        raise ValueError(f"no such function: {name}")
    return _held[name]


def registered() -> list[str]:
    return sorted(_held)


def remove_operator(name: str) -> None:
    _held.pop(operator(name).name)


def publish(spark: SparkSession, frames: dict[str, DataFrame], prefix: str = "") -> list[str]:
    """Results as views, so that SQL of the session reads them; the names they have."""
    names = [f"{prefix}{n}" for n in frames]
    for n, df in zip(names, frames.values(), strict=True):
        if not re.fullmatch(r"[A-Za-z_]\w*", n):
            raise ValueError(f"not a view's name: {n!r}")
        if df.sparkSession is not spark:
            raise ValueError(f"{n} belongs to another session")
        df.createOrReplaceTempView(n)
    return names
