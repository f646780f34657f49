"""Operators by name, in groups; running one by ``group:name``; messages between parts of a program."""

from __future__ import annotations

import contextlib
import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from terrane.plans import screening, smoothing

log = logging.getLogger("terrane")


@dataclass
class Operator:
    """A tool: cells, a header and parameters in, DataFrames by name out."""

    name: str
    title: str
    group: str
    run: Callable[..., dict[str, DataFrame]]
    parameters: type
    tags: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.tags = self.tags or ["terrane", "grids", self.group]


@dataclass
class Group:
    name: str
    title: str
    operators: list[Operator] = field(default_factory=list)


class Registry:
    """Groups in the order they came; a name that is there already is kept and the newcomer is skipped with a warning."""

    def __init__(self):
        self._groups: dict[str, Group] = {}

    def register(self, group: Group) -> bool:
        if group.name in self._groups:
            log.warning("group %s is registered already", group.name)
            return False
        self._groups[group.name] = group
        return True

    def unregister(self, name: str) -> None:
        self._groups.pop(name, None)

    def get(self, name: str) -> Group | None:
        return self._groups.get(name)

    def groups(self) -> list[Group]:
        return list(self._groups.values())

    def operators(self) -> list[Operator]:
        return [op for g in self._groups.values() for op in g.operators]

    def is_registered(self, name: str) -> bool:
        return name in self._groups

    def clear(self) -> None:
        self._groups.clear()

    def run(self, which: str, *args, **kwargs) -> dict[str, DataFrame]:
        """Run ``group:name``. The jobs that this starts at once carry that tag; results are lazy, so put what
        reads or writes them under :func:`tagged`, and :func:`cancel` can stop it from another thread."""
        group, _, name = which.partition(":")
        found = [op for op in (self._groups[group].operators if group in self._groups else []) if op.name == name]
        if not found:
            raise KeyError(f"no operator {which}")
        return found[0].run(*args, **kwargs)


@contextlib.contextmanager
def tagged(spark, which: str):
    """All jobs that this thread starts inside carry the operator's tag."""
    spark.sparkContext.addJobTag(which)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(which)


def cancel(spark, which: str) -> None:
    """Stop the running jobs of that tag; what waits for them gets an error."""
    spark.sparkContext.cancelJobsWithTag(which)


def _screen(cells: DataFrame, header: screening.Header, parameters: screening.Parameters | None = None):
    with tagged(cells.sparkSession, "hydrology:screening"):
        return screening.screen(cells, header, parameters or screening.Parameters())


def _smooth(cells: DataFrame, header: screening.Header, parameters: smoothing.Parameters | None = None):
    with tagged(cells.sparkSession, "hydrology:smoothing"):
        return smoothing.smooth(cells, parameters or smoothing.Parameters(), header.nodata, header.res_x, header.res_y, header.name, header.crs)


def default_registry() -> Registry:
    out = Registry()
    out.register(
        Group(
            "hydrology", "Hydrology",
            [
                Operator("screening", "Screening of elevation grids", "hydrology", _screen, screening.Parameters),
                Operator("smoothing", "Smoothing of elevation grids", "hydrology", _smooth, smoothing.Parameters),
            ],
        )
    )
    out.register(Group("geometry", "Geometry"))
    return out


class Messages:
    """Callbacks by topic, called at once and in order."""

    def __init__(self):
        self._topics: dict[str, list[Callable]] = {}

    def subscribe(self, topic: str, call: Callable) -> None:
        self._topics.setdefault(topic, []).append(call)

    def unsubscribe(self, topic: str, call: Callable) -> None:
        """ValueError if it is not subscribed."""
        self._topics.get(topic, []).remove(call)

    def publish(self, topic: str, *args, **kwargs) -> None:
        for call in list(self._topics.get(topic, [])):
            call(*args, **kwargs)

    def clear(self) -> None:
        self._topics.clear()
