"""Panels: a lazy frame of cells with the scopes that led to it, and the metrics registered as columns."""

from __future__ import annotations

import hashlib
import inspect
import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..operators import frames, strata
from ..sources import runs


@dataclass(frozen=True)
class Metric:
    """A named expression over columns and other metrics."""

    name: str
    reads: tuple[str, ...]
    make: object  # a function of no arguments that gives the column

    def hash(self) -> str:
        """Of the metric's code with what it captures, of the library's functions that it calls, and of the metrics that it reads."""
        seen: set[int] = set()
        parts = [self.name, self.reads, *_described(self.make, seen)]
        return hashlib.sha256(repr((parts, [METRICS[r].hash() for r in self.reads if r in METRICS])).encode()).hexdigest()


def _described(function, seen: set[int]) -> list:
    """Code, constants, defaults, captured values and, in turn, this package's functions that a function names."""
    if id(function) in seen:
        return []
    seen.add(id(function))
    code = function.__code__
    out: list = [code.co_code, [c for c in code.co_consts if not inspect.iscode(c)], code.co_names, function.__defaults__, function.__kwdefaults__]
    out += [c.co_code + repr([x for x in c.co_consts if not inspect.iscode(x)]).encode() for c in code.co_consts if inspect.iscode(c)]
    held = [c.cell_contents for c in function.__closure__ or ()]
    for value in [*held, *(function.__globals__[n] for n in code.co_names if n in function.__globals__)]:
        if inspect.isfunction(value):
            if value.__module__.split(".")[0] == function.__module__.split(".")[0]:
                out += _described(value, seen)
        elif isinstance(value, (str, int, float, bool, bytes, tuple, frozenset, type(None))):
            out.append(value)
    return out


METRICS: dict[str, Metric] = {}


def metric(name: str, *reads: str):
    def made(function):
        METRICS[name] = Metric(name, reads, function)
        return function

    return made


def closure(names: list[str], have: set[str]) -> list[Metric]:
    """The metrics to compute for ``names``, each after those that it reads; KeyError for what is neither column nor metric."""
    order: list[Metric] = []
    state: dict[str, int] = {}

    def visit(n: str):
        if n in have and n not in METRICS or state.get(n) == 2:
            return
        if state.get(n) == 1:
            raise ValueError(f"{n} reads itself")
        if n not in METRICS:
            raise KeyError(n)
        state[n] = 1
        for r in METRICS[n].reads:
            visit(r)
        state[n] = 2
        order.append(METRICS[n])

    for n in names:
        visit(n)
    return order


def with_metrics(cells: DataFrame, names: list[str]) -> DataFrame:
    """With the metrics' columns; where one is there already, only its null and NaN cells are filled."""
    for m in closure(names, set(cells.columns)):
        value: Column = m.make()
        if m.name in cells.columns:
            held = col(m.name)
            kind = dict(cells.dtypes)[m.name]
            value = F.coalesce(F.when(~F.isnan(held), held) if kind in ("double", "float") else held, value)
        cells = cells.withColumn(m.name, value)
    return cells


@dataclass(frozen=True)
class Panel:
    cells: DataFrame
    stratify_by: tuple[str, ...] = ()
    scopes: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    leaves: frozenset[str] | None = field(default=None)

    def narrow(self, scope: str) -> Panel:
        return replace(self, cells=self.cells.where(scope), scopes=(*self.scopes, scope))

    def with_columns(self, **columns: Column) -> Panel:
        return replace(self, cells=self.cells.withColumns(columns))

    def with_metrics(self, *names: str) -> Panel:
        return replace(self, cells=with_metrics(self.cells, list(names)))

    def split_by(self, name: str) -> dict[object, Panel]:
        """A panel per value; one lazy filter each. ValueError over 1000 values."""
        values = [r[0] for r in self.cells.select(col(name)).distinct().limit(1001).collect()]
        if len(values) > 1000:
            raise ValueError(f"{name} has over 1000 values")
        return {v: replace(self, cells=self.cells.where(col(name).eqNullSafe(F.lit(v))), scopes=(*self.scopes, f"{name} = {v!r}")) for v in sorted(values, key=repr)}

    def derive(self, source: str, op: str, min_n: int | None = None) -> DataFrame:
        return strata.per_stratum_aggregate(self.cells, source, list(self.stratify_by), op, min_n=min_n)

    def surviving(self, source: str, op: str, predicate: str) -> Panel:
        """Cells of the strata whose aggregate passes (``value`` in SQL text): a left-semi join."""
        kept = self.derive(source, op).where(predicate).select(*[col(b) for b in self.stratify_by])
        return replace(self, cells=self.cells.join(kept, list(self.stratify_by), "left_semi"), scopes=(*self.scopes, f"{op}({source}): {predicate}"))


def from_corpus(spark, root: str, stratify_by: tuple[str, ...], measurements: bool = True, traces: bool = False) -> Panel:
    """A panel of one corpus folder, its leaves known if it has a configuration."""
    cells = runs.load_corpus(spark, root, measurements, traces)
    found = [c for c in cells.columns if c.startswith("config.")]
    return Panel(cells, stratify_by, (), (root,), frozenset(found) if found else None)


def from_corpora(spark, roots: list[str], stratify_by: tuple[str, ...], **options) -> Panel:
    """The union of several corpora without rows that repeat one another's content."""
    whole = concat([from_corpus(spark, r, stratify_by, **options) for r in roots])
    return replace(whole, cells=frames.dedup_by_content(whole.cells))


def to_cache(panel: Panel, path: str, hashes: dict[str, str] | None = None) -> None:
    """The cells and, after them, a sidecar of sources, strata, leaves and metric hashes, both by Spark's commit protocol."""
    panel.cells.write.mode("overwrite").parquet(f"{path}/cells.parquet")
    side = {"sources": panel.sources, "stratify_by": panel.stratify_by, "scopes": panel.scopes, "leaves": None if panel.leaves is None else sorted(panel.leaves), "hashes": hashes or {}}
    panel.cells.sparkSession.createDataFrame([(json.dumps(side, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/panel.json")


def from_cache(spark, path: str, hashes: dict[str, str] | None = None) -> Panel:
    """What ``to_cache`` wrote; ValueError where a metric's hash is no longer the one given."""
    side = json.loads("".join(r[0] for r in spark.read.text(f"{runs.escaped(path)}/panel.json").collect()))
    stale = sorted(n for n, h in (hashes or {}).items() if side["hashes"].get(n) != h)
    if stale:
        raise ValueError(f"the cache was made by other definitions of {stale}")
    cells = spark.read.parquet(f"{runs.escaped(path)}/cells.parquet")
    return Panel(cells, tuple(side["stratify_by"]), tuple(side["scopes"]), tuple(side["sources"]), None if side["leaves"] is None else frozenset(side["leaves"]))


def concat(panels: list[Panel]) -> Panel:
    """All cells; strata must agree, unknown leaves make the union's unknown."""
    if len({p.stratify_by for p in panels}) != 1:
        raise ValueError("panels differ in strata")
    leaves = None if any(p.leaves is None for p in panels) else frozenset().union(*[p.leaves for p in panels])
    return Panel(frames.diagonal_union([p.cells for p in panels]), panels[0].stratify_by, (), tuple(s for p in panels for s in p.sources), leaves)
