"""Claims as declared queries: scope, contrast, analyses by name, gates before, a verdict after."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, padded
from .contrast import Contrast

ANALYSES: dict[str, Callable] = {}


def analysis(function: Callable) -> Callable:
    """Register a function of (cells, **options) that claims can ask for by its name."""
    ANALYSES[function.__name__] = function
    return function


@dataclass(frozen=True)
class Finding:
    level: str  # block, warn, info
    gate: str
    message: str


@dataclass(frozen=True)
class Claim:
    """A declared query: does the contrast change ``source`` as predicted, within ``scope`` (SQL text over ``scope_columns``)?"""

    name: str
    decide: Callable
    source: str
    target: str
    contrast: Contrast
    pair_by: tuple[str, ...] = ()
    stratify_by: tuple[str, ...] = ()
    scope: str | None = None
    scope_columns: tuple[str, ...] = ()
    predicted: str | None = None
    tier: str = "correlational"
    leaves: tuple[str, ...] = ()
    gates: tuple[Callable, ...] = ()
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Result:
    name: str
    verdict: str
    findings: tuple[Finding, ...]
    values: dict
    extent: str | None


CLAIMS: dict[str, Claim] = {}


def claim_bridge(**declared) -> Callable:
    """Declare a claim. Parameters of the function without a default are analyses to run; those with one are their options."""

    def made(decide: Callable) -> Claim:
        options = {n: p.default for n, p in inspect.signature(decide).parameters.items() if p.default is not inspect.Parameter.empty}
        claim = Claim(name=decide.__name__, decide=decide, options=options, **declared)
        CLAIMS[claim.name] = claim
        return claim

    return made


def scoped(claim: Claim, cells: DataFrame) -> DataFrame:
    rows = padded(cells, [c for c in claim.scope_columns])
    return claim.contrast.applied(rows.where(claim.scope) if claim.scope else rows)


def distinct_arms(claim: Claim, cells: DataFrame):
    if claim.contrast.treatment == claim.contrast.baseline or (claim.contrast.treatment_values and claim.contrast.treatment_values == claim.contrast.baseline_values):
        yield Finding("block", "distinct_arms", "both arms are the same")


def resolved_source(claim: Claim, cells: DataFrame):
    if claim.source not in cells.columns:
        yield Finding("block", "resolved_source", f"no column {claim.source}")


def contrast_present(claim: Claim, cells: DataFrame):
    c = claim.contrast
    have = cells.agg(*[F.coalesce(F.max(col(c.field) == F.lit(arm)), F.lit(False)) for arm in (c.treatment, c.baseline)]).first()
    for arm, there in zip((c.treatment, c.baseline), have, strict=True):
        if not there:
            yield Finding("block", "contrast_present", f"no rows of {arm}")


def exogenous_source(claim: Claim, cells: DataFrame):
    if claim.source in claim.leaves:
        level = "block" if claim.tier == "interventional" else "warn"
        yield Finding(level, "exogenous_source", f"{claim.source} is configuration, not a measurement")


def distinct_units(claim: Claim, cells: DataFrame):
    if dict(cells.dtypes).get(claim.source) == "boolean":
        return
    r = cells.agg(F.count(col(claim.source)).alias("n"), F.count_distinct(F.round(col(claim.source).cast("double"), 12)).alias("d")).first()
    if r["n"] and r["d"] * 2 <= r["n"]:
        yield Finding("block" if r["d"] < 4 else "warn", "distinct_units", f"{r['d']} distinct values in {r['n']} rows")


def exogenous_scope(claim: Claim, cells: DataFrame):
    if claim.scope_columns and claim.leaves and set(claim.scope_columns) <= set(claim.leaves):
        yield Finding("warn", "exogenous_scope", "the scope reads configuration alone")


def no_predicted_direction(claim: Claim, cells: DataFrame):
    if claim.predicted is None:
        yield Finding("info", "no_predicted_direction", "no direction was predicted")


def contrast_isolation(claim: Claim, cells: DataFrame):
    """Registered leaves have equal value sets in both arms of each complete pair unit; one aggregation over all leaves."""
    leaves = [x for x in claim.leaves if x in cells.columns and x not in (*claim.pair_by, *claim.contrast.columns)]
    if not leaves or not claim.pair_by:
        return
    c = claim.contrast
    values = lambda x, arm: F.sort_array(F.collect_set(F.when(col(c.field) == arm, F.coalesce(col(x).cast("string"), F.lit("\u0000")))))
    sets = cells.groupBy(*[col(k) for k in claim.pair_by]).agg(F.count_distinct(col(c.field)).alias("_arms"), *[(values(x, c.treatment) != values(x, c.baseline)).alias(x) for x in leaves]).where("_arms = 2")
    r = sets.agg(*[F.count_if(col(x)).alias(x) for x in leaves]).first()
    for x in leaves:
        if r[x]:
            yield Finding("block", "contrast_isolation", f"{x} differs between the arms of {r[x]} pairs")


def pair_completeness(claim: Claim, cells: DataFrame):
    if claim.pair_by:
        arms = cells.groupBy(*[col(k) for k in claim.pair_by]).agg(F.count_distinct(col(claim.contrast.field)).alias("n"))
        n = arms.where("n < 2").count()
        if n:
            yield Finding("warn", "pair_completeness", f"{n} pair units lack an arm")


GATES = (distinct_arms, resolved_source, contrast_present, exogenous_source, distinct_units, exogenous_scope, no_predicted_direction, contrast_isolation, pair_completeness)


def extent_hash(cells: DataFrame, key: str = "id") -> DataFrame:
    """A hash of the set of ids: order and repeats don't count. Sums of two 52-bit parts of each id's digest, so no task holds the ids."""
    ids = cells.select(col(key).cast("string").alias("i")).distinct()
    parts = ids.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.conv(F.substring(F.md5("i"), at, 13), 16, 10).cast("decimal(28,0)")).alias(f"h{k}") for k, at in ((1, 1), (2, 14))])
    return parts.select(F.sha2(F.concat_ws(":", "n", F.col("h1").cast("string"), F.col("h2").cast("string")), 256).alias("extent"))


def evaluate(claim: Claim, cells: DataFrame, key: str = "id") -> Result:
    """Scope, gates in fixed order (the first block ends it), the claim's analyses once each, and its verdict."""
    rows = scoped(claim, cells)
    findings: list[Finding] = []
    for gate in (*GATES, *claim.gates):
        found = list(gate(claim, rows))
        findings += found
        if any(f.level == "block" for f in found):
            return Result(claim.name, "inadmissible", tuple(findings), {}, None)
    known = {"source": claim.source, "pair_by": list(claim.pair_by), "by": list(claim.stratify_by), "arm": claim.contrast.field, "treatment": claim.contrast.treatment, "baseline": claim.contrast.baseline, "predicted": claim.predicted, **claim.options}
    values = {}
    for name in inspect.signature(claim.decide).parameters:
        if name in claim.options:
            continue
        run = ANALYSES[name]
        takes = inspect.signature(run).parameters
        values[name] = run(rows, **{k: v for k, v in known.items() if k in takes})
    verdict = claim.decide(**values, **claim.options)
    extent = extent_hash(rows, key).first()[0] if key in rows.columns else None
    return Result(claim.name, verdict, tuple(findings), values, extent)


def source_hash(claim: Claim) -> str:
    """For pre-registration: a hash of what the claim declares and of its deciding function's code."""
    code = claim.decide.__code__
    text = repr((claim.name, claim.source, claim.target, claim.contrast, claim.pair_by, claim.stratify_by, claim.scope, claim.predicted, claim.tier, code.co_code, [c for c in code.co_consts if not inspect.iscode(c)], code.co_names))
    return hashlib.sha256(text.encode()).hexdigest()


def audit(manifest: dict[str, dict], results: list[Result]) -> list[str]:
    """What broke a pre-registration: changed or missing claims, and verdicts other than predicted."""
    out = []
    by = {r.name: r for r in results}
    for name, committed in manifest.items():
        if name not in CLAIMS or name not in by:
            out.append(f"{name}: missing")
        elif source_hash(CLAIMS[name]) != committed["source"]:
            out.append(f"{name}: changed since it was registered")
        elif committed.get("verdict") and by[name].verdict != committed["verdict"]:
            out.append(f"{name}: {by[name].verdict}, predicted {committed['verdict']}")
    return out
