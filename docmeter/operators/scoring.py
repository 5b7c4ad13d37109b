"""Scores, gates and pass decisions as Column expressions over score columns in 0 to 1."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmeter.lexicons import THRESHOLDS, WEIGHTS

#: Least score of each performance tier, the best one first.
PERFORMANCE_TIERS = {"excellent": 0.60, "good": 0.40, "fair": 0.20, "poor": 0.0}
#: Least behavioural score and least quality score of each way to pass.
PASS_MODES = {"execution": (0.70, None), "balanced": (0.60, 0.55), "quality": (None, 0.60)}


def performance_tier(score: Column, tiers: dict[str, float] = PERFORMANCE_TIERS) -> Column:
    out = F.lit(list(tiers)[-1])
    for name, least in reversed(list(tiers.items())[:-1]):
        out = F.when(score >= least, name).otherwise(out)
    return out


def contradiction_gate(verified: Column, failed: Column, threshold: float = 0.50) -> Column:
    """CF-03: at least half of the claims that were tested failed."""
    return F.when((verified + failed > 0) & (F.try_divide(failed, verified + failed) >= threshold), "CF-03")


def external_call_gate(matched: Column, calls: Column, tested: Column, least_calls: int = 5, least_share: float = 0.30) -> Column:
    """CF-05: of enough external calls under 30 % are described, and something was tested."""
    return F.when((calls >= least_calls) & (tested > 0) & (F.try_divide(matched, calls) < least_share), "CF-05")


def undocumented_rules_gate(critical: Column, documented: Column) -> Column:
    """CF-01: there are critical rules, and none is documented."""
    return F.when((critical > 0) & (documented == 0), "CF-01")


def missing_handlers_gate(handlers: Column, documented: Column) -> Column:
    """CF-04: fewer error handlers are documented than half of them, one at least."""
    return F.when((handlers > 0) & (documented < F.greatest(F.lit(1), F.floor(handlers / 2))), "CF-04")


def gates(*found: Column) -> Column:
    """Critical failures that fired, in the given order."""
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def verdict(sc: Column, dq: Column, bf: Column, failures: Column, weights: dict[str, float] = WEIGHTS, thresholds: dict[str, float] = THRESHOLDS) -> Column:
    """Struct of ``lcb`` (0 to 100, 0 with any critical failure), ``passed`` and ``reason``."""
    tracks = {"sc": sc, "dq": dq, "bf": bf}
    percent = lambda x: F.concat(F.bround(x * 100).cast("long").cast("string"), F.lit("%"))  # noqa: E731  (halves go to the even number)
    missed = F.filter(F.array(*[F.when(tracks[k] < thresholds[k], F.concat(F.lit(k.upper() + " ("), percent(tracks[k]), F.lit(f" < {thresholds[k] * 100:.0f}%)"))) for k in tracks]), lambda x: x.isNotNull())
    failed, total = F.size(failures) > 0, reduce(add, [tracks[k] * weights[k] for k in tracks]) * 100
    reason = F.when(failed, F.concat(F.lit("Critical failure: "), F.get(failures, F.lit(0)))).when(F.size(missed) == 0, "All thresholds met").otherwise(F.concat(F.lit("Failed thresholds: "), F.array_join(missed, ", ")))
    return F.struct(F.when(failed, 0.0).otherwise(total).alias("lcb"), (~failed & (F.size(missed) == 0)).alias("passed"), reason.alias("reason"))


def quality_score(sc: Column, sq: Column, tr: Column, least_sc: float = 0.60, least_sq: float = 0.50) -> Column:
    """.4 structure + .4 semantics + .2 traceability if both minima are met, else 0."""
    return F.when((sc >= least_sc) & (sq >= least_sq), 0.4 * sc + 0.4 * sq + 0.2 * tr).otherwise(0.0)


def passes(bf: Column, quality: Column, placeholder: Column, mode: str = "balanced") -> Column:
    """Pass by mode; a placeholder behavioural score makes the other modes the quality one."""

    def by(name: str) -> Column:
        least_bf, least_quality = PASS_MODES[name]
        parts = [c >= least for c, least in ((bf, least_bf), (quality, least_quality)) if least is not None]
        return reduce(lambda a, b: a & b, parts)

    mode = mode if mode in PASS_MODES else "balanced"
    return F.when(placeholder, by("quality")).otherwise(by(mode))


def penalised(score: Column, *penalties: Column) -> Column:
    """Multiplicative penalties, in 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), reduce(lambda s, p: s * (1 - p), penalties, score)))


def hybrid_claim_score(verified: Column, partial: Column, claims: Column, target: int = 6, weight: float = 0.5) -> Column:
    """Verified and half of partial claims over a target, at most 1; 1 without claims."""
    return F.when(claims == 0, 1.0).otherwise(F.least(F.lit(1.0), (verified + weight * partial) / float(target)))


def claim_weight(claims: Column, few: int = 5, low: float = 0.4, high: float = 0.6) -> Column:
    return F.when(claims >= few, high).otherwise(low)


def mixed_score(claim_score: Column, call_score: Column, claims: Column) -> Column:
    """Claims and external calls weighted by how many claims there are."""
    return claim_weight(claims) * claim_score + (1 - claim_weight(claims)) * call_score


def behavioural_score(claims: Column, classes: dict[str, tuple[Column, Column]], least_claims: int = 1) -> Column:
    """Mean of class scores (name to count and score) weighted by counts; 0 for silence, 1 without any paragraph."""
    counts = reduce(add, [n for n, _ in classes.values()])
    mean = F.try_divide(reduce(add, [n * s for n, s in classes.values()]), counts)
    return F.when(claims < least_claims, 0.0).otherwise(F.coalesce(mean, F.lit(1.0)))


def weighted_coverage(rows: DataFrame, group: str, priority: Column, hit: Column) -> DataFrame:
    """Share of hits by group, critical ones weighted 3, trivial ones 1, all others 2."""
    weight = F.when(priority == "CRITICAL", 3).when(priority == "TRIVIAL", 1).otherwise(2)
    return rows.groupBy(group).agg((F.sum(weight * hit.cast("int")) / F.sum(weight)).alias("coverage"))
