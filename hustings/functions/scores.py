"""Scores, flags and labels of contests and districts, as column expressions over three sides or a few columns."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

from .numbers import col, total

SIDES = ("L", "MR", "R")
#: Names of the sides in texts.
LABELS = {"L": "Left", "MR": "MR", "R": "R"}


def cases(c: Column | str, table: dict, otherwise: object = None) -> Column:
    """A value for each category of a column."""
    out = None
    for k, v in table.items():
        out = F.when(col(c) == k, F.lit(v)) if out is None else out.when(col(c) == k, F.lit(v))
    return out.otherwise(F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise)


def remap(c: Column | str, table: dict) -> Column:
    """Categories by a table; those that it lacks stay."""
    return cases(c, table, col(c))


def steps(c: Column | str, edges: list[tuple[float, object]], last: object) -> Column:
    """The value of the first edge that is not below the column; ``last`` above all edges."""
    out = None
    for edge, v in edges:
        out = F.when(col(c) <= edge, F.lit(v)) if out is None else out.when(col(c) <= edge, F.lit(v))
    return out.otherwise(F.lit(last))


#: Population up to so much, electors for a seat.
QUOTAS = ([(400_000, 20_000), (650_000, 23_000), (1_000_000, 24_000)], 25_000)


def population_quota(population: Column | str) -> Column:
    return steps(population, *QUOTAS)


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def canonical_race(c: Column | str) -> Column:
    """Head_to_Head and Head to Head are one."""
    return F.when(F.replace(F.trim(col(c)), F.lit("_"), F.lit(" ")) == "Head to Head", "Head to Head").otherwise(col(c))


def race_flags(c: Column | str) -> dict[str, Column]:
    """1 for a side that a perspective leaves out, else 0: "Vote_X" leaves out all but X, "Race: X_Y" all but two; anything neutral, none."""
    value = F.trim(canonical_race(c))
    short = lambda p: F.when(p == "Left", "L").otherwise(p)
    named = F.transform(F.split(F.trim(F.element_at(F.split(value, ":"), -1)), "_"), short)
    neutral = value.isNull() | value.isin("Head to Head", "")
    only = short(F.substring(value, 6, 1000))
    return {p: F.when(neutral, 0).when(value.startswith("Vote_"), F.when(only == p, 0).otherwise(1)).otherwise(F.when(F.array_contains(named, p), 0).otherwise(1)) for p in SIDES}


def pair_reward(a: Column, b: Column) -> Column:
    """What a gains from b: the difference less one for the higher, as much lost by the lower."""
    return F.when(a > b, a - b - 1).when(a < b, -(b - a - 1)).otherwise(0)


def charisma_scores(left: Column, middle: Column, right: Column, weight: float = 0.75) -> dict[str, Column]:
    """Sums of pair rewards, weighted; they add up to 0."""
    values = dict(zip(SIDES, (left, middle, right), strict=True))
    return {p: total([pair_reward(values[p], values[q]) for q in SIDES if q != p]) * weight for p in SIDES}


def charisma_flags(left: Column, middle: Column, right: Column, weak: float = 4, gap: float = 3) -> dict[str, Column]:
    """1 for a side under ``weak`` that the first leader beats by more than ``gap``."""
    values = dict(zip(SIDES, (left, middle, right), strict=True))
    most = F.greatest(left, middle, right)
    leader = F.when(left == most, "L").when(middle == most, "MR").otherwise("R")
    return {p: F.when((leader != p) & (values[p] < weak) & (most - values[p] > gap), 1).otherwise(0) for p in SIDES}


def local_flags(scores: dict[str, Column], weak: float = 4) -> dict[str, Column]:
    """1 for a score under ``weak``; none if all are."""
    low = {p: s < weak for p, s in scores.items()}
    everyone = low["L"] & low["MR"] & low["R"]
    return {p: F.when(low[p] & ~everyone, 1).otherwise(0) for p in SIDES}


def gap_flags(shares: dict[str, Column], gap: float = 20) -> dict[str, Column]:
    """1 for a share that another leads by ``gap`` or more."""
    most = F.greatest(*shares.values())
    return {p: F.when(most - s >= gap, 1).otherwise(0) for p, s in shares.items()}


def cases_of(tests: dict[str, Column], names: dict[str, str]) -> Column:
    """The name of the first side whose test holds."""
    out = None
    for p, t in tests.items():
        out = F.when(t, names[p]) if out is None else out.when(t, names[p])
    return out


def turnout_factor(local: Column | str, constituency: Column | str) -> Column:
    """Dominance stays; agreement with the constituency stays, head to head as competitive; anything else is normal."""
    local, constituency = col(local), col(constituency)
    same = F.when(local == "Head_to_Head", "Competitive Head to Head").otherwise(local)
    return F.when(local.endswith("_Dominance"), local).when(local == constituency, same).otherwise("Normal Head to Head")


def race_label(shares: dict[str, Column], votes: dict[str, Column], uniform: Column, clear: float = 15) -> Column:
    """Head to Head under ``clear`` points of lead; else the winner and the second, or, if second and third are close, one of them by lot."""
    ranked = F.sort_array(F.array(*[F.struct(shares[p].alias("share"), F.lit(-i).alias("o"), votes[p].alias("votes"), F.lit(p).alias("side")) for i, p in enumerate(SIDES)]), asc=False)
    a, b, c = ranked[0], ranked[1], ranked[2]
    both = b["votes"] + c["votes"]
    luck = uniform < F.when(both > 0, b["votes"] / both).otherwise(0.5)
    other = F.when((b["share"] - c["share"] > clear) | luck, b["side"]).otherwise(c["side"])
    return F.when(a["share"] - b["share"] < clear, "Head to Head").otherwise(F.concat(F.lit("Race: "), a["side"], F.lit("_"), other))


def swing(left: Column, middle: Column, rates: dict[str, Column]) -> dict[str, Column]:
    """Shares after moves between neighbours; the right has what left and middle leave of 100. ``rates``: LtoM, MtoL, MtoR, RtoM."""
    right = 100 - left - middle
    return {
        "L": left * (1 - rates["LtoM"]) + middle * rates["MtoL"],
        "MR": middle * (1 - rates["MtoL"] - rates["MtoR"]) + left * rates["LtoM"] + right * rates["RtoM"],
        "R": right * (1 - rates["RtoM"]) + middle * rates["MtoR"],
    }


def squeeze(local: dict[str, Column], combined: dict[str, Column], low: float = 1.5, high: float = 95) -> dict[str, Column]:
    """Local scores first, the combined ones in the room that is left of 100; results out of (0, 100) become ``low`` or ``high``; then to a sum of 100."""
    room = (100 - total(list(local.values()))) / 100
    raw = {p: local[p] + combined[p] * room for p in SIDES}
    gated = {p: F.when(v <= 0, low).when(v >= 100, high).otherwise(v) for p, v in raw.items()}
    whole = total(list(gated.values()))
    return {p: v * 100 / whole for p, v in gated.items()}


def joint_cap(a: Column, b: Column, limit: float = 90) -> tuple[Column, Column]:
    """Both scaled down where together they reach the limit."""
    factor = F.when(a + b >= limit, limit / (a + b)).otherwise(1.0)
    return a * factor, b * factor


def piecewise_density(area: Column, alpha: float, beta2: float, gammas: tuple[float, float, float], knots: tuple[float, float]) -> Column:
    """exp of a quadratic in the logarithm of the area, in three pieces that meet at the knots."""
    import math

    g1, g2, g3 = gammas
    betas = (beta2 + (g2 - g1) * math.log(knots[0]), beta2, beta2 + (g2 - g3) * math.log(knots[1]))
    x = F.ln(F.greatest(area, F.lit(1e-6)))
    piece = lambda b, g: F.exp(alpha + b * x + g * x * x)
    return F.when(area < knots[0], piece(betas[0], g1)).when(area < knots[1], piece(betas[1], g2)).otherwise(piece(betas[2], g3))


def density(population: Column, area: Column) -> Column:
    return F.try_divide(population, F.nullif(area, F.lit(0.0)))


def population_or(population: Column | str, area: Column, density: Column) -> Column:
    """A population that is absent, NA or 0 is area times density."""
    known = F.nullif(col(population).cast("string").try_cast("double"), F.lit(0.0))
    return F.coalesce(known, area * density)


#: Weight of an activity by kind and radius.
TIER_WEIGHTS = {"Canvass_0.5": 3.5, "Canvass_1": 2.0, "Canvass_1.5": 1.0, "Service_1": 3.0, "Service_2": 2.0, "Service_3": 1.5}


def activity_score(counts: dict[str, Column]) -> Column:
    return total([counts[t] * w for t, w in TIER_WEIGHTS.items()])


#: Right-closed edges of score brackets and their names.
SCORE_EDGES = ((0.5, "0"), (2.5, "1-2"), (4.5, "3-4"), (6.5, "5-6"), (8.5, "7-8"), (10.5, "9-10"), (12.5, "11-12"))
SCORE_LABELS = (*[n for _, n in SCORE_EDGES], "12+")


def score_bracket(score: Column | str) -> Column:
    return F.when(col(score) > -0.001, steps(score, list(SCORE_EDGES), "12+"))
