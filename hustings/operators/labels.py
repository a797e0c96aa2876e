"""Labels of places from patterns of flags, in stages of columns so that no expression holds another many times over."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from hustings.functions.numbers import total
from hustings.functions.scores import LABELS, SIDES, cases_of


def with_perception(rows: DataFrame) -> DataFrame:
    """``rows`` with perception and strength (0 to 3) from the flags national_*, ward_*, difference_*, charisma_* and local_* of the three sides.

    Two sides with two flags or more of the first three leave the third dominant. Else a side is behind with a national flag, or with both
    others; of several, those with a ward flag count, or, if none has one, those with a national flag. One that is left makes a race of the
    other two, with a strength that falls where it has charisma or local activity; else it is head to head.
    """
    f = lambda q, p: F.col(f"{q}_{p}")
    behind = lambda p: (f("national", p) == 1) | ((f("ward", p) == 1) & (f("difference", p) == 1))
    one = rows.select("*", *[(f("national", p) + f("ward", p) + f("difference", p)).alias(f"_s_{p}") for p in SIDES], *[behind(p).cast("int").alias(f"_b_{p}") for p in SIDES])
    two = one.select("*", total([(F.col(f"_s_{p}") >= 2).cast("int") for p in SIDES]).alias("_high"), total([f"_b_{p}" for p in SIDES]).alias("_nb"), total([F.col(f"_b_{p}") * f("ward", p) for p in SIDES]).alias("_nw"))
    pick = lambda p: F.when(F.col("_nb") <= 1, F.col(f"_b_{p}")).when(F.col("_nw") > 0, F.col(f"_b_{p}") * f("ward", p)).otherwise(F.col(f"_b_{p}") * f("national", p))
    weight = lambda p: F.when(F.col(f"_s_{p}") == 3, 0.75).otherwise(0.5)
    lost = lambda p: (2 - f("charisma", p) - f("local", p)) * weight(p)
    three = two.select("*", *[pick(p).alias(f"_c_{p}") for p in SIDES], *[F.greatest(F.lit(0), F.least(F.lit(3), F.floor(F.col(f"_s_{p}") - lost(p)))).cast("int").alias(f"_v_{p}") for p in SIDES])
    four = three.withColumn("_alone", total([f"_c_{p}" for p in SIDES]) == 1)
    label = F.when(F.col("_high") == 2, F.concat(cases_of({p: F.col(f"_s_{p}") < 2 for p in SIDES}, LABELS), F.lit("_Dominance")))
    strength = F.when(F.col("_high") == 2, F.lit(0))
    for p in SIDES:
        race = "Race: " + "_".join(LABELS[q] for q in SIDES if q != p)
        mine = F.col("_alone") & (F.col(f"_c_{p}") == 1)
        label = label.when(mine, F.when(F.col(f"_v_{p}") == 0, "Head_to_Head").otherwise(race))
        strength = strength.when(mine, F.col(f"_v_{p}"))
    return four.select(*rows.columns, label.otherwise("Head_to_Head").alias("perception"), strength.otherwise(0).alias("strength"))
