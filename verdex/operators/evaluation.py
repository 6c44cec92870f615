"""Evaluation of prediction logs: calibration, risk against coverage, and the release gate of a build.

A log has one row per item: id, pred, ok (0 or 1) and conf (0 to 1); rows with a null conf or ok are left out. Sums are exact
aggregates over the log; nothing but counted groups of equal confidence is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdex.operators import ranks

#: Fixed values of the release gate: accuracy and calibration may be worse by this much, and this share must agree.
SLACK, AGREE = 0.01, 0.97
EULER = 0.5772156649015329


def bin_of(conf: Column, bins: int = 10, zero: bool = False) -> Column:
    """AGG-04, AGG-05: the b with b / bins < conf <= (b + 1) / bins; null outside; confidence 0 is in bin 0 if `zero`."""
    edges = F.array(*(F.lit(b / bins) for b in range(bins + 1)))
    near = F.least(F.greatest(F.floor(conf * bins).cast("int"), F.lit(0)), F.lit(bins - 1))
    inside = lambda b: (b >= 0) & (b < bins) & (F.get(edges, b) < conf) & (conf <= F.get(edges, b + 1))
    found = F.coalesce(*(F.when(inside(near + d), near + d) for d in (0, -1, 1)))
    return F.when(conf == 0, 0).otherwise(found) if zero else found


def ece(log: DataFrame, keys: tuple[str, ...] = (), zero: bool = False, bins: int = 10) -> DataFrame:
    """Expected calibration error by key: (keys..., n, acc, ece). Bins, not items, meet after the map side."""
    b = bin_of(F.col("conf"), bins, zero)
    cells = log.filter("conf IS NOT NULL AND ok IS NOT NULL").groupBy(*keys, b.alias("_bin")).agg(F.count("*").alias("_n"), F.sum("ok").alias("_ok"), F.sum("conf").alias("_conf"))
    gap = F.sum(F.when(F.col("_bin").isNotNull(), F.abs(F.col("_ok") - F.col("_conf"))).otherwise(0.0))
    out = cells.groupBy(*keys) if keys else cells.groupBy()
    return out.agg(F.sum("_n").alias("n"), (F.sum("_ok") / F.sum("_n")).alias("acc"), (gap / F.sum("_n")).alias("ece"))


def compare_builds(base: DataFrame, variant: DataFrame) -> DataFrame:
    """JOIN-10, AGG-14: one row over the items of both logs: n, acc, base_acc, agree, mean_change, ece, base_ece, gate.

    The gate opens if the variant's accuracy is at most SLACK below the base's, its calibration error at most SLACK above, and
    at least AGREE of the answers are the same. Without common items everything but n is null.
    """
    side = lambda df, x: df.select("id", *(F.col(c).alias(f"{x}_{c}") for c in ("pred", "ok", "conf")))
    both = side(base, "b").join(side(variant, "v"), "id")
    rows = both.select("id", F.explode(F.array(*(F.struct(F.lit(x).alias("side"), F.col(f"{x}_ok").alias("ok"), F.col(f"{x}_conf").alias("conf"), (F.col("b_pred") == F.col("v_pred")).cast("int").alias("same"), F.abs(F.col("b_conf") - F.col("v_conf")).alias("change")) for x in "bv"))).alias("r")).select("id", "r.*")
    cells = rows.groupBy("side", bin_of(F.col("conf")).alias("bin")).agg(F.count("*").alias("n"), F.sum("ok").alias("ok"), F.sum("conf").alias("conf"), F.sum("same").alias("same"), F.sum("change").alias("change"))
    of = lambda x, value: F.sum(F.when(F.col("side") == x, value))
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("ok") - F.col("conf"))).otherwise(0.0)
    sums = cells.agg(*(of(x, F.col(c)).alias(f"{x}_{c}") for x in "bv" for c in ("n", "ok", "same", "change")), *(of(x, gap).alias(f"{x}_gap") for x in "bv"))
    n = F.col("b_n")
    out = sums.select(F.coalesce(n, F.lit(0)).cast("bigint").alias("n"), (F.col("v_ok") / n).alias("acc"), (F.col("b_ok") / n).alias("base_acc"), (F.col("b_same") / n).alias("agree"), (F.col("b_change") / n).alias("mean_change"), (F.col("v_gap") / n).alias("ece"), (F.col("b_gap") / n).alias("base_ece"))
    return out.withColumn("gate", (F.col("acc") >= F.col("base_acc") - SLACK) & (F.col("ece") <= F.col("base_ece") + SLACK) & (F.col("agree") >= AGREE))


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n: added up to 20, by its asymptotic series beyond, whose error is under 1e-16 there."""
    added = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(20)).cast("int")), F.lit(0.0), lambda s, k: s + 1 / k)
    x = n.cast("double")
    series = F.log(x) + EULER + 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    return F.when(n <= 0, 0.0).when(n <= 20, added).otherwise(series)


def by_confidence(log: DataFrame) -> DataFrame:
    """(conf, g, ok, k0, ok0, n): groups of equal confidence, with the items and right answers of higher confidence before them.

    Groups are cut into cells by confidence, so no task orders them all, however many there are.
    """
    groups = log.filter("conf IS NOT NULL AND ok IS NOT NULL").groupBy("conf").agg(F.count("*").alias("g"), F.sum("ok").cast("bigint").alias("ok"))
    groups = groups.withColumn("_down", -F.col("conf"))
    total = groups.agg(F.sum("g").alias("n"))
    rows = ranks.running(groups, "_down", ["g", "ok"])
    rows = rows.select("conf", "g", "ok", (F.col("total_g") - F.col("g")).alias("k0"), (F.col("total_ok") - F.col("ok")).alias("ok0"))
    return rows.join(F.broadcast(total))  # one row


def risk_coverage(log: DataFrame, coverages: tuple[float, ...] = (0.8, 0.5)) -> DataFrame:
    """WIN-04: (n, aurc, acc_<percent>...): the mean of 1 - accuracy over all coverages, and the accuracy at some.

    Of the k most confident items, accuracy is what it is on average over the orders of a group of equal confidence. The items
    at coverage c are max(1, round(c n)), a half rounded to the even number. A group's share of the mean has a closed form: the
    accuracies (ok0 + j r) / (k0 + j) for j up to g, r right per item, add up to g r + (ok0 - r k0)(H(k0 + g) - H(k0)).
    """
    r = F.col("ok") / F.col("g")
    whole = F.col("g") * r + (F.col("ok0") - r * F.col("k0")) * (harmonic(F.col("k0") + F.col("g")) - harmonic(F.col("k0")))

    def at(c: float) -> Column:
        k = F.greatest(F.lit(1), F.bround(c * F.col("n"), 0).cast("bigint"))
        here = (F.col("k0") < k) & (k <= F.col("k0") + F.col("g"))
        return F.max(F.when(here, (F.col("ok0") + (k - F.col("k0")) * r) / k)).alias(f"acc_{round(100 * c)}")

    return by_confidence(log).agg(F.max("n").alias("n"), (1 - F.sum(whole) / F.max("n")).alias("aurc"), *(at(c) for c in coverages))


def coverage_at(log: DataFrame, targets: tuple[float, ...]) -> DataFrame:
    """WIN-04: (target, coverage): the largest share of items that a threshold can cut off with the target accuracy; else 0."""
    ends = by_confidence(log).select(((F.col("ok0") + F.col("ok")) / (F.col("k0") + F.col("g"))).alias("acc"), ((F.col("k0") + F.col("g")) / F.col("n")).alias("share"))
    best = ends.select(F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.when(F.col("acc") >= t, F.col("share")).otherwise(0.0).alias("share")) for t in targets))).alias("x"))
    return best.groupBy("x.target").agg(F.max("x.share").alias("coverage"))


def summary(log: DataFrame, keys: tuple[str, ...] = ("system", "suite"), coverages: tuple[float, ...] = (0.8, 0.5), targets: tuple[float, ...] = (0.95, 0.99), thresholds: tuple[float, ...] = (0.9, 0.95)) -> DataFrame:
    """AGG-22 with AGG-01, AGG-05, AGG-06, WIN-04: one row per key: n, acc, aurc, acc_<coverage>, coverage_<target>, ece,
    decided_<threshold> and error_<threshold> (null where nothing is decided).

    As risk_coverage() and ece() (with zero), for many systems and suites at once. Items meet as groups of equal confidence of a
    key, and of those only the running sums need an order inside the key.
    """
    rows = log.filter("conf IS NOT NULL AND ok IS NOT NULL")
    groups = rows.groupBy(*keys, "conf").agg(F.count("*").alias("g"), F.sum("ok").cast("bigint").alias("ok"))
    down = Window.partitionBy(*keys).orderBy(F.desc("conf")).rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy(*keys)
    zero = F.lit(0).cast("bigint")
    groups = groups.select(*keys, "conf", "g", "ok", F.coalesce(F.sum("g").over(down), zero).alias("k0"), F.coalesce(F.sum("ok").over(down), zero).alias("ok0"), F.sum("g").over(own).alias("n"))
    r = F.col("ok") / F.col("g")
    area = F.col("g") * r + (F.col("ok0") - r * F.col("k0")) * (harmonic(F.col("k0") + F.col("g")) - harmonic(F.col("k0")))
    end, acc = F.col("k0") + F.col("g"), (F.col("ok0") + F.col("ok")) / (F.col("k0") + F.col("g"))
    name = lambda x: f"{round(100 * x)}"

    def at(c: float) -> Column:
        k = F.greatest(F.lit(1), F.bround(c * F.col("n"), 0).cast("bigint"))
        return F.max(F.when((F.col("k0") < k) & (k <= end), (F.col("ok0") + (k - F.col("k0")) * r) / k)).alias(f"acc_{name(c)}")

    decided = lambda t, x: F.sum(F.when(F.col("conf") >= t, F.col(x)).otherwise(zero))
    curve = groups.groupBy(*keys).agg(
        F.max("n").alias("n"), (F.sum("ok") / F.max("n")).alias("acc"), (1 - F.sum(area) / F.max("n")).alias("aurc"), *(at(c) for c in coverages),
        *(F.max(F.when(acc >= t, end / F.col("n")).otherwise(0.0)).alias(f"coverage_{name(t)}") for t in targets),
        *(x for t in thresholds for x in ((decided(t, "g") / F.max("n")).alias(f"decided_{name(t)}"), F.when(decided(t, "g") > 0, 1 - decided(t, "ok") / decided(t, "g")).alias(f"error_{name(t)}"))),
    )
    return curve.join(ece(log, keys, True).select(*keys, "ece"), list(keys))
