"""Exact rules of probability, finance, trade and answer checking, as columns and joins with parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdex.operators.calendar import business_index, thirty_360

# --- probability -----------------------------------------------------------------------------------------------------


def ln_choose(n: Column, k: Column) -> Column:
    """Logarithm of n over k; minus infinity (as null) where there is no such choice."""
    sums = F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + F.ln((n - k + i).cast("double")) - F.ln(i.cast("double")))
    return F.when((k >= 0) & (k <= n), sums)


def at_least(population: Column, bad: Column, sample: Column, c: Column) -> Column:
    """PRB-01: chance that a sample without replacement has c bad ones or more, to 4 places."""
    most = F.least(bad, sample)
    ways = lambda k: F.coalesce(F.exp(ln_choose(bad, k) + ln_choose(population - bad, sample - k) - ln_choose(population, sample)), F.lit(0.0))
    each = F.when(c <= most, F.sequence(c.cast("int"), F.greatest(most, c).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.round(F.aggregate(each, F.lit(0.0), lambda a, k: a + ways(k)), 4)


def raffle(tickets: Column, held: Column, drawn: Column) -> Column:
    """PRB-03: chance that one of the held tickets is drawn, to 4 places."""
    return F.round(1 - F.coalesce(F.exp(ln_choose(tickets - held, drawn) - ln_choose(tickets, drawn)), F.lit(0.0)), 4)


def in_series(parts: Column) -> Column:
    """PRB-02: chance that all of any number of parts work."""
    return F.aggregate(parts, F.lit(1.0), lambda a, p: a * p)


def in_parallel(parts: Column) -> Column:
    """PRB-02: chance that one part works at least."""
    return 1 - F.aggregate(parts, F.lit(1.0), lambda a, p: a * (1 - p))


def dice_sum_at_least(n: Column, faces: Column, total: Column) -> Column:
    """PRB-05: chance that n dice show a sum of `total` or more: the ways to each sum, added die by die."""
    start = F.array(F.lit(1.0))

    def add(ways: Column, _: Column) -> Column:
        window = lambda s: F.aggregate(F.slice(ways, F.greatest(s - faces, F.lit(0)) + 1, F.least(s, F.size(ways)) - F.greatest(s - faces, F.lit(0))), F.lit(0.0), lambda a, x: a + x)
        return F.transform(F.sequence(F.lit(0), F.size(ways) + faces - 1), lambda s: F.when(s == 0, 0.0).otherwise(window(s)))

    ways = F.aggregate(F.sequence(F.lit(1), n), start, add)
    fav = F.aggregate(F.slice(ways, total + 1, F.greatest(F.size(ways) - total, F.lit(0))), F.lit(0.0), lambda a, x: a + x)
    return F.round(fav / F.pow(faces, n), 4)


def dice_any(n: Column, faces: Column) -> Column:
    """PRB-05: chance that one of n dice at least shows a given face."""
    return F.round(1 - F.pow((faces - 1) / faces, n), 4)


# --- finance and trade -----------------------------------------------------------------------------------------------


def three_way_match(invoices: DataFrame, orders: DataFrame, receipts: DataFrame, tolerance: float) -> DataFrame:
    """FIN-04: invoices (invoice, po, qty, price) against orders (po, price) and receipts (po, qty), which may be several.

    No order: reject; then the quantity received must be the one invoiced; then the price may exceed the order's by
    tolerance percent. All three meet by po.
    """
    got = receipts.groupBy("po").agg(F.sum("qty").alias("received"))
    joined = invoices.join(orders.select("po", F.col("price").alias("agreed")), "po", "left").join(got, "po", "left")
    over = (F.col("price") - F.col("agreed")) / F.col("agreed") * 100 > tolerance
    outcome = F.when(F.col("agreed").isNull(), "reject_invoice").when(F.col("qty") != F.coalesce("received", F.lit(0)), "hold_quantity_mismatch").when(over, "hold_price_variance").otherwise("approve_payment")
    return joined.select("invoice", "po", outcome.alias("outcome"))


def pattern_day_traders(trades: DataFrame, days: int = 5, least: int = 4, share: float = 0.06) -> DataFrame:
    """TRD-02: (account, flagged) from trades (account, day, day_trades, trades): in some run of business days that ends on a
    trading day, so many day trades, and over that share of all trades in the run. An account's days, not trades, are sorted."""
    by_day = trades.groupBy("account", business_index(F.col("day")).alias("at")).agg(F.sum("day_trades").alias("d"), F.sum("trades").alias("t"))
    run = Window.partitionBy("account").orderBy("at").rangeBetween(1 - days, 0)
    d, t = F.sum("d").over(run), F.sum("t").over(run)
    return by_day.select("account", ((d >= least) & (d / t > share)).alias("hit")).groupBy("account").agg(F.max("hit").alias("flagged"))


def wash_sales(sales: DataFrame, purchases: DataFrame, days: int = 30) -> DataFrame:
    """TRD-03: sales at a loss (sale, account, asset, day) with whether the same was bought within days before or after.

    Purchases (account, asset, day) count once a day, so a key's window is over days.
    """
    number = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    bought = purchases.select("account", "asset", number("day").alias("n")).distinct().withColumn("b", F.lit(1)).withColumn("s", F.lit(0))
    sold = sales.select("account", "asset", number("day").alias("n")).distinct().withColumn("b", F.lit(0)).withColumn("s", F.lit(1))
    near = Window.partitionBy("account", "asset").orderBy("n").rangeBetween(-days, days)
    told = bought.union(sold).withColumn("hit", F.sum("b").over(near) > 0).filter("s = 1").select("account", "asset", "n", "hit")
    return sales.withColumn("n", number("day")).join(told, ["account", "asset", "n"]).select("sale", F.col("hit").alias("wash"))


def limit_fill(quotes: Column, limit: Column, side: Column) -> Column:
    """TRD-08, WIN-06: number from 1 of the first quote at or under a buy limit, at or over a sell limit; null without one."""
    at = F.array_position(F.transform(quotes, lambda q: F.when(side == "buy", q <= limit).otherwise(q >= limit)), True)
    return F.when(at > 0, at)


def stop_fill(bars: Column, stop: Column) -> Column:
    """TRD-05, WIN-06: (bar from 1, price) of a sell stop over bars (open, low): the first bar that trades at or under it; one
    that opens under it fills at its open, others at the stop; null if none does."""
    at = F.array_position(F.transform(bars, lambda b: b["low"] <= stop), True)
    opened = F.get(bars, at.cast("int") - 1)["open"]
    return F.when(at > 0, F.struct(at.alias("bar"), F.when(opened < stop, opened).otherwise(stop).alias("price")))


# The stage of a shipment from which on a contract term leaves the risk with the buyer.
TERM_STAGE = {"EXW": 1, "FCA": 2, "CPT": 2, "CIP": 2, "FAS": 3, "FOB": 4, "CFR": 4, "CIF": 4, "DAP": 5, "DDP": 5, "DPU": 6}


def risk_bearer(term: Column, stage: Column) -> Column:
    """TRD-09: who bears a loss at a stage from 0 (seller's store) to 6 (unloaded); null for an unknown term."""
    of = F.create_map(*(F.lit(x) for pair in TERM_STAGE.items() for x in pair))
    return F.when(of[term].isNotNull(), F.when(stage >= of[term], "buyer").otherwise("seller"))


def vat_treatment(seller: Column, buyer: Column, verified_business: Column) -> Column:
    """TRD-11: across a border to a verified business the charge is reversed; else the seller charges."""
    return F.when((seller != buyer) & verified_business, "reverse_charge_no_vat").otherwise("charge_vat")


def gst_lines(supplier: Column, place: Column, value: Column, rate: Column) -> Column:
    """TRD-12: between states one tax, inside one two halves: (igst, cgst, sgst)."""
    tax = F.round(value * rate, 2)
    inter = supplier != place
    return F.struct(F.when(inter, tax).otherwise(0.0).alias("igst"), *(F.when(inter, 0.0).otherwise(F.round(value * rate / 2, 2)).alias(x) for x in ("cgst", "sgst")))


def screen(customers: DataFrame, listed: DataFrame) -> DataFrame:
    """TRD-13: (id, outcome) of customers (id, name, dob) against a list (name, dob).

    The full name, or the first and last of the listed one, with the date of birth: confirmed_match; with another one:
    false_positive; else no_match. Of several entries of a name the gravest counts. The two meet by name.
    """
    parts = F.split(F.trim("name"), r"\s+")
    short = F.concat_ws(" ", F.get(parts, F.lit(0)), F.get(parts, F.size(parts) - 1))
    keys = listed.select(F.explode(F.array_distinct(F.array(F.array_join(parts, " "), short))).alias("key"), F.col("dob").alias("listed_dob"))
    keys = keys.groupBy("key").agg(F.collect_set("listed_dob").alias("dobs"))  # people of one name
    name = F.array_join(F.split(F.trim("name"), r"\s+"), " ")
    joined = customers.withColumn("key", name).join(keys, "key", "left")
    return joined.select("id", F.when(F.col("dobs").isNull(), "no_match").when(F.array_contains("dobs", F.col("dob")), "confirmed_match").otherwise("false_positive").alias("outcome"))


def suitable(product: Column, profile: Column, horizon: Column, holding: Column) -> Column:
    """TRD-14: the product's risk class isn't over the profile, and the horizon covers the least holding period."""
    return (product <= profile) & (horizon >= holding)


def in_dispute_window(transaction: Column, delivery: Column, from_delivery: Column, filed: Column, days: Column) -> Column:
    """TRD-16: filed within so many days of the date that the rule names."""
    return F.datediff(filed, F.when(from_delivery, delivery).otherwise(transaction)) <= days


# --- answer checking -------------------------------------------------------------------------------------------------


def perturbed(gold: Column, kind: Column, by: Column) -> Column:
    """JDG-01: a wrong value: `mul` and `scale` times by, `add` plus the share by of it (0.5 at least), `sign` negated (0: 1),
    `swap` with the digits at and behind place by of its two-decimal form exchanged, or times 1.2 where that changes nothing."""
    digits = F.regexp_replace(F.format_string("%.2f", F.abs(gold)), r"\.", "")
    i = by.cast("int")
    swapped = F.concat(F.substring(digits, F.lit(1), i), F.substring(digits, i + 2, F.lit(1)), F.substring(digits, i + 1, F.lit(1)), F.substring(digits, i + 3, F.length(digits)))
    value = F.concat(F.substring(swapped, F.lit(1), F.length(swapped) - 2), F.lit("."), F.right(swapped, F.lit(2))).cast("double") * F.when(gold >= 0, 1).otherwise(-1)
    changed = F.when((F.length(digits) >= 3) & (F.abs(value - gold) > 1e-6), value).otherwise(gold * 1.2)
    return (
        F.when(kind.isin("mul", "scale"), gold * by).when(kind == "add", gold + F.signum(by) * F.greatest(F.abs(gold * by), F.lit(0.5)))
        .when(kind == "sign", F.when(gold != 0, -gold).otherwise(1.0)).otherwise(changed)
    )


def same_number(proposed: Column, gold: Column) -> Column:
    """JDG-02: whether a text is a number within 1e-6 of gold; null if it is none."""
    value = F.regexp_replace(F.trim(F.regexp_replace(proposed, "[,$]", "")), r"\.+$", "").try_cast("double")
    return F.abs(value - gold) < 1e-6


# --- conditions, time, money and markets as columns; amounts are doubles, dates are dates ------------------------------


def permitted(base: Column, exception: Column) -> Column:
    """RUL-06: the base rule holds and no exception does; a null holds nothing."""
    return F.coalesce(base, F.lit(False)) & ~F.coalesce(exception, F.lit(False))


def tier(value: Column, cuts: tuple[float, ...], exempt: Column | None = None) -> Column:
    """RUL-08: `tier0` to `tierN`: how many cuts lie strictly below the value; `exempt` where that holds."""
    n = sum(((value > c).cast("int") for c in cuts), F.lit(0))
    name = F.concat(F.lit("tier"), n.cast("string"))
    return name if exempt is None else F.when(exempt, "exempt").otherwise(name)


def risk_level(findings: list[Column], critical: Column) -> Column:
    """RUL-09: 0, 1 or 2 for no, one or more findings, 3 for a critical one."""
    n = sum((F.coalesce(x, F.lit(False)).cast("int") for x in findings), F.lit(0))
    return F.when(critical, 3).otherwise(F.least(F.lit(2), n))


def notice_in_time(given: Column, end: Column, days: Column | int) -> Column:
    """TMP-03: notice is given so many days before the end, or earlier."""
    return F.datediff(end, given) >= days


def prorated_refund(paid: Column, start: Column, cancelled: Column, months: int = 12, fee: float = 25.0) -> Column:
    """TMP-04: what is paid for months that haven't begun, less a fee; a month has 30 days, and a refund isn't negative."""
    begun = F.ceil(F.abs(F.datediff(cancelled, start)) / 30.0)
    return F.greatest(F.lit(0.0), paid * (months - begun) / months - fee)


def shifted(minute: Column, minutes: Column) -> tuple[Column, Column]:
    """TMP-05: (minute of the day, days on) of a local time after a shift by minutes, as between two zones."""
    t = minute + minutes
    day = F.floor(t / 1440.0)
    return (t - day * 1440).cast("bigint"), day.cast("bigint")


def late_fee(amount: Column, due: Column, paid: Column, weekly: float = 1.5, cap: float = 12.0) -> Column:
    """TMP-06: percent for each week that has begun, up to a cap."""
    return amount * F.least(F.ceil(F.greatest(F.datediff(paid, due), F.lit(0)) / 7.0) * weekly, F.lit(cap)) / 100


def posterior(prior: Column, sensitivity: Column | float, false_positive: Column) -> Column:
    """PRB-04: the probability of the condition after a positive test."""
    hit = prior * sensitivity
    return hit / (hit + (1 - prior) * false_positive)


def count_classes(p: Column, q: Column) -> tuple[Column, Column, Column]:
    """PRB-06: none, one or both of two independent events, to four places; the last is what the rounded others leave."""
    none, one = F.round((1 - p) * (1 - q), 4), F.round(p * (1 - q) + q * (1 - p), 4)
    return none, one, F.round(1 - none - one, 4)


def instalment(principal: Column, yearly_percent: Column, months: Column) -> Column:
    """FIN-01: the monthly instalment of an annuity; without interest, equal parts."""
    i = yearly_percent / 1200.0
    return F.when(i == 0, principal / months).otherwise(principal * i / (1 - F.pow(1 + i, -months)))


def exchanged(amount: Column, fee: Column | float, mid: Column, spread: Column) -> Column:
    """FIN-02: the fee first, then the rate with its spread."""
    return (amount - fee) * mid * (1 - spread)


def loan_approved(debt_share: Column, most: float, others: list[Column]) -> Column:
    """FIN-03: the debt's share of the income is within the limit, and all other conditions hold."""
    out = debt_share <= most
    for x in others:
        out = out & x
    return F.coalesce(out, F.lit(False))


def liquidation_price(entry: Column, leverage: Column, maintenance: float, side: str) -> Column:
    """FIN-06: where an isolated position is closed: entry (1 - 1/leverage + rate) of a long, (1 + 1/leverage - rate) of a short."""
    return entry * (1 - 1.0 / leverage + maintenance) if side == "long" else entry * (1 + 1.0 / leverage - maintenance)


def pre_trade(restricted: Column, position: Column, quantity: Column, price: Column, position_limit: Column | float, notional_limit: Column | float) -> Column:
    """FIN-07: the first check that an order fails: the restricted list, the position that it would make, its own notional."""
    return F.when(restricted, "restricted").when(position + quantity > position_limit, "position").when(quantity * price > notional_limit, "notional").otherwise("accept")


def net_pnl(buy: Column, sell: Column, quantity: Column, cost_bp: Column | float) -> Column:
    """FIN-08: the gain less costs in basis points of both sides."""
    return (sell - buy) * quantity - (quantity * buy + quantity * sell) * cost_bp / 10000


def auto_exercised(kind: Column, settlement: Column, strike: Column) -> Column:
    """FIN-10: an option (call or put) is a cent or more in the money at settlement, with room for rounding."""
    return F.when(kind == "call", settlement - strike).otherwise(strike - settlement) >= 0.01 - 1e-9


def margin_called(value: Column, debt: Column, maintenance: float) -> Column:
    """TRD-01: the equity is strictly under the requirement."""
    return value - debt < maintenance * value


def within_band(price: Column, reference: Column, steps: tuple[tuple[float, float], ...], last: float) -> Column:
    """TRD-04: the price is within a share of the reference, which the first step (below, share) that fits it gives, else
    `last`; with room for rounding."""
    share = F.lit(last)
    for below, x in reversed(steps):
        share = F.when(reference < below, x).otherwise(share)
    return F.abs(price - reference) <= reference * share + 1e-9


def accrued_interest(principal: Column, rate: Column | float, start: Column, end: Column, convention: str) -> Column:
    """TRD-06: by act/360, act/365 or 30E/360."""
    days = thirty_360(start, end) if convention == "30E/360" else F.datediff(end, start)
    return principal * rate * days / (365 if convention == "act/365" else 360)


def concentration_allowed(held: Column, bought: Column, total: Column, share: float) -> Column:
    """TRD-07: what is held of an issuer after the purchase is at most a share of the total."""
    return (held + bought) / total <= share + 1e-12


def presented_in_time(presented: Column, shipped: Column, expiry: Column, days: Column | int) -> Column:
    """TRD-10: documents come so many days after shipment at most, and before the credit ends."""
    return presented <= F.least(F.date_add(shipped, days), expiry)
