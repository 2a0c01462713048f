"""Portfolio-risk sizing: ranked rows consume the capacity of their account.

Only accepted rows change what later rows see, and an account holds at most
``MAX_POSITIONS``. So the accepted rows of each key are found first (a small,
bounded list), and then every row is judged against the ones accepted before it,
row by row and in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eqpanel import params as P
from eqpanel.functions.checkpoints import checkpointed
from eqpanel.functions.ordered import join_null_safe, largest_group

POSITION = (
    "struct<symbol:string,sector:string,correlated_group:string,quantity:bigint,market_price:double,risk_stop:double>"
)
HELD = (
    "struct<priority:bigint,symbol:string,sector:string,correlated_group:string,quantity:bigint,"
    "market_price:double,risk_stop:double>"
)
CONTEXT = ("equity", "cash", "max_loss", "buy_rate", "sell_rate", "fixed_cost")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _usage(positions: Column, sector: Column, group: Column) -> Column:
    """Held count, notional, open risk, and the parts in one sector and one group."""
    start = F.struct(
        F.lit(0).alias("n"), F.lit(0).alias("group_n"),
        *[F.lit(0.0).alias(x) for x in ("total", "risk", "sector", "group")],
    )

    def add(u: Column, p: Column) -> Column:
        notional = p["quantity"] * p["market_price"]
        same_sector, same_group = p["sector"] == sector, p["correlated_group"] == group
        zero = F.lit(0.0)
        return F.struct(
            (u["n"] + 1).alias("n"),
            (u["group_n"] + F.when(same_group, 1).otherwise(0)).alias("group_n"),
            (u["total"] + notional).alias("total"),
            (u["risk"] + F.greatest(zero, p["market_price"] - p["risk_stop"]) * p["quantity"]).alias("risk"),
            (u["sector"] + F.when(same_sector, notional).otherwise(zero)).alias("sector"),
            (u["group"] + F.when(same_group, notional).otherwise(zero)).alias("group"),
        )

    return F.aggregate(positions, start, add)


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def decide(row: dict[str, Column], account: dict[str, Column], positions: Column) -> Column:
    """struct(status, quantity, binding_constraint, estimated_loss, notional) of one row."""
    usage = _usage(positions, row["sector"], row["group"])
    return let(usage, lambda u: let(F.struct(*_sized(row, account, u)), lambda s: _verdict(account, lambda c: s[c])))


def with_decision(d: DataFrame, positions: Column, out: str) -> DataFrame:
    """``d`` with ``decide`` of each row in ``out``.

    The steps are columns, which Spark compiles; inside a lambda it interprets them.
    A filter on ``out`` would be pushed down and evaluated again: store it first.
    """
    d = d.withColumn("__used", _usage(positions, F.col("sector"), F.col("correlated_group")))
    sized = {f"__{name}": c for name, c in zip(SIZED, _sized(_row(), _account(), F.col("__used")), strict=True)}
    verdict = _verdict(_account(), lambda c: F.col(f"__{c}"))
    return d.withColumns(sized).withColumn(out, verdict).drop("__used", *sized)


SIZED = ("refused", "best", "per_share", "entry")


def _sized(row: dict[str, Column], account: dict[str, Column], used: Column) -> list[Column]:
    """The columns of ``SIZED``."""
    entry, stop, adv = (_finite(row[c]) for c in ("entry", "stop", "adv"))
    equity, cash, max_loss = account["equity"], account["cash"], account["max_loss"]
    buy, sell, fixed = account["buy_rate"], account["sell_rate"], account["fixed_cost"]
    lot, regime = P.LOT_SIZE, row["regime"]
    total_limit = multiplier = F.lit(None).cast("double")
    for name, (total, factor) in P.REGIME_LIMITS.items():
        total_limit = F.when(regime == name, F.lit(total)).otherwise(total_limit)
        multiplier = F.when(regime == name, F.lit(factor)).otherwise(multiplier)
    per_share = entry - stop + entry * buy + stop * sell
    budget = F.least(max_loss, equity * P.RISK_PER_TRADE * multiplier)

    def lots(x: Column) -> Column:
        return F.floor(x / lot) * lot

    def room(limit: Column, taken: Column, per: Column) -> Column:
        return lots(F.try_divide(F.greatest(F.lit(0.0), limit - taken), per))

    raw = lots(F.try_divide(budget - fixed, per_share))
    stop_fraction = F.try_divide(entry - stop, entry)
    unknown = lambda c: F.coalesce(c, F.lit(True))
    ceilings = {
        "RISK_BUDGET": raw,
        "AVAILABLE_CASH": lots(F.try_divide(cash, entry)),
        "SECURITY_EXPOSURE": lots(F.try_divide(equity * P.MAX_SECURITY_EXPOSURE, entry)),
        "TOTAL_EXPOSURE": room(equity * total_limit, used["total"], entry),
        "SECTOR_CONCENTRATION": room(equity * P.MAX_SECTOR_EXPOSURE, used["sector"], entry),
        "CORRELATED_EXPOSURE": room(equity * P.MAX_CORRELATED_EXPOSURE, used["group"], entry),
        "LIQUIDITY_PARTICIPATION": lots(adv * P.MAX_ADV_PARTICIPATION),
        "TOTAL_OPEN_RISK": room(equity * P.MAX_OPEN_RISK, used["risk"] + fixed, per_share),
    }
    refused = F.coalesce(
        F.when(F.length(F.coalesce(row["symbol"], F.lit(""))) == 0, "INVALID_SYMBOL"),
        F.when(unknown(entry <= 0), "ENTRY_PRICE_UNAVAILABLE"),
        F.when(unknown((stop <= 0) | (stop >= entry)), "RISK_STOP_INVALID"),
        F.when(stop_fraction < P.MIN_STOP_FRACTION, "MINIMUM_STOP_DISTANCE"),
        F.when(stop_fraction > P.MAX_STOP_FRACTION, "MAXIMUM_STOP_DISTANCE"),
        F.when(unknown(adv <= 0), "LIQUIDITY_UNAVAILABLE"),
        F.when(unknown((equity <= 0) | (cash < 0) | (max_loss <= 0)), "RISK_CONTEXT_INVALID"),
        F.when(unknown((buy < 0) | (sell < 0) | (fixed < 0)), "COST_MODEL_INVALID"),
        F.when(multiplier.isNull(), "REGIME_LIMIT_UNAVAILABLE"),
        F.when((budget <= fixed) | (per_share <= 0), "MAXIMUM_PERMITTED_LOSS"),
        F.when(raw < lot, "MINIMUM_LOT_RISK"),
        F.when(used["n"] >= P.MAX_POSITIONS, "CONCURRENT_POSITION_LIMIT"),
        F.when(used["group_n"] >= P.MAX_CORRELATED_POSITIONS, "CORRELATED_POSITION_LIMIT"),
    )
    tightest = F.array_min(F.array(*[F.struct(q.alias("q"), F.lit(n).alias("name")) for n, q in ceilings.items()]))
    values = (refused, F.when(refused.isNull(), tightest), per_share, entry)
    return [c.alias(name) for name, c in zip(SIZED, values, strict=True)]


def _verdict(account: dict[str, Column], sized) -> Column:
    max_loss, fixed, entry = account["max_loss"], account["fixed_cost"], sized("entry")
    quantity, binding = sized("best")["q"], sized("best")["name"]
    loss = quantity * sized("per_share") + fixed
    reject = F.coalesce(
        sized("refused"),
        F.when(quantity < P.LOT_SIZE, binding),
        F.when(loss > max_loss + 1e-9, "MAXIMUM_PERMITTED_LOSS"),
        F.when(quantity * entry < P.MIN_NOTIONAL, "MINIMUM_NOTIONAL"),
    )
    ok = reject.isNull()
    return F.struct(
        F.when(~ok, "REJECTED").when(binding == "RISK_BUDGET", "ACCEPTED").otherwise("RESIZED").alias("status"),
        F.when(ok, quantity).otherwise(F.lit(0)).cast("bigint").alias("quantity"),
        F.coalesce(reject, binding).alias("binding_constraint"),
        F.when(ok, loss).otherwise(F.lit(0.0)).alias("estimated_loss"),
        F.when(ok, quantity * entry).otherwise(F.lit(0.0)).alias("notional"),
    )


def _row(c=F.col) -> dict[str, Column]:
    names = {
        "symbol": "symbol", "entry": "entry_price", "stop": "risk_stop", "adv": "adv_shares", "sector": "sector",
        "group": "correlated_group", "regime": "regime",
    }
    return {k: c(v) for k, v in names.items()}


def _account() -> dict[str, Column]:
    return {c: F.col(c) for c in CONTEXT}


def _held(r, quantity: Column) -> Column:
    return F.struct(
        r("priority").cast("bigint").alias("priority"), r("symbol").alias("symbol"), r("sector").alias("sector"),
        r("correlated_group").alias("correlated_group"), quantity.cast("bigint").alias("quantity"),
        r("entry_price").cast("double").alias("market_price"), r("risk_stop").cast("double").alias("risk_stop"),
    )


def _as_positions(held: Column) -> Column:
    return F.transform(
        held,
        lambda h: F.struct(*[h[c].alias(c) for c in ("symbol", "sector", "correlated_group", "quantity", "market_price", "risk_stop")]),
    )


def approve(
    candidates: DataFrame, contexts: DataFrame, keys: Sequence[str], context_keys: Sequence[str] | None = None,
    group_bound: int | None = None,
) -> DataFrame:
    """Decisions for ranked candidates, per ``keys`` (such as account and date).

    ``candidates``: keys, ``priority`` (unique per key, 1 first), symbol, sector,
    correlated_group, entry_price, risk_stop, adv_shares, regime. ``contexts``: one row
    per ``context_keys`` with the account columns and ``positions``; a candidate
    without an account is judged against zero capital. ``group_bound`` is a proven
    bound on candidates per key; without one the largest group is measured.
    """
    keys = list(keys)
    context_keys = list(context_keys if context_keys is not None else keys)
    d = candidates.join(contexts, context_keys, "left")
    d = d.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in CONTEXT}).withColumn(
        "positions", F.coalesce("positions", F.array().cast(f"array<{POSITION}>"))
    )
    # rows refused with nothing reserved are refused later too: capacity only shrinks
    d = with_decision(d, F.col("positions"), "__d").withColumn("__alone", F.col("__d.status") != "REJECTED").drop("__d")
    # read again below, once per round or for the fold and for the decisions
    d = checkpointed(d)
    open_rows = d.where("__alone")
    if (group_bound if group_bound is not None else largest_group(open_rows, keys)) <= P.MAX_FOLD_GROUP:
        accepted = _accepted_by_fold(open_rows, keys)
    else:
        accepted = _accepted_by_rounds(open_rows, keys)
    none = F.array().cast(f"array<{HELD}>")
    d = join_null_safe(d, accepted.select(*keys, "__held"), keys, "left").withColumn("__held", F.coalesce("__held", none))
    before = F.filter("__held", lambda h: h["priority"] < F.col("priority"))
    seen = F.concat(F.col("positions"), _as_positions(before))
    d = with_decision(d, seen, "__d")
    decision_id = F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("symbol"), F.col("priority")), 256)
    return d.select(
        *candidates.columns, decision_id.alias("decision_id"), "__d.status", "__d.quantity", "__d.estimated_loss",
        "__d.notional", "__d.binding_constraint", F.lit(P.VERSION).alias("configuration_version"),
    )


def _accepted_by_fold(rows: DataFrame, keys: Sequence[str], earlier: DataFrame | None = None) -> DataFrame:
    """Walk the rows of each key in order, keeping only what was accepted.

    ``earlier`` (keys, ``__held``) is what was accepted before. Also returns
    ``__upto``, the priority of the last row walked.
    """
    item = F.struct(
        F.col("priority").cast("bigint").alias("priority"), "symbol", "sector", "correlated_group",
        F.col("entry_price").cast("double").alias("entry_price"), F.col("risk_stop").cast("double").alias("risk_stop"),
        F.col("adv_shares").cast("double").alias("adv_shares"), "regime",
    )
    grouped = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(item)).alias("__rows"), F.first("positions").alias("positions"),
        *[F.first(c).alias(c) for c in CONTEXT],
    )
    start = F.array().cast(f"array<{HELD}>")
    if earlier is not None:
        grouped = join_null_safe(grouped, earlier.select(*keys, "__held"), keys, "left")
        start = F.coalesce("__held", start)

    def step(held: Column, r: Column) -> Column:
        get = lambda c: r[c]
        seen = F.concat(F.col("positions"), _as_positions(held))
        verdict = decide(_row(get), _account(), seen)
        grown = lambda v: F.when(v["status"] != "REJECTED", F.array_append(held, _held(get, v["quantity"]))).otherwise(held)
        full = F.size(seen) >= P.MAX_POSITIONS
        return F.when(full, held).otherwise(let(verdict, grown))

    last = F.element_at("__rows", -1)["priority"].alias("__upto")
    return grouped.select(*keys, F.aggregate("__rows", start, step).alias("__held"), last)


def _accepted_by_rounds(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same list for keys of any size, a short fold per key and round.

    Rows that do not pass under the current holdings never will, because capacity
    only shrinks, so each round keeps those that do. The first of them is accepted:
    nothing changed since it passed. Folding the first ``FOLD_PREFIX`` (limited
    before the shuffle) accepts at least that one, so there are at most
    ``MAX_POSITIONS`` rounds, and no key is ever gathered in one task.
    """
    need = [*keys, "priority", "symbol", "sector", "correlated_group", "entry_price", "risk_stop", "adv_shares", "regime"]
    columns = [*need, "positions", *CONTEXT]
    rows, held = rows.select(*columns), None
    in_order = F.row_number().over(Window.partitionBy(*keys).orderBy("priority"))
    for _ in range(P.MAX_POSITIONS):
        first = rows.withColumn("__i", in_order).where(F.col("__i") <= P.FOLD_PREFIX).drop("__i")
        now = checkpointed(_accepted_by_fold(first, keys, held))
        if held is None:
            held = now.select(*keys, "__held")
        elif now.isEmpty():
            break
        else:
            grown = now.select(*keys, F.col("__held").alias("__grown"))
            held = checkpointed(join_null_safe(held, grown, keys, "left").select(*keys, F.coalesce("__grown", "__held").alias("__held")))
        # keys that hold all they may take nothing more
        left = join_null_safe(rows, now, keys).where((F.col("priority") > F.col("__upto")) & (F.size("positions") + F.size("__held") < P.MAX_POSITIONS))
        left = with_decision(left, F.concat(F.col("positions"), _as_positions(F.col("__held"))), "__d")
        rows = checkpointed(left.select(*columns, (F.col("__d.status") != "REJECTED").alias("__open"))).where("__open").drop("__open")
    return held


def exposure(positions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Count, notional and open risk of open positions per account (and sector, group)."""
    notional = F.col("quantity") * F.col("market_price")
    risk = F.greatest(F.lit(0.0), F.col("market_price") - F.col("risk_stop")) * F.col("quantity")
    return positions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("positions"), F.sum(notional).alias("notional"), F.sum(risk).alias("open_risk")
    )
