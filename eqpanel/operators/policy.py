"""Entry gates, volume by setup direction, exit order and what may be published."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eqpanel import params as P
from eqpanel.functions.series import clip

#: Setup families whose volume must fall; the others want it to rise.
QUIET = ("PULLBACK", "REVERSAL", "DEFENSIVE")
#: Least regime level a profile is traded in.
REGIME_FLOOR = {"DEFENSIVE": 1, "LARGE_CAP": 2, "HIGH_BETA": 3, "SPECULATIVE": 4}


def volume_score(family: Column, volume_z: Column) -> Column:
    """0 to 1: quiet volume for pullbacks and reversals, loud volume for trend and momentum; null without either."""
    quiet, loud = clip(2 - volume_z, 0.0, 1.0), clip((volume_z - 1) / 1.5, 0.0, 1.0)
    return F.when(family.isin(*QUIET), quiet).when(family.isNotNull(), loud)


def gate_chain(
    rows: DataFrame, adv_floor: float, least_sessions: int = 280, risk_limit: float = 75.0, floors: Mapping[str, int] = REGIME_FLOOR, least_sample: int = 30
) -> DataFrame:
    """Adds ``gate``: the first gate a row fails, or PASSED. What is missing fails.

    Columns: regime_level, member, sessions, adv20, flagged, archetype,
    risk_proxy, dq_score, exogenous_ok, long_rank, short_rank, family (null
    without a setup), volume_z60, score, win_probability and sample (the
    probability counts only from ``least_sample`` trades on), r_unit, atr14,
    risk_reward, risk_stop, exit_stop, entry_price, ceiling. Momentum wants a
    high short rank, everything else a low one.
    """
    return ranked_gate(known_gates(rows, adv_floor, least_sessions, risk_limit, floors, least_sample)).drop(*KNOWN)


#: What ``known_gates`` adds.
KNOWN = ("__first", "__momentum", "__behind")


def known_gates(
    rows: DataFrame, adv_floor: float, least_sessions: int = 280, risk_limit: float = 75.0, floors: Mapping[str, int] = REGIME_FLOOR, least_sample: int = 30
) -> DataFrame:
    """The part of ``gate_chain`` that needs no rank, so that rows can be ranked without the columns behind it.

    Adds the first failing gate before the ranks' gate, whether the row is momentum,
    and the first failing gate behind the ranks'.
    """
    c = F.col
    ok = lambda x: F.coalesce(x, F.lit(False))
    floor = F.coalesce(*[F.when(c("archetype") == a, F.lit(n)) for a, n in floors.items()])
    momentum = ok(c("family") == "MOMENTUM")
    likely = (F.coalesce("sample", F.lit(0)) < least_sample) | (c("win_probability") >= 0.55)
    geometry = (
        (c("score") >= 60) & ok(likely) & (c("r_unit") / c("atr14") >= 0.8) & (c("risk_reward") >= 1.7) & (c("risk_stop") < c("exit_stop"))
        & (c("exit_stop") < c("entry_price")) & (c("entry_price") < c("ceiling") * 0.995)
    )
    before = {
        "GATE0_REGIME": c("regime_level") > 0,
        "GATE1_ELIGIBILITY": c("member") & (c("sessions") >= least_sessions) & (c("adv20") >= adv_floor) & ~c("flagged") & (c("archetype") != "EXCLUDED"),
        "GATE2_RISK": (c("risk_proxy") < risk_limit) & (c("dq_score") >= P.DQ_ACTIONABLE_BLOCK),
        "GATE3_ARCHETYPE_REGIME": (c("regime_level") >= floor) & c("exogenous_ok"),
    }
    behind = {
        "GATE4B_SETUP": c("family").isNotNull() & (volume_score(c("family"), c("volume_z60")) > 0),
        "GATE5_GEOMETRY": geometry,
    }
    first = lambda gates: F.coalesce(*[F.when(~ok(x), F.lit(n)) for n, x in gates.items()])
    return rows.withColumns(dict(zip(KNOWN, (first(before), momentum, first(behind)), strict=True)))


def ranked_gate(known: DataFrame) -> DataFrame:
    """``known_gates`` with long_rank and short_rank: adds ``gate`` as ``gate_chain`` does."""
    c = F.col
    short = F.when(c("__momentum"), c("short_rank") >= P.RS_SHORT_MOMENTUM_MIN).otherwise(c("short_rank") <= P.RS_SHORT_PULLBACK_MAX)
    dual = F.coalesce((c("long_rank") >= P.RS_LONG_MIN) & short, F.lit(False))
    return known.withColumn("gate", F.coalesce("__first", F.when(~dual, F.lit("GATE4A_DUAL_CONDITION")), "__behind", F.lit("PASSED")))


def exit_decision(row: Mapping[str, Column]) -> Column:
    """(reason, action, urgent) of the first exit rule that applies, null if none does.

    Keys: risk_proxy, risk_at_entry, close, exit_stop, regime, target_1,
    sold_before, trailing_stop, held, hold_max, profit_r, thesis_broken. The
    trailing stop counts only once something has been sold, the first target only
    before.
    """
    r = row
    rules = [
        ((r["risk_proxy"] >= 75) | (r["risk_proxy"] - r["risk_at_entry"] >= 25), "P1_ANOMALY", "EXIT", True),
        (r["close"] <= r["exit_stop"], "P2_EXIT_STOP", "EXIT", True),
        (r["regime"] == "PANIC_BEAR", "P3_REGIME", "EXIT", True),
        (~r["sold_before"] & (r["close"] >= r["target_1"]), "P4_TARGET", "SELL_HALF", False),
        (r["sold_before"] & (r["close"] <= r["trailing_stop"]), "P5_TRAILING", "EXIT", True),
        ((r["held"] >= r["hold_max"]) & (r["profit_r"] < 0.5), "P6_TIME", "EXIT", False),
        (r["thesis_broken"], "P7_THESIS", "EXIT", False),
    ]
    return F.coalesce(
        *[F.when(x, F.struct(F.lit(n).alias("reason"), F.lit(a).alias("action"), F.lit(u).alias("urgent"))) for x, n, a, u in rules]
    )


def nav_fractions(rows: DataFrame, equity: str, money: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep`` columns and the ``money`` columns as shares of ``equity``, named ``<column>_nav``; nothing else leaves.

    Without positive equity the shares are null.
    """
    base = F.when(F.col(equity) > 0, F.col(equity).cast("double"))
    return rows.select(*keep, *[(F.col(c) / base).alias(f"{c}_nav") for c in money])


#: Words in a column name that say it holds capital.
CAPITAL = ("equity", "cash", "notional", "quantity", "shares", "balance", "capital", "vnd", "loss_amount")


def privacy_problems(rows: DataFrame, scale: float = 100_000.0) -> DataFrame:
    """(column, problem, rows): columns that must not be published, by name or by whole numbers of currency size."""
    numbers = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double") or f.dataType.typeName().startswith("decimal")]
    named = [f.name for f in rows.schema.fields if any(w in f.name.lower() for w in CAPITAL) and not f.name.lower().endswith(("_nav", "_fraction"))]
    whole = lambda c: (F.abs(F.col(f"`{c}`")) >= scale) & (F.col(f"`{c}`").cast("double") == F.rint(F.col(f"`{c}`").cast("double")))
    sizes = rows.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(whole(c)).alias(f"__{i}") for i, c in enumerate(numbers)])
    found = [F.struct(F.lit(c).alias("column"), F.lit("names capital").alias("problem"), F.col("__n").alias("rows")) for c in named]
    found += [F.struct(F.lit(c).alias("column"), F.lit("holds amounts").alias("problem"), F.col(f"__{i}").alias("rows")) for i, c in enumerate(numbers)]
    empty = "array<struct<column:string,problem:string,rows:bigint>>"
    return sizes.select(F.explode(F.array(*found) if found else F.array().cast(empty)).alias("f")).select("f.*").where("rows > 0 OR problem = 'names capital'")
