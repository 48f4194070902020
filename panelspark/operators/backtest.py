"""Signal backtest (I1–I3, G7): one-step band → BUY/SELL/HOLD → cash/shares fold → summary.

The fold is sequential by nature (cash after a trade decides the next one).  It runs per (series, session day) with
``applyInPandas``: a group is one trading session, bounded by the bar frequency (≤ 1,440 one-minute bars), never a
whole series; sessions are independent because every replay starts from the initial cash (as the reference does).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.windows import _W


def seasonal_one_step_band(panel: DataFrame, season_length: int, q: float = 0.9, train_frac: float = 0.8) -> DataFrame:
    """The forecast for row i+1 issued after row i (seasonal naive: ``y_{i+1−m}``) with a split-conformal band:
    ``± quantile_q |y_t − y_{t−m}|`` over the first ``train_frac`` of each series.  Adds ``next_pred, lower, upper``."""
    w = _W()
    n = F.count("*").over(Window.partitionBy("unique_id"))
    d = panel.withColumns({"__pos": F.row_number().over(w), "__n": n,
                           "__err": F.abs(F.col("y") - F.lag("y", season_length).over(w)),
                           "next_pred": F.lag("y", season_length - 1).over(w)})
    from panelspark.operators.relational import exact_percentiles

    qs = exact_percentiles(d.filter(F.col("__pos") <= F.floor(F.col("__n") * train_frac)), ["unique_id"], "__err", [q],
                           ["__q"])
    d = d.join(qs, "unique_id", "left")
    return d.withColumns({"lower": F.col("next_pred") - F.col("__q"), "upper": F.col("next_pred") + F.col("__q")}) \
            .drop("__n", "__err", "__q")


def signals(df: DataFrame, warmup: int = 11, price: str = "y") -> DataFrame:
    """BUY if price < lower and next forecast > price; SELL if price > upper and next forecast < price; else HOLD.
    The first ``warmup`` rows of each session (series and calendar day, as the position fold replays it) always HOLD."""
    pos = F.row_number().over(Window.partitionBy("unique_id", F.to_date("ds")).orderBy("ds"))
    p = F.col(price)
    sig = (F.when(pos <= warmup, "HOLD")
            .when((p < F.col("lower")) & (F.col("next_pred") > p), "BUY")
            .when((p > F.col("upper")) & (F.col("next_pred") < p), "SELL")
            .otherwise("HOLD"))
    return df.withColumn("signal", sig)


def breach(df: DataFrame) -> DataFrame:
    """The next actual falls outside the band issued for it."""
    nxt = F.lead("y").over(_W())
    return df.withColumn("breach", F.coalesce((nxt < F.col("lower")) | (nxt > F.col("upper")), F.lit(False)))


FOLD_SCHEMA = ("unique_id string, session date, ds timestamp_ntz, y double, signal string, action string, "
               "cash double, shares double, value double")


def _fold_session(pdf: pd.DataFrame, initial_cash: float) -> pd.DataFrame:
    pdf = pdf.sort_values("ds")
    cash, shares = float(initial_cash), 0.0
    act, cs, sh, val = [], [], [], []
    for price, sig in zip(pdf["y"].to_numpy(dtype=float), pdf["signal"].to_numpy()):
        a = "HOLD"
        if sig == "BUY" and cash > price and price > 0:
            n = np.floor(cash / price)
            cash -= n * price
            shares += n
            a = "BUY"
        elif sig == "SELL" and shares > 0:
            cash += price * shares
            shares = 0.0
            a = "SELL"
        act.append(a)
        cs.append(cash)
        sh.append(shares)
        val.append(cash + shares * price)
    return pd.DataFrame({"unique_id": pdf["unique_id"].to_numpy(), "session": pdf["session"].to_numpy(),
                         "ds": pdf["ds"].to_numpy(), "y": pdf["y"].to_numpy(), "signal": pdf["signal"].to_numpy(),
                         "action": act, "cash": cs, "shares": sh, "value": val})


def position_fold(df: DataFrame, initial_cash: float = 10000.0) -> DataFrame:
    """BUY spends ``floor(cash/price)`` shares when cash > price, SELL clears; a non-executable signal is HOLD;
    value = cash + shares·price.  One replay per (series, session day)."""
    d = df.select("unique_id", F.to_date("ds").alias("session"), "ds", "y", "signal")
    return d.groupBy("unique_id", "session").applyInPandas(lambda p: _fold_session(p, initial_cash), FOLD_SCHEMA)


def summary(fold: DataFrame, scored: DataFrame | None = None, initial_cash: float = 10000.0) -> DataFrame:
    """Final value, total return %, trades, buys, sells per (series, session) (+ MAE/RMSE of the one-step
    forecast when ``scored`` with ``next_pred`` is given)."""
    s = fold.groupBy("unique_id", "session").agg(
        F.max_by("value", "ds").alias("final_value"),
        F.sum((F.col("action") != "HOLD").cast("int")).alias("trades"),
        F.sum((F.col("action") == "BUY").cast("int")).alias("buys"),
        F.sum((F.col("action") == "SELL").cast("int")).alias("sells"))
    s = s.withColumn("total_return_pct", (F.col("final_value") - initial_cash) / initial_cash * 100)
    if scored is not None:
        e = scored.select("unique_id", F.to_date("ds").alias("session"),
                          (F.lead("y").over(_W()) - F.col("next_pred")).alias("__e"))
        m = e.groupBy("unique_id", "session").agg(F.avg(F.abs("__e")).alias("mae"),
                                                  F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("rmse"))
        s = s.join(m, ["unique_id", "session"], "left")
    return s
