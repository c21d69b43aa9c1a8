"""Strategy parameters, algorithms of the rule language, and their fixed defaults."""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import product


# Defaults of the strategy.
@dataclass(frozen=True)
class Params:
    gate: str = "sma200"
    gate_exit_all: bool = False
    rsi_min: float = 50
    rsi_max: float = 80
    high_within_pct: float = 15
    rank_by: str = "momentum"
    mom_lookback: int = 126
    rebalance_every: int = 5
    trail_pct: float = 20
    exit_below_sma50: bool = True
    sizing: str = "slots"
    slots: int = 20
    sector_cap: int = 4
    risk_pct: float = 1.0
    stop_vol_mult: float = 3
    max_pos_pct: float = 15
    fee_bps: float = 10
    capital: float = 100_000
    lot: int = 1

    def with_(self, **changes) -> Params:
        return replace(self, **changes)


# What the default grid combines.
GRID = {"slots": (10, 20, 30), "trail_pct": (10, 15, 20, 25), "rsi_min": (45, 50, 55), "high_within_pct": (10, 20, 30)}


def combinations(grid: dict = GRID) -> list[dict]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def _op(ind: str, n: int | None = None) -> dict:
    return {"ind": ind} | ({"n": n} if n else {})


def _num(v: float) -> dict:
    return {"ind": "num", "v": v}


def _rule(a: dict, op: str, b: dict) -> dict:
    return {"a": a, "op": op, "b": b}


# Thresholds of the four preset algorithms.
PRESETS = {
    "pullback": {"entry": {"join": "all", "rules": [_rule(_op("close"), ">", _op("sma", 200)), _rule(_op("rsi", 14), "<", _num(40)), _rule(_op("idx"), ">", _op("idxsma", 200))]}, "exit": {"rules": [_rule(_op("rsi", 14), ">", _num(65))], "stop_loss": 10, "take_profit": 0, "max_hold": 30}, "rank": {"ind": "ret", "n": 126, "dir": "high"}, "eval": {"horizon": 21, "label": "beat", "step": 5}},
    "golden_cross": {"entry": {"join": "all", "rules": [_rule(_op("ema", 12), "xup", _op("ema", 26)), _rule(_op("sma", 50), ">", _op("sma", 200))]}, "exit": {"rules": [_rule(_op("ema", 12), "xdown", _op("ema", 26))], "stop_loss": 12, "take_profit": 0, "max_hold": 0}, "rank": {"ind": "ret", "n": 63, "dir": "high"}, "eval": {"horizon": 21, "label": "beat", "step": 5}},
    "breakout": {"entry": {"join": "all", "rules": [_rule(_op("dhigh", 55), ">=", _num(0)), _rule(_op("close"), ">", _op("sma", 50))]}, "exit": {"rules": [_rule(_op("close"), "<", _op("sma", 50))], "stop_loss": 8, "take_profit": 30, "max_hold": 0}, "rank": {"ind": "vol", "n": 20, "dir": "low"}, "eval": {"horizon": 21, "label": "beat", "step": 5}},
    "reversion": {"entry": {"join": "all", "rules": [_rule(_op("rsi", 14), "<", _num(30)), _rule(_op("dhigh", 252), ">", _num(-40))]}, "exit": {"rules": [_rule(_op("close"), ">", _op("sma", 20))], "stop_loss": 10, "take_profit": 0, "max_hold": 15}, "rank": {"ind": "rsi", "n": 14, "dir": "low"}, "eval": {"horizon": 10, "label": "beat", "step": 5}},
}
