"""The built-in factor definitions as trees, and the fields that each reads."""

from __future__ import annotations


def field(name: str) -> dict:
    return {"field": name}


def op(name: str, left: str | dict, right: str | dict) -> dict:
    side = lambda x: field(x) if isinstance(x, str) else x
    return {"op": name, "left": side(left), "right": side(right)}


def last_four(name: str) -> dict:
    return {"op": "sum_last_n_quarters", "n": 4, "field": name}


INCOME, EPS = "net_income_attributable_consolidated_ifrs", "basic_eps_consolidated_ifrs"
EQUITY = "equity_attributable_to_common_consolidated_ifrs"
#: Names are those of the registered queries; later trees may use earlier ones as fields.
BUILT_IN = {
    "fac_mcap_ex_treasury": op("mul", op("sub", "shares_issued", "shares_treasury"), "close_price_adjusted"),
    "fac_mcap_official": op("mul", "shares_issued", "close_price_adjusted"),
    "fac_per_ttm": op("div", "fac_mcap_ex_treasury", last_four(INCOME)),
    "fac_per_annual": op("div", "fac_mcap_ex_treasury", f"{INCOME}_annual"),
    "fac_per_official": op("div", "market_cap_krx_official", f"{INCOME}_annual"),
    "fac_pbr": op("div", "fac_mcap_ex_treasury", EQUITY),
    "fac_roe_ttm": op("div", last_four(INCOME), {"op": "avg", "args": [field(f"{EQUITY}_period_begin"), field(EQUITY)]}),
    "fac_eps_ttm": last_four(EPS),
    "fac_dividend_yield": op("ratio_pct", "dividend_per_share_trailing_annual", "close_price_adjusted"),
    "fac_turnover_20d": op("ratio_pct", "trading_value_20d_avg", "fac_mcap_ex_treasury"),
    "fac_total_return_1y": field("total_return_trailing_1y"),
    "fac_ffo_multiple_reit": op("div", "fac_mcap_ex_treasury", op("add", f"{INCOME}_annual", "depreciation_expense_annual")),
    "fac_dividend_yield_reit": op("ratio_pct", "dividends_paid_annual", "fac_mcap_ex_treasury"),
}


#: Factors that depend on dividends, which may be corrected without a new batch of prices or statements.
NEVER_SERVED = ("fac_dividend_yield", "fac_total_return_1y")


def reads(tree: dict) -> list[str]:
    """The fields that a tree names."""
    own = [tree["field"]] if "field" in tree else []
    for child in [tree[k] for k in ("left", "right") if k in tree] + list(tree.get("args", [])):
        own += reads(child)
    return list(dict.fromkeys(own))


def plan(names: list[str], trees: dict[str, dict]) -> tuple[dict[str, dict], list[str]]:
    """The trees that ``names`` need, each after those it uses, and the stored fields they read."""
    order: dict[str, dict] = {}
    stored: list[str] = []

    def add(name: str, above: tuple[str, ...]) -> None:
        if name in above:
            raise ValueError(f"cycle: {' -> '.join((*above, name))}")
        for f in reads(trees[name]):
            if f in trees:
                add(f, (*above, name))
            elif f not in stored:
                stored.append(f)
        order.setdefault(name, trees[name])

    for name in names:
        add(name, ())
    return order, stored
