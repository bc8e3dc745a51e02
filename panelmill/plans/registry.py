"""Name -> query and name -> SQL, gathered from the plan modules."""

from __future__ import annotations

from importlib import import_module

MODULES = ["bars_plan", "indicators_plan", "crosssection_plan", "labels_plan", "events_plan", "factors_plan", "search_plan", "research_plan", "audit_plan", "ladders_plan", "signals_plan", "governance_plan", "panel_plan", "holdings_plan", "identity_plan", "ledger_plan", "reconcile_plan", "live_plan"]


def queries() -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(import_module(f"panelmill.plans.{name}").QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found.update(import_module(f"panelmill.plans.{name}").ORACLES)
    return found
