"""Queries bound to the test tables."""

from importlib import import_module

MODULES: list[str] = ["kpis", "participants", "filters", "joins", "versions", "sources", "sets", "text", "identity", "decisions", "audits", "streams"]


def load() -> None:
    for name in MODULES:
        import_module(f"tallyloom.plans.{name}")
