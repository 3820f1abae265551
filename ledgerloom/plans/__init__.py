"""Composite analyses.  ``load`` imports the modules whose queries the registry is to hold."""

from importlib import import_module

MODULES = ("store", "pairs", "policies", "texts", "inference", "planner", "streams", "cube", "synthetic")


def load() -> None:
    for name in MODULES:
        import_module(f"ledgerloom.plans.{name}")
