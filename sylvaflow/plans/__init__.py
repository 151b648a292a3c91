"""Registered queries; importing this package fills the catalogue."""

from importlib import import_module

from sylvaflow.plans.catalog import ORACLES, QUERIES

for _name in ("observation", "stand", "scalar", "cell", "change", "verdict", "sample", "score", "label", "storage", "inspection"):
    import_module(f"sylvaflow.plans.{_name}_queries")

__all__ = ["ORACLES", "QUERIES"]
