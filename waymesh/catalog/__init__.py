"""All registered queries; importing the package fills the registry."""
from importlib import import_module

from .registry import all_oracles, all_queries

MODULES = (
    "scans", "scalars", "geometry", "joins", "aggregates", "windows", "sets", "graphs",
    "preprocess", "segments", "anchors", "replacement", "rules", "quality", "lanes",
    "review", "scoring", "followup", "checks", "streams", "searches",
)
for _module in MODULES:
    import_module(f"{__name__}.{_module}")

__all__ = ["all_queries", "all_oracles"]
