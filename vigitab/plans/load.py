"""Import every query module so that the registry is full."""

import importlib

from .registry import REGISTRY

MODULES = ["q_signals", "q_terms", "q_evidence", "q_resample", "q_features", "q_nested", "q_quality", "q_replication"]
for _m in MODULES:
    importlib.import_module(f"{__package__}.{_m}")

__all__ = ["REGISTRY"]
