"""Named queries, one module per family, each with the SQL it is checked against."""

from __future__ import annotations

import importlib

FAMILIES = ("corpus", "chat", "layout", "order", "synthetic", "evaluation", "telemetry")


def load_all():
    from millrace.plans import registry

    for family in FAMILIES:
        importlib.import_module(f"millrace.plans.{family}")
    return registry.QUERIES, registry.ORACLES
