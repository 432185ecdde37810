"""Registered queries, one module per operator family."""

from importlib import import_module

FAMILIES = ("text", "pages", "chunks", "retrieval", "routing", "audit", "evaluation", "quality", "operations",
            "lifecycle", "streams")


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"passagework.plans.{family}")
