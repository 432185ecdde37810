"""Registered queries of the training-data operators, one module each."""

from importlib import import_module

FAMILIES = ("chat", "pii", "packing", "toxicity", "quality_cnn", "language", "prefix_hash", "decontaminate", "line_chunks", "near_dedup", "alignment", "importance", "weak_rules")


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"passagework.llm.plans.{family}")
