"""The registries of the training-data operators."""

from __future__ import annotations


def registries() -> list:
    from weftwork.llm import plans

    return [plans.REG]
