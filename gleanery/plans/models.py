"""Retrieval models."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class UnrankedBoolean:
    default_op: str = "#AND"


@dataclass(frozen=True)
class RankedBoolean:
    default_op: str = "#AND"


@dataclass(frozen=True)
class BM25:
    k1: float = 1.2
    b: float = 0.75
    default_op: str = "#SUM"


def model_of(name: str, params: dict | None = None):
    """By the exact name used in parameter files."""
    params = params or {}
    if name == "BM25":
        return BM25(float(params.get("BM25:k_1", 1.2)), float(params.get("BM25:b", 0.75)))
    known = {"UnrankedBoolean": UnrankedBoolean, "RankedBoolean": RankedBoolean}
    if name not in known:
        raise ValueError(f"unknown retrieval model {name}")
    return known[name]()
