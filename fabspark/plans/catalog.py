"""Loads every module of registered queries."""

from __future__ import annotations

import importlib

from . import registry

MODULES = ["tables", "spc", "quality", "windows", "outliers", "hypothesis", "metrics", "wafer", "text", "streams", "models"]


def load():
    for m in MODULES:
        importlib.import_module(f"fabspark.plans.{m}")
    return registry
