"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ("operators.aggregate", "functions.queries", "functions.flatten", "operators.detect", "operators.categories", "operators.relate", "operators.processes", "operators.journal", "operators.decode", "operators.layers", "operators.indicators", "operators.spans", "operators.findings", "operators.claims", "operators.packages", "operators.exported", "sources.io", "sources.normalize", "sources.jsonlines", "sources.headers", "sources.router", "sources.exports", "sources.memory", "sources.scripts")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"duskwatch.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
