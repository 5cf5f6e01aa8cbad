"""All queries of the library with their SQL, collected from the modules under plans/."""

from __future__ import annotations

from docweave.plans import MODULES


def queries():
    return {name: run for module in MODULES for name, (run, _) in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
