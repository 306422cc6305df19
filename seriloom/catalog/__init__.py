"""Named queries over the test tables, each with its SQL counterpart."""

import importlib

CHAPTERS = ["ingest", "series", "covariates", "training", "forecast", "scoring", "compare", "views"]


def load():
    """Import every chapter once and return the filled registry."""
    for name in CHAPTERS:
        importlib.import_module(f"seriloom.catalog.{name}")
    return importlib.import_module("seriloom.catalog.registry")
