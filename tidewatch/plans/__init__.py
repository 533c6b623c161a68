"""Whole rounds, reader screens, and the operators bound to the given tables."""

from importlib import import_module

BINDINGS = ["bind_pages", "bind_events", "bind_records", "bind_texts", "bind_orgs", "bind_rounds"]


def load_queries() -> None:
    """Import every binding once; importing registers its queries."""
    for name in BINDINGS:
        import_module(f"tidewatch.plans.{name}")
