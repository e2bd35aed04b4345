"""Named queries over the bound tables, each with the SQL that must give the same rows."""

from importlib import import_module

MODULES = ("functions", "budget", "procurement", "calendars", "matches", "texts", "storage", "findings")


def load() -> None:
    """Import every module of queries, which registers them."""
    for name in MODULES:
        import_module(f"publedger.plans.{name}")
