"""One registered query per operator; importing this package fills the registry."""
from importlib import import_module

MODULES = (
    "scans", "relational", "audits", "leaks", "screens", "history", "models", "scores", "intervals", "decisions",
    "trials", "watch", "reasons", "measures", "texts", "streams",
)


def load():
    for name in MODULES:
        import_module(f"firmground.plans.{name}")
    from firmground.plans.registry import QUERIES, SQL

    return QUERIES, SQL
