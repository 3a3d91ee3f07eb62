"""Named queries over the given tables, each with the SQL that says what it must return."""

from importlib import import_module

GROUPS = ("scalars", "labeling", "echo", "monitors", "recovery", "documents", "evaluation", "requests", "streams")


def load():
    for group in GROUPS:
        import_module(f"{__name__}.{group}")
    return import_module(f"{__name__}.base")
