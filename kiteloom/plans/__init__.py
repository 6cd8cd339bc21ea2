"""Queries: operators bound to the test tables, each with its oracle SQL."""


def FAMILIES():
    """The query families of this package, imported late so that an operator can be used alone."""
    import importlib
    import pkgutil

    names = sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.endswith("_queries"))
    return [importlib.import_module(f"{__name__}.{n}").FAMILY for n in names]
