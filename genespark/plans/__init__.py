"""Named queries over the driver tables, each with its oracle."""

import importlib
import pkgutil


def load():
    """Import every query module once and return the registry."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return importlib.import_module(f"{__name__}.registry")
