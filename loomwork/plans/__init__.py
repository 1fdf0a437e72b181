"""Views of the driver tables and the registered queries."""

from importlib import import_module
from pkgutil import iter_modules


def load_all() -> None:
    """Import every module here; each registers its queries with the catalogue."""
    for module in iter_modules(__path__):
        import_module(f"{__name__}.{module.name}")
