"""Graph plugins: named transforms of a dictionary of tables."""

from __future__ import annotations

import importlib
import logging
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]
Plugin = Callable[[Tables], Tables]
_plugins: dict[str, Plugin] = {}


def register(name: str) -> Callable[[Plugin], Plugin]:
    def add(f: Plugin) -> Plugin:
        _plugins[name] = f
        return f

    return add


def get_plugin(name: str) -> Plugin:
    if name not in _plugins:
        raise KeyError(f"no plugin {name}; there are: {', '.join(sorted(_plugins))}")
    return _plugins[name]


def all_plugins() -> dict[str, Plugin]:
    return dict(_plugins)


def discover(package: str) -> list[str]:
    """Import every module of a package so that its plugins register; one that can't be imported is logged and left out."""
    home = importlib.import_module(package)
    failed = []
    for m in pkgutil.iter_modules(home.__path__):
        try:
            importlib.import_module(f"{package}.{m.name}")
        except Exception as e:  # a broken plugin must not take the others down
            logging.getLogger(__name__).warning("plugin module %s was left out: %s", m.name, e)
            failed.append(m.name)
    return failed


@register("topics")
def topics(tables: Tables) -> Tables:
    """Entities with ``community_id`` as a string; it leaves graphs of fewer than 3 entities alone."""
    from lexigrid.operators.communities import communities, local_numbers

    nodes = tables["entities"]
    if nodes.limit(3).count() < 3:
        return tables
    assigned = tables["assigned"] if "assigned" in tables else communities(tables["edges"])
    ids = local_numbers(assigned).select(F.col("node").alias("entity_id"), F.col("community_id").cast("string").alias("community_id"))
    return tables | {"entities": nodes.drop("community_id").join(ids, "entity_id", "left")}
