"""Queries over the fixture tables, each with reference SQL where SQL can state it."""

from registry import facts, models  # noqa: F401
from registry.catalogue import REGISTRY  # noqa: F401
