"""All queries of the site-profile engine by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import crawl, exports, faces, frontier, logos, messaging, names, palette, profile, quotes, roles, schema, sheets, themes, voice
from .plans import crawl_oracles, face_oracles, frontier_oracles, message_oracles, name_oracles, oracles, sheet_oracles, theme_oracles, voice_oracles
from .sources import fetched

_MODULES = (profile, palette, sheets, roles, crawl, frontier, fetched, quotes, names, faces, voice, logos, messaging, themes, schema, exports)
_PLANS = (oracles, sheet_oracles, crawl_oracles, face_oracles, voice_oracles, message_oracles, frontier_oracles, name_oracles, theme_oracles)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in _PLANS for name, sql in m.ORACLES.items()}
