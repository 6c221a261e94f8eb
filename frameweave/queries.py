"""Registered queries over the bridge tables, with the SQL that each must match."""

from __future__ import annotations

from .catalog import extra, files, filters, media, palettes, pixels, space, streams, time

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (pixels, space, palettes, time, files, media, extra, filters, streams):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
