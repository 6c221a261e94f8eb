"""The registered queries of this subpackage: each applies one operator to its whole table.

``QUERIES`` maps a name to ``(spark, sf_dir) -> DataFrame``; ``ORACLES`` has SQL where SQL can express the result.
"""

from __future__ import annotations

import importlib

MODULES = ["q01_mjpeg", "q02_nearjoin", "q03_sharding", "q04_toxicity", "q05_decontaminate", "q06_bpe", "q07_quality", "q08_urls", "q09_warc", "q10_lm"]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})
