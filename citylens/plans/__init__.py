"""The case-study analyses as named query plans over the test views.

``registry()`` maps a query name to ``fn(spark, sf_dir) -> DataFrame``.
"""

from __future__ import annotations


def registry():
    from citylens.plans import ingest, parking, sql, stream, taxi, upkeep

    out = {}
    for mod in (taxi, parking, ingest, sql, stream, upkeep):
        for name, fn in mod.QUERIES.items():
            if name in out:
                raise ValueError(f"duplicate query {name}")
            out[name] = fn
    return out
