"""Registry of user-level queries and their SQL oracles.

Every key maps to ``fn(spark, sf_dir) -> DataFrame``; keys with an oracle also
carry an ANSI SQL text that the oracle engine runs on the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    import skein.plans.align_queries  # noqa: F401
    import skein.plans.catalog_queries  # noqa: F401
    import skein.plans.dialog_queries  # noqa: F401
    import skein.plans.generate_queries  # noqa: F401
    import skein.plans.lint_queries  # noqa: F401
    import skein.plans.querylog_queries  # noqa: F401
    import skein.plans.querytext_queries  # noqa: F401
    import skein.plans.rebuild_queries  # noqa: F401
    import skein.plans.relational_queries  # noqa: F401
    import skein.plans.report_queries  # noqa: F401
    import skein.plans.select_queries  # noqa: F401
    import skein.plans.source_queries  # noqa: F401
    import skein.plans.streaming_queries  # noqa: F401
    import skein.plans.text_queries  # noqa: F401
