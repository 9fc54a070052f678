"""Registered queries (one per operator group) and their DuckDB oracles."""


def load_all() -> None:
    """Import every query module so it registers itself."""
    from meshframes.plans import (  # noqa: F401
        catalog_queries,
        frame_queries,
        health_queries,
        queries,
        stream_queries,
        telemetry_queries,
    )
