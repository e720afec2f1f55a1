"""Spark operators for turning noisy web and message data into scored, searchable tables."""

from clearwake.session import build_session, configure

__all__ = ["build_session", "configure"]
