"""Importing this module registers every query."""

from registry import logs, records, series, streams, web  # noqa: F401
