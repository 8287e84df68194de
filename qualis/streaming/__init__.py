"""Structured Streaming forms of the row-local steps and metrics."""

from .stream import audit_stream, clean_stream, missing_by_window, open_windows

__all__ = ["audit_stream", "clean_stream", "missing_by_window", "open_windows"]
