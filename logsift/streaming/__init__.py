"""Structured Streaming."""

from logsift.streaming.incremental import BlockStream

__all__ = ["BlockStream"]
