"""Spark-native analytics over large review corpora."""

from spindrift.session import build_session

__all__ = ["build_session"]
