"""feedloom: recommendation analytics as Spark DataFrame, SQL and streaming jobs."""

from .session import build_session, prepare_session

__all__ = ["build_session", "prepare_session"]
