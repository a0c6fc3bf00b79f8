"""Document intelligence over whole corpora and whole query sets, on Spark."""

from docloom.session import build_session

__all__ = ["build_session"]
