"""assayer: a Spark-native engine for preparing and scoring retrieval-augmented question answering."""

from assayer.session import build_session

__all__ = ["build_session"]
