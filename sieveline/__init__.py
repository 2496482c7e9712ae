"""Sieveline: Spark jobs that screen large document collections.

Every operator takes DataFrames and returns DataFrames. Model outputs (the split of a document into
fields, the scoring runs, the brief) are read as tables; the engine recommends and never decides.
"""

from sieveline.session import build_session

__all__ = ["build_session"]
