"""newsgraph: a PySpark engine that turns news articles into a causal knowledge graph.

Every stage is a DataFrame -> DataFrame function (see ``newsgraph.operators``);
the same functions run on a batch or on each micro-batch of a stream.
"""

from newsgraph.config import Config

__all__ = ["Config"]
