"""Hybrid retrieval over source trees, commits, conversations and corpora, as Spark DataFrames."""

from lodeseam.config import Settings, load
from lodeseam.errors import ChunkError, ConfigError, EmbedError, EngineError, IndexingError, RerankError, StoreError

__all__ = ["ChunkError", "ConfigError", "EmbedError", "EngineError", "IndexingError", "RerankError", "Settings", "StoreError", "load"]
