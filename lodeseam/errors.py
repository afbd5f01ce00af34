"""Errors by the part that raises them."""

from __future__ import annotations


class EngineError(Exception):
    """Any error of this library."""


class ConfigError(EngineError):
    pass


class EmbedError(EngineError):
    def __init__(self, message: str, retryable: bool = False):
        super().__init__(message)
        self.retryable = retryable


class StoreError(EngineError):
    def __init__(self, message: str, status: int | None = None, missing: bool = False):
        super().__init__(message)
        self.status, self.missing = status, missing


class RerankError(EngineError):
    pass


class ChunkError(EngineError):
    def __init__(self, message: str, path: str):
        super().__init__(message)
        self.path = path


class IndexingError(EngineError):
    pass
