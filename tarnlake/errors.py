"""Errors that callers can tell apart."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors of this package."""


class DialectError(EngineError):
    """A statement that can't be read; position counts characters."""

    def __init__(self, message: str, position: int) -> None:
        super().__init__(f"{message} at position {position}")
        self.position = position


class QueryError(EngineError):
    """A statement that can't be run."""

    def __init__(self, message: str, sql: str | None = None) -> None:
        super().__init__(message)
        self.sql = sql


class ConflictError(EngineError):
    """Another writer has published a change of the same tables."""


class AuthError(EngineError):
    """The service refuses the key."""


class ServiceConnectionError(EngineError):
    """The service can't be reached."""
