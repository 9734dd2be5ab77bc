"""Errors that a client sees."""

from __future__ import annotations


class IllegalQuery(ValueError):
    """The query can't be answered as written (HTTP 400)."""


class ParseError(IllegalQuery):
    """The text is no query (HTTP 400)."""

    def __init__(self, at: tuple[int, int], message: str):
        super().__init__(f"Parse error at {at[0]}:{at[1]}: {message}")
        self.at = at


class ConfigError(ValueError):
    """A database configuration is wrong."""


class InputError(ValueError):
    """Input data or a definition file can't be taken in."""


class NotLoaded(RuntimeError):
    """No database is there yet (HTTP 503)."""


def require(condition: object, message: str, kind: type[Exception] = IllegalQuery) -> None:
    if not condition:
        raise kind(message)
