"""Errors of the query language."""


class QueryError(ValueError):
    """A query that cannot be run; the message names the offending text."""


class ConfigError(RuntimeError):
    """A limit that the server's environment sets wrongly."""
