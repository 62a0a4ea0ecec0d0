"""Errors by the phase that raises them."""


class SqlError(Exception):
    """Any error of the dialect."""


class TokenizeError(SqlError):
    pass


class ParseError(SqlError):
    pass


class ExecutionError(SqlError):
    pass


class DeadlockError(ExecutionError):
    pass


class ConflictError(ExecutionError):
    """Another process changed the same table in between."""


class VersionTaken(ConflictError):
    """Another process published a manifest of this number."""
