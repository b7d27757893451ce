"""Everything the engine can refuse, by kind."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors of the engine."""


class SqlSyntaxError(EngineError):
    """A statement that the grammar does not have; ``pos`` is a 0-based offset in ``source``."""

    def __init__(self, message: str, pos: int, source: str):
        self.message, self.pos, self.source = message, pos, source
        start = source.rfind("\n", 0, pos) + 1
        stop = source.find("\n", pos)
        line = source[start : stop if stop >= 0 else len(source)]
        super().__init__(f"syntax error at {pos}: {message}\n{line}\n{' ' * (pos - start)}^")


class BindError(EngineError):
    """Names or types that don't fit the catalog."""


class NoTable(EngineError): ...


class NoIndex(EngineError): ...


class AlreadyExists(EngineError): ...


class BadRow(EngineError):
    """Wrong number of values, or a value of the wrong type."""


class NullInKey(EngineError): ...


class DuplicateKey(EngineError): ...


class NoRow(EngineError): ...


class Retryable(EngineError):
    """The transaction may succeed if run again."""


class Conflict(Retryable): ...


class Deadlock(Retryable): ...


class LockTimeout(Retryable): ...


class TransactionDone(EngineError): ...


class ReservedKey(EngineError): ...


class ChainFull(EngineError): ...
