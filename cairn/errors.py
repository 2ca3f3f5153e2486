"""Errors the engine raises."""


class CairnError(Exception):
    """Base of all."""


class CollectionNotFound(CairnError):
    pass


class IndexNotFound(CairnError):
    pass


class InvalidDocument(CairnError):
    """Not a JSON object, or an ``_id`` that isn't a string."""


class UniqueConstraintViolation(CairnError):
    """``rows`` holds (id, field, value) of what was turned away."""

    def __init__(self, message: str, rows: list[tuple] | None = None):
        super().__init__(message)
        self.rows = rows or []


class VersionMismatch(CairnError):
    pass


class TransactionClosed(CairnError):
    pass


class CorruptFile(CairnError):
    pass


class CommitConflict(CairnError):
    """Another writer published the next manifest first."""


class KeyTooLong(CairnError):
    """A key past what the length field of a file format holds."""
