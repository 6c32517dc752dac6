"""What a store raises. Each kind is a class, and code is its name for callers that branch on text."""

from __future__ import annotations


class StoreError(Exception):
    code = "StoreError"

    def __init_subclass__(cls) -> None:
        cls.code = cls.__name__

    def __init__(self, message: str = ""):
        super().__init__(f"{self.code}: {message}" if message else self.code)
        self.message = message


class InvalidArgument(StoreError):
    """The caller asked for what can't be: an unknown family, a folder that is taken, a transaction that has ended."""


class NotFound(StoreError):
    """A store, family, backup or file that must be there isn't; a key that isn't there is None, not an error."""


class Busy(StoreError):
    """Another writer or a lock stood in the way; the same call may succeed later."""


class Stalled(Busy):
    """Level 0 stayed full for as long as a write may wait."""


class Corruption(StoreError):
    """Stored bytes don't match their checksum, or commits are missing, or a file for ingest breaks its rules."""


class IOFailure(StoreError):
    """The file system refused an operation."""
