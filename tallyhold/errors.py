"""Typed errors of the inventory."""


class InventoryError(Exception):
    """The base of all."""


class ConfigError(InventoryError):
    """A configuration that can't be used."""


class ScanError(InventoryError):
    """A root that can't be scanned."""


class ChainError(InventoryError):
    """A segment of a log that doesn't verify; ``kind`` is one of ``operators.chain.PRECEDENCE``."""

    def __init__(self, kind: str, machine: str = "", seq: int | None = None):
        super().__init__(f"{kind} in the log of {machine or '?'}" + ("" if seq is None else f" at {seq}"))
        self.kind, self.machine, self.seq = kind, machine, seq


class NotFoundError(InventoryError):
    """An object, content or path that the store or the index doesn't have."""


class IntegrityError(InventoryError):
    """Stored bytes that don't have the hash, length or tag that they should have."""


class UnsupportedVersionError(InventoryError):
    """A manifest of a version other than 1."""


class SegmentOwnerError(InventoryError):
    """A segment pushed under another machine's name."""
