"""Exceptions, raised when a plan is built wherever the schema allows it."""


class FieldSelectionError(Exception):
    """A field that the table does not have."""


class DuplicateKeyError(Exception):
    """A key that a strict lookup found more than once."""


class ArgumentError(Exception):
    """Arguments that do not go together."""


class TransformError(Exception):
    """A value that a transformation could not handle."""


class OrderRequired(Exception):
    """An order-dependent operator over a table whose rows have no declared order."""


class Unavailable(Exception):
    """A format whose third-party library is not installed."""
