"""Errors raised while a step is configured or bound to a table, never by bad data."""


class TributaryError(Exception):
    """Base of all errors of this package."""


class ColumnMappingNotSupported(TributaryError):
    """A mapping row is malformed or names an unknown target."""


class MapperParameterNotSupported(TributaryError, TypeError):
    """A mapper option has the wrong kind."""


class DataTypeValidationFailed(TributaryError):
    """Declared and found types differ; the message lists all columns."""


class ColumnNotFound(TributaryError):
    """A column to be annotated does not exist."""


class SpecificationError(TributaryError, ValueError):
    """A pipeline description cannot be turned into components."""
