"""Errors callers match on."""


class UnsupportedQueryError(ValueError):
    """The statement is outside the supported form."""
