"""What the engine raises where a request cannot be met."""

from __future__ import annotations


class BadRequest(ValueError):
    """What was asked for is incomplete or unknown."""


class NotFound(LookupError):
    """What was asked for by name or id is not there."""
