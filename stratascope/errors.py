"""Typed refusals: a design that can't support an answer is refused with a reason."""


class Refused(ValueError):
    """The input or the design doesn't allow the operation."""
