"""Errors raised while a plan is built."""

from __future__ import annotations


class GraphError(Exception):
    """Base of all plan-time errors."""


class BadTypeValu(GraphError):
    """A literal doesn't fit its type."""


class NoSuchForm(GraphError):
    pass


class NoSuchProp(GraphError):
    pass


class NoSuchCmpr(GraphError):
    """The type has no such comparator."""


class NoSuchPivot(GraphError):
    """No reference leads from one form to the other."""


class BadSyntax(GraphError):
    pass


class BadArg(GraphError):
    pass
