"""What can go wrong with a graph."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException


class GraphError(RuntimeError):
    pass


class ConflictError(GraphError):
    """Another writer committed first."""


class ConstraintViolation(GraphError):
    """Two nodes would share a value that is unique."""


class NodeHasRelationships(GraphError):
    """DELETE of a node that has relationships; DETACH DELETE takes them too."""


class ResultLimitError(GraphError):
    """A result has more rows than allowed."""


class ReadOnlyError(GraphError):
    """A write where only reads are allowed."""


class TransactionDone(GraphError):
    """Use of a transaction that has ended."""


class StreamQueryError(GraphError):
    """A STREAM query where a plain one is expected."""


class SchemaError(GraphError):
    """An index or constraint command that cannot be carried out."""


class WriteOutcomeUnknown(GraphError):
    """A commit that failed so late that it may have taken effect; read the latest version before trying again."""


class TransactionTooLarge(GraphError):
    """A transaction that changes more rows than its store allows."""


class IntegerOverflow(GraphError):
    """An integer result beyond 64 bits."""


class DivisionByZero(GraphError):
    """A division by zero."""


#: Conditions of Spark's errors that have an error of their own here.
CONDITIONS = {"ARITHMETIC_OVERFLOW": IntegerOverflow, "BINARY_ARITHMETIC_OVERFLOW": IntegerOverflow, "CAST_OVERFLOW": IntegerOverflow, "DIVIDE_BY_ZERO": DivisionByZero, "REMAINDER_BY_ZERO": DivisionByZero}


def translated(e: BaseException) -> BaseException:
    """The error of this list that an error of a running query stands for, or the error itself.

    Results are lazy: what goes wrong with a value is raised by the action that
    computes it.  `with errors.kinds(): df.collect()` raises the kinds above.
    """
    condition = getattr(e, "getCondition", lambda: None)() or ""
    found = next((k for c, k in CONDITIONS.items() if condition == c or condition.startswith(c + ".")), None)
    if found is None and "ARITHMETIC_OVERFLOW]" in str(e):
        found = IntegerOverflow
    return found(str(e)) if found else e


@contextmanager
def kinds() -> Iterator[None]:
    """Raise errors of running queries as the kinds of this list."""
    try:
        yield
    except PySparkException as e:
        other = translated(e)
        if other is e:
            raise
        raise other from e
