"""Boolean tag predicates built in Python and turned into Columns.

>>> T("safe") & ~any_of(T("cold"), T("red"))

An empty group puts no restriction on the search, whatever surrounds it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column


class TagExpr:
    def __and__(self, other: "TagExpr") -> "TagExpr":
        return _Group.of("and", (self, other))

    def __or__(self, other: "TagExpr") -> "TagExpr":
        return _Group.of("or", (self, other))

    def __invert__(self) -> "TagExpr":
        return self if isinstance(self, _Anything) else _Not(self)

    def names(self) -> set[str]:
        raise NotImplementedError

    def column(self, has: Callable[[str], Column]) -> Column:
        raise NotImplementedError

    def holds(self, present: set[str]) -> bool:
        raise NotImplementedError

    def admits_untagged(self) -> bool:
        """Can an item with none of the named tags satisfy the expression?"""
        return self.holds(set())


class _Anything(TagExpr):
    def names(self):
        return set()

    def holds(self, present):
        return True


@dataclass(frozen=True)
class T(TagExpr):
    """Carries the tag that this alias, taken literally, belongs to."""

    alias: str

    def names(self):
        return {self.alias}

    def column(self, has):
        return has(self.alias)

    def holds(self, present):
        return self.alias in present


@dataclass(frozen=True)
class _Not(TagExpr):
    inner: TagExpr

    def names(self):
        return self.inner.names()

    def column(self, has):
        return ~self.inner.column(has)

    def holds(self, present):
        return not self.inner.holds(present)


@dataclass(frozen=True)
class _Group(TagExpr):
    kind: str
    parts: tuple[TagExpr, ...]

    @staticmethod
    def of(kind: str, parts: tuple[TagExpr, ...]) -> TagExpr:
        kept = tuple(p for p in parts if not isinstance(p, _Anything))
        if not kept:
            return ANYTHING
        return kept[0] if len(kept) == 1 else _Group(kind, kept)

    def names(self):
        return set().union(*(p.names() for p in self.parts))

    def column(self, has):
        columns = [p.column(has) for p in self.parts]
        join = (lambda a, b: a & b) if self.kind == "and" else (lambda a, b: a | b)
        return reduce(join, columns)

    def holds(self, present):
        results = [p.holds(present) for p in self.parts]
        return all(results) if self.kind == "and" else any(results)


ANYTHING = _Anything()


def all_of(*parts: TagExpr) -> TagExpr:
    return _Group.of("and", parts)


def any_of(*parts: TagExpr) -> TagExpr:
    return _Group.of("or", parts)
