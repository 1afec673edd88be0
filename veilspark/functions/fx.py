"""The column functions that the engine's expressions are built from: pyspark's own, or, inside :func:`as_sql`, builders of SQL text.

Every call of a pyspark function and every operator on a column is a few calls from Python to the JVM, and detection has tens of
thousands of them. As text, an expression is built in Python alone and parsed by Spark once. Both give the same
expression, so the modules that build them need not know which it is.
"""

from __future__ import annotations

import inspect
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import count

from pyspark.sql import Column, functions

_as_sql: ContextVar[bool] = ContextVar("as_sql", default=False)
_numbers = count()
#: Functions whose SQL name is another one.
NAMES = {"create_map": "map"}


@contextmanager
def as_sql() -> Iterator[None]:
    """Within, the functions of this module give SQL text; :func:`columns` makes columns of it."""
    token = _as_sql.set(True)
    try:
        yield
    finally:
        _as_sql.reset(token)


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + "'"
    if isinstance(value, float):
        return f"{value!r}D" if value >= 0 else f"(-{-value!r}D)"
    if isinstance(value, int):
        return str(value) if value >= 0 else f"({value})"
    raise TypeError(f"no literal for {type(value).__name__}")


def text_of(value: object) -> str:
    return value.sql if isinstance(value, Sql) else literal(value)


class Sql:
    """An expression as SQL text, with the operators and methods of a column that the engine uses."""

    def __init__(self, sql: str, name: str | None = None):
        self.sql, self.name = sql, name

    def _two(self, sign: str, other: object, turned: bool = False) -> Sql:
        a, b = text_of(self), text_of(other)
        return Sql(f"({b} {sign} {a})" if turned else f"({a} {sign} {b})")

    def __getitem__(self, key: object) -> Sql:
        return Sql(f"{self.sql}.`{key}`" if isinstance(key, str) else f"{self.sql}[{text_of(key)}]")

    def __invert__(self) -> Sql:
        return Sql(f"(NOT {self.sql})")

    def __neg__(self) -> Sql:
        return Sql(f"(- {self.sql})")

    def isNull(self) -> Sql:  # noqa: N802  the name of the column's method
        return Sql(f"({self.sql} IS NULL)")

    def isNotNull(self) -> Sql:  # noqa: N802
        return Sql(f"({self.sql} IS NOT NULL)")

    def isin(self, *values: object) -> Sql:
        return Sql(f"({self.sql} IN ({', '.join(map(text_of, values))}))")

    def between(self, low: object, high: object) -> Sql:
        return Sql(f"({self.sql} BETWEEN {text_of(low)} AND {text_of(high)})")

    def rlike(self, pattern: object) -> Sql:
        return Sql(f"regexp_like({self.sql}, {text_of(pattern)})")

    def startswith(self, other: object) -> Sql:
        return Sql(f"startswith({self.sql}, {text_of(other)})")

    def cast(self, kind: str) -> Sql:
        return Sql(f"CAST({self.sql} AS {kind})")

    def try_cast(self, kind: str) -> Sql:
        return Sql(f"TRY_CAST({self.sql} AS {kind})")

    def alias(self, name: str) -> Sql:
        return Sql(self.sql, name)


def _operator(sign: str, turned: bool = False):
    return lambda self, other: self._two(sign, other, turned)


for _name, _sign in {"add": "+", "sub": "-", "mul": "*", "truediv": "/", "mod": "%", "and": "AND", "or": "OR"}.items():
    setattr(Sql, f"__{_name}__", _operator(_sign))
    setattr(Sql, f"__r{_name}__", _operator(_sign, True))
for _name, _sign in {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    setattr(Sql, f"__{_name}__", _operator(_sign))


class Case(Sql):
    """CASE WHEN ..., which goes on with when() and ends with otherwise()."""

    def __init__(self, parts: tuple[str, ...]):
        super().__init__(f"CASE {' '.join(parts)} END")
        self.parts = parts

    def when(self, condition: Sql, value: object) -> Case:
        return Case((*self.parts, f"WHEN {text_of(condition)} THEN {text_of(value)}"))

    def otherwise(self, value: object) -> Sql:
        return Sql(f"CASE {' '.join(self.parts)} ELSE {text_of(value)} END")


def _argument(value: object) -> str:
    """An argument of a function: a Python function becomes a lambda with variables of its own."""
    if not callable(value):
        return text_of(value)
    names = [f"v{next(_numbers)}" for _ in inspect.signature(value).parameters]
    head = names[0] if len(names) == 1 else f"({', '.join(names)})"
    return f"{head} -> {text_of(value(*map(Sql, names)))}"


def _struct(*fields: Sql) -> Sql:
    return Sql("named_struct(" + ", ".join(f"{literal(f.name or f'col{i}')}, {f.sql}" for i, f in enumerate(fields)) + ")")


SPECIAL = {
    "lit": lambda value: value if isinstance(value, Sql) else Sql(literal(value)),
    "col": lambda name: Sql(f"`{name}`"),
    "when": lambda condition, value: Case(()).when(condition, value),
    "struct": _struct,
    "call_function": lambda name, *arguments: Sql(f"{name}({', '.join(map(text_of, arguments))})"),
}


def __getattr__(name: str):
    if name.startswith("__"):
        raise AttributeError(name)
    if not _as_sql.get():
        return getattr(functions, name)
    return SPECIAL.get(name) or (lambda *arguments: Sql(f"{NAMES.get(name, name)}({', '.join(map(_argument, arguments))})"))


def column(value: Sql | Column) -> Column:
    return functions.expr(value.sql) if isinstance(value, Sql) else value
