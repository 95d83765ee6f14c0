"""Column expressions as SQL text, with the names and operators of pyspark.sql.functions.

A Column costs calls into the JVM for each of its parts; an expression of thousands of parts is built much faster as text
and parsed once, by expr(). Functions of any name are taken as they are, lambdas get variables of their own."""

from __future__ import annotations

import inspect
import itertools

_number = itertools.count()


def sql_of(x) -> str:
    if isinstance(x, X):
        return x.sql
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, float):
        return f"{x!r}D"
    if isinstance(x, int):
        return str(x) if x >= 0 else f"({x})"
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _infix(sign: str):
    return lambda a, b: X(f"({sql_of(a)} {sign} {sql_of(b)})")


def _reversed(sign: str):
    return lambda a, b: X(f"({sql_of(b)} {sign} {sql_of(a)})")


class X:
    """A piece of SQL."""

    def __init__(self, sql: str, name: str | None = None):
        self.sql, self.name = sql, name

    def alias(self, name: str) -> X:
        return X(self.sql, name)

    def cast(self, kind: str) -> X:
        return X(f"cast({self.sql} as {kind})")

    def __getitem__(self, name: str) -> X:
        return X(f"{self.sql}.`{name}`")

    def __invert__(self) -> X:
        return X(f"(not {self.sql})")

    def __neg__(self) -> X:
        return X(f"(- {self.sql})")

    def rlike(self, pattern: str) -> X:
        return X(f"({self.sql} rlike {sql_of(pattern)})")

    def contains(self, part) -> X:
        return X(f"contains({self.sql}, {sql_of(part)})")

    def endswith(self, part) -> X:
        return X(f"endswith({self.sql}, {sql_of(part)})")

    def isin(self, *values) -> X:
        return X(f"({self.sql} in ({', '.join(map(sql_of, values))}))")

    def between(self, low, high) -> X:
        return X(f"({self.sql} between {sql_of(low)} and {sql_of(high)})")

    def isNotNull(self) -> X:  # noqa: N802
        return X(f"({self.sql} is not null)")

    __add__, __sub__, __mul__, __truediv__, __mod__ = (_infix(s) for s in "+-*/%")
    __radd__, __rsub__, __rmul__ = (_reversed(s) for s in "+-*")
    __eq__, __ne__, __lt__, __le__, __gt__, __ge__ = (_infix(s) for s in ("=", "!=", "<", "<=", ">", ">="))
    __and__, __or__ = _infix("and"), _infix("or")
    __hash__ = None


class When(X):
    """A case under construction."""

    def __init__(self, cases: str):
        super().__init__(f"case {cases} end")
        self.cases = cases

    def when(self, condition: X, value) -> When:
        return When(f"{self.cases} when {condition.sql} then {sql_of(value)}")

    def otherwise(self, value) -> X:
        return X(f"case {self.cases} else {sql_of(value)} end")


def when(condition: X, value) -> When:
    return When(f"when {condition.sql} then {sql_of(value)}")


def lit(x) -> X:
    return x if isinstance(x, X) else X(sql_of(x))


def col(name: str) -> X:
    return X(f"`{name}`")


def struct(*fields: X) -> X:
    return X("named_struct(" + ", ".join(f"'{f.name}', {f.sql}" for f in fields) + ")")


def _argument(x) -> str:
    if not callable(x) or isinstance(x, X):
        return sql_of(x)
    own = [f"v{next(_number)}" for _ in inspect.signature(x).parameters]
    return f"{own[0] if len(own) == 1 else '(' + ', '.join(own) + ')'} -> {sql_of(x(*(X(v) for v in own)))}"


def __getattr__(name: str):
    if name.startswith("_"):
        raise AttributeError(name)
    return lambda *args: X(f"{name}({', '.join(map(_argument, args))})")
