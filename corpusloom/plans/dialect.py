"""The same array expression in Spark SQL and in DuckDB SQL."""

from __future__ import annotations


class Spark:
    name = "spark"
    long, string = "BIGINT", "STRING"

    def map(self, x: str, var: str, body: str) -> str:
        return f"transform({x}, {var} -> {body})"

    def map2(self, a: str, b: str, body: str) -> str:
        """``body`` over x of ``a`` and y of ``b``, of one length."""
        return f"zip_with({a}, {b}, (x, y) -> {body})"

    def mapi(self, a: str, body: str) -> str:
        """``body`` over x and its place i, from 0."""
        return f"transform({a}, (x, i) -> {body})"

    def sum(self, x: str) -> str:
        return f"aggregate({x}, 0D, (s, v) -> s + v)"

    def seq(self, n: int) -> str:
        return f"sequence(0, {n - 1})"

    def at(self, x: str, i: str) -> str:
        """The value at place ``i``, from 0."""
        return f"get({x}, {i})"

    def cut(self, x: str, start: str, n: str) -> str:
        return f"slice({x}, {start}, {n})"

    def filter(self, x: str, var: str, body: str) -> str:
        return f"filter({x}, {var} -> {body})"

    def rows(self, source: str, x: str, keep: str) -> str:
        return f"SELECT {keep}, CAST(pos AS INT) AS pos, v FROM {source} LATERAL VIEW posexplode({x}) AS pos, v"

    def max(self, x: str) -> str:
        return f"array_max({x})"

    def sort(self, x: str) -> str:
        return f"sort_array({x})"

    def size(self, x: str) -> str:
        return f"size({x})"

    def has(self, x: str, v: str) -> str:
        return f"array_contains({x}, {v})"

    def find(self, x: str, v: str) -> str:
        """The place of the first ``v``, from 0."""
        return f"CAST(array_position({x}, {v}) - 1 AS INT)"

    def array(self, *x: str) -> str:
        return f"array({', '.join(x)})"

    def concat(self, *x: str) -> str:
        return f"concat({', '.join(x)})"

    def hold(self, x: str) -> str:
        """``x``, worked out once for a row: inlined into a lambda, it would be for every value.

        The test is always true; as it isn't deterministic, the optimizer leaves it where it stands.
        """
        return f"if(monotonically_increasing_id() >= 0, {x}, NULL)"


class Duck(Spark):
    name = "duckdb"
    long, string = "BIGINT", "VARCHAR"

    def map(self, x: str, var: str, body: str) -> str:
        return f"list_transform({x}, lambda {var}: {body})"

    def map2(self, a: str, b: str, body: str) -> str:
        return f"list_transform(list_zip({a}, {b}), lambda z: list_transform([z], lambda z: {self._named(body)})[1])"

    @staticmethod
    def _named(body: str) -> str:
        import re

        return re.sub(r"\bx\b", "z[1]", re.sub(r"\by\b", "z[2]", body))

    def mapi(self, a: str, body: str) -> str:
        import re

        return f"list_transform({a}, lambda x, i1: {re.sub(r'\bi\b', '(i1 - 1)', body)})"

    def sum(self, x: str) -> str:
        return f"coalesce(list_sum({x}), 0.0)"

    def seq(self, n: int) -> str:
        return f"range(0, {n})"

    def at(self, x: str, i: str) -> str:
        return f"({x})[CAST({i} AS INT) + 1]"

    def cut(self, x: str, start: str, n: str) -> str:
        return f"list_slice({x}, {start}, {start} + {n} - 1)"

    def filter(self, x: str, var: str, body: str) -> str:
        return f"list_filter({x}, lambda {var}: {body})"

    def rows(self, source: str, x: str, keep: str) -> str:
        names = ", ".join(f"_s.{k.strip()}" for k in keep.split(","))
        return f"SELECT {names}, CAST(_p.pos AS INT) AS pos, (_s.{x})[_p.pos + 1] AS v FROM {source} _s, (SELECT unnest(range(0, 100000)) AS pos) _p WHERE _p.pos < len(_s.{x})"

    def max(self, x: str) -> str:
        return f"list_max({x})"

    def sort(self, x: str) -> str:
        return f"list_sort({x})"

    def size(self, x: str) -> str:
        return f"len({x})"

    def has(self, x: str, v: str) -> str:
        return f"list_contains({x}, {v})"

    def find(self, x: str, v: str) -> str:
        return f"CAST(list_position({x}, {v}) - 1 AS INT)"

    def array(self, *x: str) -> str:
        return f"[{', '.join(x)}]"

    def concat(self, *x: str) -> str:
        return f"list_concat({', '.join(x)})" if len(x) == 2 else f"list_concat({x[0]}, {self.concat(*x[1:])})"

    def hold(self, x: str) -> str:
        return x
