"""The two SQL dialects that the rules' queries are written for: the engine's and the oracle's."""

from __future__ import annotations

import re


#: Greater numbers in a file count as this one, far beyond any sequence, so that no sum of them leaves 64 bits.
MOST = 10**15


class Spark:
    name = "spark"

    def rx(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE r'{pattern}')"

    def first_match(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, r'{pattern}', {group})"

    def number(self, digits: str) -> str:
        """A string of digits as a number; ``MOST`` if it is greater than that."""
        bare = f"trim(LEADING '0' FROM {digits})"
        return f"CASE WHEN length({bare}) > {len(str(MOST)) - 1} THEN CAST({MOST} AS BIGINT) WHEN {bare} = '' THEN CAST(0 AS BIGINT) ELSE TRY_CAST({bare} AS BIGINT) END"

    def greater(self, a: str, b: str) -> str:
        """Whether a string of digits is a greater number than another, however long they are."""
        a, b = (f"trim(LEADING '0' FROM {x})" for x in (a, b))
        return f"(length({a}) > length({b}) OR (length({a}) = length({b}) AND {a} > {b}))"

    def gap_total(self, x: str, code: str) -> str:
        return f"aggregate(transform(regexp_extract_all({x}, r'{code}([0-9]+)', 1), v -> {self.number('v')}), CAST(0 AS DECIMAL(38, 0)), (a, v) -> CAST(a + v AS DECIMAL(38, 0)))"

    def triple(self, x: str, y: str, z: str) -> str:
        return f"named_struct('x', {x}, 'y', {y}, 'z', {z})"

    def starts(self, x: str, y: str) -> str:
        return f"startswith({x}, {y})"

    def least_by(self, x: str, *order: str) -> str:
        return f"min_by({x}, struct({', '.join(order)}))"

    def most_by(self, x: str, *order: str) -> str:
        return f"max_by({x}, struct({', '.join(order)}))"

    def chr(self, n: int) -> str:
        return f"char({n})"

    def mod(self, a: str, b: str) -> str:
        return f"pmod({a}, {b})"

    def small(self, name: str) -> str:
        """Leads the columns of a SELECT: the joined ``name`` is bounded, so rows that meet it are not shuffled."""
        return f"/*+ BROADCAST({name}) */ "

    def met(self, also: str = "TRUE") -> str:
        """References ``r`` with the first line ``f`` of the id that each one names, if it is defined; they met once for all rules."""
        return f"(SELECT r.* FROM @linked r WHERE f IS NOT NULL AND {also}) r"

    def sought(self) -> str:
        """All references ``r``; ``f`` is null where the id is not defined."""
        return "@linked r"

    def below(self, n: str) -> str:
        """A row for each number from 0 to below ``n``, which is above 0."""
        return f"explode(sequence(CAST(0 AS BIGINT), CAST({n} AS BIGINT) - 1))"


def _functional(sql: str) -> str:
    return re.sub(r"trim\(LEADING '0' FROM ([^()]+(?:\([^()]*\))?)\)", r"ltrim(\1, '0')", sql)


class Duck(Spark):
    name = "duck"

    def number(self, digits: str) -> str:
        return _functional(super().number(digits))

    def greater(self, a: str, b: str) -> str:
        return _functional(super().greater(a, b))

    def rx(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def first_match(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, '{pattern}', {group})"

    def gap_total(self, x: str, code: str) -> str:
        return f"CAST(coalesce(list_sum(list_transform(regexp_extract_all({x}, '{code}([0-9]+)', 1), lambda v: {self.number('v')})), 0) AS HUGEINT)"

    def triple(self, x: str, y: str, z: str) -> str:
        return f"{{'x': {x}, 'y': {y}, 'z': {z}}}"

    def starts(self, x: str, y: str) -> str:
        return f"starts_with({x}, {y})"

    def least_by(self, x: str, *order: str) -> str:
        return f"arg_min({x}, row({', '.join(order)}))"

    def most_by(self, x: str, *order: str) -> str:
        return f"arg_max({x}, row({', '.join(order)}))"

    def chr(self, n: int) -> str:
        return f"chr({n})"

    def mod(self, a: str, b: str) -> str:
        return f"((({a}) % ({b})) + ({b})) % ({b})"

    def small(self, name: str) -> str:
        return ""

    def met(self, also: str = "") -> str:
        return "@ref r JOIN @first f ON f.file = r.file AND f.id = r.target" + (f" AND {also}" if also else "")

    def sought(self) -> str:
        return "@ref r LEFT JOIN @first f ON f.file = r.file AND f.id = r.target"

    def below(self, n: str) -> str:
        return f"unnest(range(CAST({n} AS BIGINT)))"
