"""Column builders shared by the operators. All stay inside generated JVM code.

Expressions are written as SQL text: one call to the JVM per expression, where
building it from ``Column`` objects takes one call per node.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_CODES = "cast(array() as array<string>)"


def with_expr(df: DataFrame, **columns: str) -> DataFrame:
    """Add or replace columns given as SQL text."""
    return df.withColumns({name: F.expr(text) for name, text in columns.items()})


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def one_of(column: str, values: Iterable[str]) -> str:
    return f"{column} IN ({', '.join(quoted(v) for v in values)})"


def codes(pairs: Iterable[tuple[str, str]]) -> str:
    """Array of the codes whose condition holds, in the order given.

    Each code is a constant one-element array that ``concat`` joins, so the
    expression compiles without a lambda. A NULL condition adds nothing.
    """
    parts = [f"CASE WHEN {cond} THEN array({quoted(code)}) ELSE {NO_CODES} END" for cond, code in pairs]
    return f"concat({', '.join(parts)})"


def signal_codes(signals: Sequence[tuple[str, int, int, str]]) -> str:
    """Reason codes of a signal table (count column, points, smallest count, code)."""
    return codes((f"{name} >= {least}", code) for name, _, least, code in signals)


def weighted_score(signals: Sequence[tuple[str, int, int, str]], cap: int) -> str:
    """Points of a signal table, capped. The counts must not be NULL: ``least`` skips NULLs."""
    return f"least({cap}, {' + '.join(f'{name} * {weight}' for name, weight, _, _ in signals)})"


def _literal(value) -> str:
    return quoted(value) if isinstance(value, str) else "NULL" if value is None else repr(value)


def band_from(value: str, bands: Sequence[tuple], pick: int, otherwise=None) -> str:
    """Member ``pick`` of the first band whose lower bound ``value`` reaches (bands fall)."""
    cases = " ".join(f"WHEN {value} >= {b[0]} THEN {_literal(b[pick])}" for b in bands)
    return f"CASE {cases} ELSE {_literal(otherwise)} END"


def band_upto(value: str, bands: Sequence[tuple], pick: int) -> str:
    """Member ``pick`` of the first band whose upper bound holds ``value`` (bands rise).

    Bounds are doubles like the value, so a value equal to a bound meets it exactly.
    """
    cases = " ".join(f"WHEN {value} <= {float(b[0])}D THEN {_literal(b[pick])}" for b in bands)
    return f"CASE {cases} END"


def hashed_id(*parts: str) -> str:
    """Stable id: SHA-256 of the parts joined with '|'. Constants are passed quoted."""
    return f"sha2(concat_ws('|', {', '.join(parts)}), 256)"


def token(prefix: str, namespace: str, column: str) -> str:
    """Pseudonym: prefix and the first 16 hex digits of the namespaced hash."""
    return f"concat({quoted(prefix)}, substring({hashed_id(quoted(namespace), column)}, 1, 16))"


def padded_id(prefix: str, number: str, width: int) -> str:
    return f"format_string({quoted(f'{prefix}%0{width}d')}, {number})"


def cycle(values: Sequence[str], position: str) -> str:
    """Pick from ``values`` in turn by a running number."""
    listed = ", ".join(quoted(v) for v in values)
    return f"element_at(array({listed}), cast(pmod({position}, {len(values)}) + 1 as int))"


def clean_upper(column: str) -> str:
    return f"upper(trim({column}))"


def as_column(text: str, name: str) -> Column:
    return F.expr(f"{text} AS `{name}`")
