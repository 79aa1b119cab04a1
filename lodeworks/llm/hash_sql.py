"""XXH64 as a DuckDB expression: a hash is a program of five operations on 128-bit integers, run by list_reduce."""

from __future__ import annotations

MODULUS = 1 << 64
# The hash's five primes.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
P1, P2, P3, P4, P5 = (f"{p}::UHUGEINT" for p in PRIMES)
M = f"{MODULUS}::UHUGEINT"
#: What an operation does to the hash so far; its operand is in the low 64 bits, its code above.
_STEP = f"""lambda h, o: CASE o // {M} WHEN 0 THEN (h + o % {M}) % {M} WHEN 1 THEN xor(h, o % {M}) WHEN 2 THEN h * (o % {M}) % {M}
    WHEN 3 THEN h * (1::UHUGEINT << (o % {M})) % {M} + h // (1::UHUGEINT << (64::UHUGEINT - o % {M})) ELSE xor(h, h // (1::UHUGEINT << (o % {M}))) END"""


def _operation(code: int):
    return lambda operand: f"({code * MODULUS}::UHUGEINT + ({operand}))"


add, xor, times, turn, fold = map(_operation, range(5))


def run(start: str, *programs: str) -> str:
    return f"list_reduce(list_concat([{start}], {', '.join(programs)}), {_STEP})"


def _each(source: str, name: str, *operations: str) -> str:
    return f"flatten(list_transform({source}, lambda {name}: [{', '.join(operations)}]))"


def _mixed(lane: str) -> str:
    return run(lane, f"[{times(P2)}, {turn(31)}, {times(P1)}]")


def _little(at: str, size: int) -> str:
    """The little-endian number of ``size`` bytes from byte ``at`` of the hex string x."""
    digits = " || ".join(f"substr(x, 2 * ({at} + {size - 1 - i}) + 1, 2)" for i in range(size))
    return f"('0x' || {digits})::UBIGINT::UHUGEINT"


def xxh64(table: str, text: str, seed: int = 0) -> str:
    """CTEs that end in ``hashed(<text>, h)``: the unsigned hash of each value of ``table``'s column ``text``."""
    first = [(seed + PRIMES[0] + PRIMES[1]) % MODULUS, (seed + PRIMES[1]) % MODULUS, seed, (seed - PRIMES[0]) % MODULUS]
    columns = [
        run(f"{v}::UHUGEINT", _each("range(n // 32)", "i", add(f"lanes[4 * i + {k}] * {P2} % {M}"), turn(31), times(P1))) for k, v in enumerate(first, 1)
    ]
    turned = " + ".join(f"(v[{k}] * {1 << r}::UHUGEINT % {M} + v[{k}] // {1 << 64 - r}::UHUGEINT)" for k, r in enumerate((1, 7, 12, 18), 1))
    long = run(f"({turned}) % {M}", _each("v", "a", xor(_mixed("a")), times(P1), add(P4)))
    rest = run(
        "h",
        f"[{add('n::UHUGEINT')}]",
        _each("lanes[4 * (n // 32) + 1:]", "a", xor(_mixed("a")), turn(27), times(P1), add(P4)),
        f"CASE WHEN n % 8 >= 4 THEN [{xor(_little('8 * (n // 8)', 4) + f' * {P1} % {M}')}, {turn(23)}, {times(P2)}, {add(P3)}] ELSE [] END",
        _each("range(n // 4 * 4, n)", "i", xor(_little("i", 1) + f" * {P5} % {M}"), turn(11), times(P1)),
        f"[{fold(33)}, {times(P2)}, {fold(29)}, {times(P3)}, {fold(32)}]",
    )
    return f"""hash_bytes AS (
  SELECT {text}, x, length(x) // 2 AS n, list_transform(range(length(x) // 16), lambda i: {_little('8 * i', 8)}) AS lanes
  FROM (SELECT {text}, hex(encode({text})) AS x FROM (SELECT DISTINCT {text} FROM {table}))
), hash_columns AS (
  SELECT *, CASE WHEN n >= 32 THEN [{', '.join(columns)}] END AS v FROM hash_bytes
), hash_begun AS (
  SELECT *, CASE WHEN n < 32 THEN {(seed + PRIMES[4]) % MODULUS}::UHUGEINT ELSE {long} END AS h FROM hash_columns
), hashed AS (
  SELECT {text}, {rest}::UBIGINT AS h FROM hash_begun
)"""
