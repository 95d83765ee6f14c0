"""Checksums of identifiers, as Python functions for kernels and as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(s: str) -> bool:
    if not s or not s.isascii() or not s.isdigit():
        return False
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(s))) % 10 == 0


def iban(s: str) -> bool:
    """ISO 13616: country and check digits to the end, letters as numbers from 10, remainder 1 by 97."""
    import re

    from veilspark.functions.patterns import IBAN_WHOLE

    v = "".join(s.split()).upper()
    return bool(re.match(IBAN_WHOLE, v)) and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _dihedral(a: int, b: int) -> int:
    """The product in the dihedral group of order 10, which Verhoeff's scheme is built on."""
    if a < 5:
        return (a + b) % 5 + 5 * (b >= 5) if b < 5 else (a + b) % 5 + 5
    return (a - b) % 5 + 5 if b < 5 else (a - b) % 5


_TURN = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def verhoeff(s: str) -> bool:
    check = 0
    for place, d in enumerate(reversed(digits(s))):
        x = int(d)
        for _ in range(place % 8):
            x = _TURN[x]
        check = _dihedral(check, x)
    return check == 0


def turns() -> list[list[int]]:
    """By place modulo 8 what each digit counts as."""
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([_TURN[x] for x in rows[-1]])
    return rows


def verhoeff_column(value: Column, F=F) -> Column:
    """verhoeff() as a fold over characters. F: pyspark.sql.functions, or sqltext for expressions as text."""
    flat = lambda rows: F.array(*(F.lit(x) for row in rows for x in row))
    turn, product = flat(turns()), flat([[_dihedral(a, b) for b in range(10)] for a in range(10)])
    each = F.filter(F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), ""), lambda c: c != "")
    counted = F.transform(each, lambda c, i: F.get(turn, i % 8 * 10 + c.cast("int")))
    return F.aggregate(counted, F.lit(0), lambda check, x: F.get(product, check * 10 + x)) == 0


def luhn_column(value: Column, F=F) -> Column:
    digits_of = F.regexp_replace(value, "[^0-9]", "")
    return F.luhn_check(digits_of) if hasattr(F, "luhn_check") else F.call_function("luhn_check", digits_of)


def iban_column(value: Column, F=F) -> Column:
    """iban() as a fold over characters."""
    v = F.upper(F.regexp_replace(value, "\\s", ""))
    moved = F.concat(F.substr(v, F.lit(5)), F.substring(v, 1, 4))
    number = F.aggregate(F.split(moved, ""), F.lit(0), lambda r, c: F.when(c == "", r).when(c.between("0", "9"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97))
    return F.coalesce(v.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (number == 1), F.lit(False))
