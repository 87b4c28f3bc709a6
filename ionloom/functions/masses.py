"""Formula masses and ppm windows as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: monoisotopic masses of the seven elements the annotation formulas use
ELEMENT_MASS = {
    "H": 1.007825032,
    "C": 12.0,
    "O": 15.99491462,
    "N": 14.003074004,
    "P": 30.973761998,
    "F": 18.998403163,
    "S": 31.972071174,
}


def formula_mass(formula: Column) -> Column:
    """Monoisotopic mass of a molecular formula such as ``C42H82NO8P``.

    One letter per element in either case, a missing count means one, and
    counts may have any number of digits. Letters outside the table weigh 0.
    """
    table = F.create_map(*[F.lit(v) for pair in ELEMENT_MASS.items() for v in pair])
    terms = F.regexp_extract_all(formula, F.lit("([A-Za-z][0-9]*)"), F.lit(1))

    def add(total: Column, term: Column) -> Column:
        mass = F.coalesce(F.try_element_at(table, F.upper(F.substring(term, 1, 1))), F.lit(0.0))
        count = F.coalesce(F.substr(term, F.lit(2)).try_cast("double"), F.lit(1.0))
        return total + mass * count

    return F.aggregate(terms, F.lit(0.0), add)


def ppm_low(mz: Column, ppm: float) -> Column:
    return mz - mz * F.lit(float(ppm)) / F.lit(1000000.0)


def ppm_high(mz: Column, ppm: float) -> Column:
    return mz + mz * F.lit(float(ppm)) / F.lit(1000000.0)
