"""Parsing of library titles, lipid names and acyl chains.

A library title packs several fields into one string:
``...LEVEL<n>..._DES_<name>-Fomula-<formula>-CCS-<ccs>-Add-<adduct>``
(the spelling ``Fomula`` is part of the format).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values of the title format
DESCRIPTION_MARK = "_DES_"
LEVEL_PATTERN = "LEVEL([0-9]+)"
FORMULA_MARK = "-Fomula-"
CCS_MARK = "-CCS-"
ADDUCT_MARK = "-Add-"
DATABASE_PREFIX = "DB#: "
MISSING_CHAIN = "ZZZ"
MIN_CHAINS = 4

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def description(title: Column) -> Column:
    """Text after the first ``_DES_``; empty where the mark is missing."""
    at = F.instr(title, DESCRIPTION_MARK)
    return F.when(at > 0, F.substring(title, at + len(DESCRIPTION_MARK), F.length(title))).otherwise("")


def level_of(title: Column, family: tuple[int, ...]) -> Column:
    """Highest ``LEVEL<n>`` in a title among ``family``; 0 when there is none."""
    found = F.regexp_extract_all(title, F.lit(LEVEL_PATTERN), F.lit(1))
    numbers = F.transform(found, lambda text: text.try_cast("int"))
    return F.coalesce(F.array_max(F.filter(numbers, lambda n: n.isin(*family))), F.lit(0))


def odd_level(title: Column) -> Column:
    return level_of(title, (1, 3))


def even_level(title: Column) -> Column:
    return level_of(title, (2, 4))


def _before(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def _after(text: Column, mark: str) -> Column:
    """Text between the first and second ``mark``; null without a mark."""
    return F.when(text.contains(mark), F.split_part(text, F.lit(mark), F.lit(2)))


def split_title(title: Column, strip_database: bool = False) -> dict[str, Column]:
    """Columns ``name, formula, ccs, adduct`` of a title; missing parts are null."""
    if strip_database:
        title = F.replace(title, F.lit(DATABASE_PREFIX), F.lit(""))
    rest = _after(title, FORMULA_MARK)
    tail = _after(rest, CCS_MARK)
    return {
        "name": _before(title, FORMULA_MARK),
        "formula": _before(rest, CCS_MARK),
        "ccs": _before(tail, ADDUCT_MARK),
        "adduct": _after(tail, ADDUCT_MARK),
    }


def subclass(name: Column) -> Column:
    """Lipid class: everything before the first space."""
    return F.regexp_replace(name, " .*", "")


def chain(name: Column) -> Column:
    """Acyl part: drop a ``_CAH_`` suffix, then all up to the last space."""
    return F.regexp_replace(F.regexp_replace(name, "_CAH_.*", ""), ".* ", "")


def _number(text: Column) -> Column:
    """Numeric value of a chain token, 0 where the text is no plain number."""
    plain = F.when(text.rlike("^[0-9]{1,9}$"), text.cast("int").cast("double"))
    return plain.when(text.rlike(_NUMBER), text.cast("double")).otherwise(F.lit(0.0))


def chain_slots(chain_text: Column) -> Column:
    """Array of ``struct(fa, c, u, other)``, one per ``_``-separated acyl chain."""
    part = lambda text, mark, n: F.split_part(text, F.lit(mark), F.lit(n))

    def parse(token: Column, position: Column) -> Column:
        # only the second chain may carry an unseparated "(OH)"
        fa = F.when(position == 1, F.replace(token, F.lit("("), F.lit(";("))).otherwise(token)
        after = part(fa, ":", 2)
        return F.struct(
            fa.alias("fa"),
            _number(part(fa, ":", 1)).alias("c"),
            _number(part(after, ";", 1)).alias("u"),
            part(after, ";", 2).alias("other"),
        )

    return F.transform(F.split(chain_text, "_"), parse)


def total_carbons(slots: Column) -> Column:
    return F.aggregate(slots, F.lit(0.0), lambda total, s: total + s["c"])


def total_unsaturation(slots: Column) -> Column:
    """``<double bonds>;<modifications>`` over all chains; every ``0`` leaves the second part."""
    bonds = F.aggregate(slots, F.lit(0.0), lambda total, s: total + s["u"])
    # whole numbers print without a fraction
    whole = F.regexp_replace(bonds.cast("string"), r"\.0$", "")
    others = F.array_join(F.transform(slots, lambda s: s["other"]), "")
    return F.concat(whole, F.lit(";"), F.replace(others, F.lit("0"), F.lit("")))


def chain_unsaturations(chain_text: Column) -> Column:
    """Sorted array of the per-chain unsaturations, filled up with ``ZZZ`` to at least four."""
    bonds = F.transform(F.split(chain_text, "_"), lambda token: F.regexp_replace(token, ".*:", ""))
    missing = F.greatest(F.lit(MIN_CHAINS) - F.size(bonds), F.lit(0))
    return F.sort_array(F.concat(bonds, F.array_repeat(F.lit(MISSING_CHAIN), missing)))


def chain_cluster(subclass_name: Column, total_uns: Column, chain_text: Column) -> Column:
    """Group key of the chain-level rule."""
    return F.concat_ws("*", subclass_name, total_uns, F.array_join(chain_unsaturations(chain_text), "*"))


def normalise_name(name: Column) -> dict[str, Column]:
    """Columns ``total, meta_name, subclass, chain`` of a library metabolite name.

    Moves ether marks in front of the space, drops positional suffixes, keeps
    the part after the last ``|`` and pulls ``(FA ..)`` groups into the class.
    """
    text = name
    # fixed values: the rewrite rules of the naming scheme, applied in this order
    for pattern, replacement in (
        (" O-", "-O "),
        (" P-", "-P "),
        ("-SN1", ""),
        (r"\(methyl\)", ""),
        ("/N-", "_"),
    ):
        text = F.regexp_replace(text, pattern, replacement)
    total = F.regexp_replace(text, r"\|.*", "")
    text = F.regexp_replace(text, r".*\|", "")
    acyl = F.regexp_replace(F.regexp_replace(text, r"\(FA .*\)", ""), " ", "-FA ")
    text = F.when(text.contains("(FA"), acyl).otherwise(text)
    text = F.regexp_replace(text, r"AHexCer \(O-", "AHexCer-O ")
    tail = F.regexp_replace(F.regexp_replace(text, ".* ", ""), " ", "")
    for pattern, replacement in ((r"OH\)", "OH"), (r"\)", "_"), ("OH", "OH)"), ("/", "_")):
        tail = F.regexp_replace(tail, pattern, replacement)
    return {"total": total, "meta_name": text, "subclass": subclass(text), "chain": tail}


def add_name_columns(df: DataFrame, name: str) -> DataFrame:
    """Add ``subclass, chain, total_c, total_uns`` parsed from a lipid name.

    The parsed chains are a column of their own, so that both totals read one
    result instead of each parsing the name again. None of the columns is
    nullable: a join on them then plans no null check that would repeat the
    parsing below the scan.
    """
    text = F.coalesce(F.col(name), F.lit(""))
    parsed = df.withColumns({"subclass": subclass(text), "chain": chain(text)})
    slots = F.col("_slots")
    filled = {
        "subclass": F.coalesce("subclass", F.lit("")),
        "chain": F.coalesce("chain", F.lit("")),
        "total_c": F.coalesce(total_carbons(slots), F.lit(0.0)),
        "total_uns": F.coalesce(total_unsaturation(slots), F.lit("")),
    }
    return parsed.withColumn("_slots", chain_slots(F.col("chain"))).withColumns(filled).drop("_slots")
