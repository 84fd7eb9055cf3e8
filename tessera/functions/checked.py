"""Types with checks, as text: whether a value is one, and its canonical form (NULL for what is none). Enums and domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The forms of the types.
BYTE = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
FORMS = {
    "uuid": "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "macaddr": "^([0-9a-f]{2}:){5}[0-9a-f]{2}$",
    "inet": rf"^({BYTE}\.){{3}}{BYTE}(/(3[0-2]|[12]?[0-9]))?$",
    "bit": "^[01]+$",
}
NUMBER = r"[+-]?[0-9]+(\.[0-9]+)?"
POINT = rf"\({NUMBER},{NUMBER}\)"
FORMS |= {"point": rf"^{POINT}$", "lseg": rf"^\[{POINT},{POINT}\]$", "box": rf"^{POINT},{POINT}$", "circle": rf"^<{POINT},[0-9]+(\.[0-9]+)?>$", "polygon": rf"^\({POINT}(,{POINT})*\)$"}


def canonical(s: Column, kind: str, length: int | None = None) -> Column:
    """Lower case without blanks, if it has the form of the type (IPv4 for inet); bit of a length has that many digits."""
    plain = F.lower(F.regexp_replace(s, r"\s", ""))
    ok = plain.rlike(FORMS[kind])
    return F.when(ok & (F.length(plain) == length) if length is not None else ok, plain)


def host_number(address: Column) -> Column:
    """An IPv4 address as a number."""
    parts = F.split(F.split_part(canonical(address, "inet"), F.lit("/"), F.lit(1)), r"\.")
    return F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s * 256 + x.cast("long"))


def in_network(address: Column, network: Column) -> Column:
    """address << = network: the leading bits that the network names agree."""
    bits = F.coalesce(F.nullif(F.split_part(network, F.lit("/"), F.lit(2)), F.lit("")).cast("int"), F.lit(32))
    size = F.pow(F.lit(2.0), F.lit(32) - bits).cast("long")
    return F.call_function("div", host_number(address), size) == F.call_function("div", host_number(network), size)


def enum_order(s: Column, labels: list[str]) -> Column:
    """The place of an enum's label, by which it is compared; NULL for what is no label."""
    return F.nullif(F.array_position(F.array(*map(F.lit, labels)), s), F.lit(0).cast("long"))


def outside_domain(df: DataFrame, column: str, check: Column, not_null: bool = False) -> DataFrame:
    """Rows whose value a domain refuses: its check is false, or it is NULL where it must not be."""
    bad = ~F.coalesce(check, F.lit(True))
    return df.where(bad | F.col(column).isNull() if not_null else bad)
