"""Check sums, fingerprints, deterministic identifiers and sort keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col

CRC32Q_POLYNOMIAL = 0x814141AB


def _crc32q_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ CRC32Q_POLYNOMIAL if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
        table.append(crc)
    return table


def crc32q(text) -> Column:
    """CRC-32Q of the UTF-8 bytes, eight hex digits."""
    digits = F.hex(F.encode(col(text), "UTF-8"))
    table = F.array(*[F.lit(v).cast("long") for v in _crc32q_table()])

    def step(crc, i):
        byte = F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("long")
        index = F.shiftright(crc, 24).bitwiseXOR(byte).bitwiseAND(F.lit(255)).cast("int")
        shifted = F.shiftleft(crc, 8).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
        return shifted.bitwiseXOR(F.get(table, index))

    n = (F.length(digits) / 2).cast("int")
    crc = F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0).cast("long"), step)).otherwise(
        F.lit(0).cast("long")
    )
    return F.when(col(text).isNotNull(), F.lpad(F.hex(crc), 8, "0"))


def uuid_for(key) -> Column:
    """Deterministic version-5-shaped UUID text of a key."""
    h = F.sha1(col(key))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
        variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def natural_sort_key(text) -> Column:
    """Sort key in which digit groups of any length compare as numbers (A2 before A10); leading zeros do not count.

    A group is led by its number of digits, so longer numbers come later.
    """
    parts = F.regexp_extract_all(F.lower(col(text)), F.lit(r"(\d+|\D+)"), F.lit(1))

    def one(part: Column) -> Column:
        digits = F.regexp_replace(part, r"^0+", "")
        return F.when(part.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), 6, "0"), digits)).otherwise(part)

    return F.array_join(F.transform(parts, one), "")
