"""Digest expressions: fingerprints, spelling, masks and identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartulary.functions.text import strip

#: Hexadecimal digits of each digest, and its bit in a digest mask.
WIDTH = {"crc32": 8, "md5": 32, "sha1": 40, "sha256": 64}
MASK = {"crc32": 0x1, "md5": 0x10, "sha1": 0x100, "sha256": 0x1000}


def hex_number(col: Column) -> Column:
    """The digest as a number's plain spelling: no case, 0x, leading zeros or blanks; blank is null."""
    bare = F.regexp_replace(F.lower(strip(col)), "^0x(?=.)", "")
    return F.when(F.length(bare) > 0, F.regexp_replace(bare, "^0+(?=.)", ""))


def normal_digest(col: Column, kind: str) -> Column:
    """Lower-case digest, left-padded to its width; longer values stay as they are; blank is null."""
    bare = F.regexp_replace(F.lower(strip(col)), "^0x(?=.)", "")
    padded = F.when(F.length(bare) < WIDTH[kind], F.lpad(bare, WIDTH[kind], "0")).otherwise(bare)
    return F.when(F.length(bare) > 0, padded)


def well_formed(col: Column, kind: str) -> Column:
    """True if ``col`` is a digest of the right width."""
    return F.coalesce(col.rlike(f"^[0-9a-f]{{{WIDTH[kind]}}}$"), F.lit(False))


def fingerprint(content: Column, kinds: tuple[str, ...] = ("crc32", "md5", "sha1", "sha256")) -> dict[str, Column]:
    """The wanted digests of binary or text content; columns not selected are never computed."""
    every = {
        "crc32": F.lpad(F.lower(F.hex(F.crc32(content))), 8, "0"),
        "md5": F.md5(content),
        "sha1": F.sha1(content),
        "sha256": F.sha2(content, 256),
    }
    return {kind: every[kind] for kind in kinds}


def member_identity(crc32: Column, md5: Column, sha1: Column, sha256: Column, size: Column) -> Column:
    """The strongest digest at hand, else ``crc32|size`` with ``undefined`` for a missing CRC."""
    weak = F.concat(F.coalesce(crc32, F.lit("undefined")), F.lit("|"), F.coalesce(size.cast("string"), F.lit("0")))
    return F.coalesce(sha256, sha1, md5, weak)


def required_bit(crc32: Column, md5: Column, sha1: Column, sha256: Column, size: Column) -> Column:
    """The mask bit of the cheapest digest that can identify a member."""
    return (
        F.when(crc32.isNotNull() & size.isNotNull(), MASK["crc32"])
        .when(md5.isNotNull(), MASK["md5"])
        .when(sha1.isNotNull(), MASK["sha1"])
        .when(sha256.isNotNull(), MASK["sha256"])
        .otherwise(0)
    )


def multiset_print(identity: Column) -> Column:
    """Aggregate: a fingerprint of a group's identities, whatever their order; repeated ones count.

    Number of members and the sums of two 60-bit parts of their MD5s: partial sums
    combine before the shuffle, so no group is ever collected or sorted.
    """
    digest = F.md5(identity)
    part = lambda start: F.sum(F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return F.concat_ws("-", F.count(identity).cast("string"), part(1), part(16))
