"""Patches: metadata from names and trailers, and application of the common formats."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Magic bytes of the formats, longest first.
MAGIC = ((b"NINJA2", "ninja"), (b"IPS32", "ips32"), (b"PATCH", "ips"), (b"APS10", "aps_n64"), (b"APS1", "aps_gba"), (b"BPS1", "bps"), (b"UPS1", "ups"), (b"PPF", "ppf"), (b"\xd6\xc3\xc4", "vcdiff"))
EXTENSIONS = {".ips": "ips", ".ips32": "ips32", ".ebp": "ips", ".bps": "bps", ".ups": "ups", ".aps": "aps_n64", ".ppf": "ppf", ".dps": "dps", ".vcdiff": "vcdiff", ".xdelta": "vcdiff"}


class PatchError(ValueError):
    """A patch that is broken or does not belong to its input."""


def _uint(data: bytes, at: int) -> tuple[int, int]:
    """A variable-length number and the place behind it."""
    value, shift = 0, 1
    while True:
        if at >= len(data):
            raise PatchError("number runs over the end")
        byte = data[at]
        at += 1
        value += (byte & 0x7F) * shift
        if byte & 0x80:
            return value, at
        shift <<= 7
        value += shift


def patch_format(path: str, data: bytes) -> str | None:
    """The format by magic bytes, else by extension."""
    for magic, name in MAGIC:
        if data.startswith(magic):
            return name
    return EXTENSIONS.get("." + path.rsplit(".", 1)[-1].lower())


def patch_metadata(path: str, data: bytes) -> dict:
    """``format, crc_before, crc_after, size_after``: of the trailer where the format has one, else the CRC in the name."""
    kind = patch_format(path, data)
    named = re.search(r"(?:^|[^0-9a-fA-F])([0-9a-fA-F]{8})(?:[^0-9a-fA-F]|$)", path.rsplit("/", 1)[-1])
    found = {"path": path, "format": kind, "crc_before": named.group(1).lower() if named else None, "crc_after": None, "size_after": None}
    if kind in ("bps", "ups") and len(data) >= 16:
        try:
            _, at = _uint(data, 4)
            size, _ = _uint(data, at)
        except PatchError:
            return found
        before, after = (int.from_bytes(data[a : a + 4], "little") for a in (len(data) - 12, len(data) - 8))
        found |= {"crc_before": f"{before:08x}", "crc_after": f"{after:08x}", "size_after": size}
    return found


def _put(target: bytearray, at: int, data: bytes) -> None:
    if at > len(target):
        target.extend(bytes(at - len(target)))
    target[at : at + len(data)] = data


def _ips(source: bytes, data: bytes, width: int, start: int, end: bytes) -> bytes:
    target, at = bytearray(source), start
    while at < len(data) and data[at : at + len(end)] != end:
        place, size = int.from_bytes(data[at : at + width], "big"), int.from_bytes(data[at + width : at + width + 2], "big")
        at += width + 2
        if size:
            block, at = data[at : at + size], at + size
        else:
            block, at = data[at + 2 : at + 3] * int.from_bytes(data[at : at + 2], "big"), at + 3
        _put(target, place, block)
    return bytes(target)


def _ups(source: bytes, data: bytes) -> bytes:
    expected, at = _uint(data, 4)
    size, at = _uint(data, at)
    if expected != len(source):
        raise PatchError("input has another size")
    target, here = bytearray(source[:size].ljust(size, b"\0")), 0
    while at < len(data) - 12:
        skip, at = _uint(data, at)
        here += skip
        while True:
            if at >= len(data) - 12:
                raise PatchError("block without end")
            mask, at = data[at], at + 1
            if here < size:
                target[here] = (source[here] if here < len(source) else 0) ^ mask
            here += 1
            if not mask:
                break
    return bytes(target)


def _bps(source: bytes, data: bytes) -> bytes:
    expected, at = _uint(data, 4)
    if expected != len(source):
        raise PatchError("input has another size")
    size, at = _uint(data, at)
    note, at = _uint(data, at)
    at += note
    target, from_source, from_target = bytearray(), 0, 0
    while at < len(data) - 12:
        word, at = _uint(data, at)
        length = (word >> 2) + 1
        action = word & 3
        if action == 0:
            target += source[len(target) : len(target) + length]
        elif action == 1:
            target += data[at : at + length]
            at += length
        else:
            step, at = _uint(data, at)
            step = -(step >> 1) if step & 1 else step >> 1
            if action == 2:
                from_source += step
                target += source[from_source : from_source + length]
                from_source += length
            else:
                from_target += step
                for _ in range(length):  # a copy may read what it has just written
                    target.append(target[from_target])
                    from_target += 1
    if len(target) != size:
        raise PatchError("output has another size")
    return bytes(target)


def _aps_n64(source: bytes, data: bytes) -> bytes:
    at, target = (61 if data[5] == 0 else 78), bytearray(source)
    while at + 5 <= len(data):
        place, size = int.from_bytes(data[at : at + 4], "little"), data[at + 4]
        at += 5
        if size:
            block, at = data[at : at + size], at + size
        else:
            block, at = data[at : at + 1] * data[at + 1], at + 2
        _put(target, place, block)
    return bytes(target)


def _aps_gba(source: bytes, data: bytes, block: int = 1 << 16) -> bytes:
    if int.from_bytes(data[4:8], "little") != len(source):
        raise PatchError("input has another size")
    at, target = 12, bytearray(source)
    while at + 8 < len(data):
        place, mask = int.from_bytes(data[at : at + 4], "little"), data[at + 8 : at + 8 + block]
        own = source[place : place + len(mask)].ljust(len(mask), b"\0")
        _put(target, place, bytes(a ^ b for a, b in zip(own, mask)))
        at += 8 + block
    return bytes(target)


def _dps(source: bytes, data: bytes) -> bytes:
    if int.from_bytes(data[194:198], "little") != len(source):
        raise PatchError("input has another size")
    at, target = 198, bytearray(source)
    number = lambda a: int.from_bytes(data[a : a + 4], "little")
    while at < len(data):
        mode, place = data[at], number(at + 1)
        if mode == 0:
            block, at = source[number(at + 5) : number(at + 5) + number(at + 9)], at + 13
        elif mode == 1:
            block, at = data[at + 9 : at + 9 + number(at + 5)], at + 9 + number(at + 5)
        else:
            raise PatchError(f"mode {mode}")
        _put(target, place, block)
    return bytes(target)


def _ppf(source: bytes, data: bytes) -> bytes:
    """Versions 1 to 3: a header of fixed size, a block to check the input, records of place, length and bytes."""
    version = data[5] + 1
    at, wide, undo = 56, 4, False
    if version == 2:
        if int.from_bytes(data[56:60], "little") != len(source):
            raise PatchError("input has another size")
        at = 60 + 1024
    elif version == 3:
        wide, undo = 8, bool(data[58])
        at = 60 + (1024 if data[57] else 0)
    target, end = bytearray(source), data.rfind(b"@BEGIN_FILE_ID.DIZ")
    end = len(data) if end < 0 else end
    while at + wide < end:
        place, size = int.from_bytes(data[at : at + wide], "little"), data[at + wide]
        at += wide + 1
        _put(target, place, data[at : at + size])
        at += size * (2 if undo else 1)
    return bytes(target)


# -- VCDIFF (RFC 3284, without secondary compression) -----------------------------


def _big(data: bytes, at: int) -> tuple[int, int]:
    """A base-128 number, most significant digits first, and the place behind it."""
    value = 0
    while True:
        if at >= len(data):
            raise PatchError("number runs over the end")
        byte, at = data[at], at + 1
        value = value << 7 | byte & 0x7F
        if not byte & 0x80:
            return value, at


def _default_codes() -> list[tuple[tuple[str, int, int], tuple[str, int, int] | None]]:
    """The default instruction table by its rule: pairs of (kind, size, mode)."""
    codes: list = [(("run", 0, 0), None)]
    codes += [(("add", size, 0), None) for size in range(18)]
    for mode in range(9):
        codes += [(("copy", size, mode), None) for size in (0, *range(4, 19))]
    for mode in range(6):
        codes += [(("add", add, 0), ("copy", copy, mode)) for add in range(1, 5) for copy in range(4, 7)]
    for mode in range(6, 9):
        codes += [(("add", add, 0), ("copy", 4, mode)) for add in range(1, 5)]
    codes += [(("copy", 4, mode), ("add", 1, 0)) for mode in range(9)]
    return codes


def _vcdiff(source: bytes, data: bytes) -> bytes:
    codes, out, at = _default_codes(), bytearray(), 5
    if data[4] & 3:
        raise PatchError("secondary compression and own code tables are not supported")
    if data[4] & 4:  # application header
        size, at = _big(data, at)
        at += size
    while at < len(data):
        indicator, at = data[at], at + 1
        segment = b""
        if indicator & 3:
            size, at = _big(data, at)
            place, at = _big(data, at)
            segment = (source if indicator & 1 else bytes(out))[place : place + size]
        _, at = _big(data, at)
        wanted, at = _big(data, at)
        if data[at]:
            raise PatchError("compressed sections are not supported")
        adds, at = _big(data, at + 1)
        instructions, at = _big(data, at)
        addresses, at = _big(data, at)
        at += 4 if indicator & 4 else 0  # checksum of the window
        add_at, code_at, address_at = at, at + adds, at + adds + instructions
        end, at = address_at, address_at + addresses
        window, near, same, slot = bytearray(), [0] * 4, [0] * 768, 0
        while code_at < end:
            pair, code_at = codes[data[code_at]], code_at + 1
            for step in pair:
                if step is None:
                    continue
                kind, size, mode = step
                if not size:
                    size, code_at = _big(data, code_at)
                if kind == "add":
                    window += data[add_at : add_at + size]
                    add_at += size
                elif kind == "run":
                    window += data[add_at : add_at + 1] * size
                    add_at += 1
                else:
                    here = len(segment) + len(window)
                    if mode < 6:
                        value, address_at = _big(data, address_at)
                        address = value if mode == 0 else here - value if mode == 1 else near[mode - 2] + value
                    else:
                        address, address_at = same[(mode - 6) * 256 + data[address_at]], address_at + 1
                    near[slot], slot = address, (slot + 1) % 4
                    same[address % 768] = address
                    for k in range(address, address + size):
                        window.append(segment[k] if k < len(segment) else window[k - len(segment)])
        if len(window) != wanted:
            raise PatchError("window has another size")
        out += window
    return bytes(out)


def apply_patch(source: bytes, path: str, data: bytes) -> bytes:
    """The patched content; PatchError if format, input or patch is wrong."""
    kind = patch_format(path, data)
    try:
        if kind == "ips":
            return _ips(source, data, 3, 5, b"EOF")
        if kind == "ips32":
            return _ips(source, data, 4, 5, b"EEOF")
        simple = {"ups": _ups, "bps": _bps, "aps_n64": _aps_n64, "aps_gba": _aps_gba, "dps": _dps, "ppf": _ppf, "vcdiff": _vcdiff}
        if kind in simple:
            return simple[kind](source, data)
    except IndexError as problem:
        raise PatchError("patch ends too early") from problem
    raise PatchError(f"format {kind} is not supported")


def _number(value: int) -> bytes:
    """A variable-length number, as ``_uint`` reads it."""
    out = bytearray()
    while True:
        low, value = value & 0x7F, value >> 7
        if not value:
            out.append(low | 0x80)
            return bytes(out)
        out.append(low)
        value -= 1


def appending_patch(kind: str, source: bytes, tail: bytes) -> bytes:
    """A patch (ips, ips32, ups, bps) that makes ``source + tail`` of ``source``; ``tail`` has one byte or more."""
    target = source + tail
    if kind in ("ips", "ips32"):
        width, start, end = (3, b"PATCH", b"EOF") if kind == "ips" else (4, b"IPS32", b"EEOF")
        if len(source) >= 1 << (8 * width):
            raise PatchError("the place is beyond what the format can name")
        pieces = [(at, tail[at : at + 0xFFFF]) for at in range(0, len(tail), 0xFFFF)]
        return start + b"".join((len(source) + at).to_bytes(width, "big") + len(piece).to_bytes(2, "big") + piece for at, piece in pieces) + end
    if kind == "ups":
        body = b"UPS1" + _number(len(source)) + _number(len(target)) + _number(len(source)) + tail + b"\0"
    elif kind == "bps":
        copied = _number((len(source) - 1) << 2) if source else b""
        body = b"BPS1" + _number(len(source)) + _number(len(target)) + _number(0) + copied + _number((len(tail) - 1) << 2 | 1) + tail
    else:
        raise PatchError(kind)
    body += zlib.crc32(source).to_bytes(4, "little") + zlib.crc32(target).to_bytes(4, "little")
    return body + zlib.crc32(body).to_bytes(4, "little")


def read_patches(files: DataFrame) -> DataFrame:
    """``path, format, crc_before, crc_after, size_after`` of the patches among ``files`` (``path, content``), equal contents once."""
    first = files.groupBy(F.sha2("content", 256).alias("h")).agg(F.min_by(F.struct("path", "content"), "path").alias("f")).select("f.path", "f.content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([patch_metadata(p, bytes(c)) for p, c in zip(batch["path"], batch["content"])], columns=["path", "format", "crc_before", "crc_after", "size_after"])

    rows = first.mapInPandas(run, "path string, format string, crc_before string, crc_after string, size_after bigint")
    return rows.where(F.col("format").isNotNull())


def patched_contents(pairs: DataFrame) -> DataFrame:
    """``id, size, crc32, content, error`` of ``pairs`` (``id, source, path, patch``); a failure is a row with its error."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, source, path, data in zip(batch["id"], batch["source"], batch["path"], batch["patch"]):
                try:
                    out = apply_patch(bytes(source), path, bytes(data))
                    row = (key, len(out), f"{zlib.crc32(out):08x}", out, None)
                except PatchError as problem:
                    row = (key, None, None, None, str(problem))
                yield pd.DataFrame([row], columns=["id", "size", "crc32", "content", "error"])

    return pairs.select("id", "source", "path", "patch").mapInPandas(run, "id bigint, size bigint, crc32 string, content binary, error string")
