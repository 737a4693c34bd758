"""File readers: listing, digests, headers, paddings, signatures and members of archives."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import re
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from hashlib import md5, sha1, sha256
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions.digests import fingerprint

#: Files that operating systems leave behind.
JUNK = r"(^|/)(\.DS_Store|Thumbs\.db|desktop\.ini|\.Trash[^/]*|__MACOSX)(/|$)"

#: Header name, offset, bytes, where the data begins, extensions with and without header.
HEADERS = (
    ("A7800", 1, "415441524937383030", 128, ".a78", ".a78"), ("LNX", 0, "4C594E58", 64, ".lnx", ".lyx"), ("NES", 0, "4E45531A", 16, ".nes", ".nes"),
    ("FDS", 0, "464453", 16, ".fds", ".fds"), ("SMC", 3, "00" * 509, 512, ".smc", ".sfc"),
    ("SMC_GAME_DOCTOR_1", 0, "00014D4520444F43544F522053462033", 512, ".smc", ".sfc"), ("SMC_GAME_DOCTOR_2", 0, "47414D4520444F43544F522053462033", 512, ".smc", ".sfc"),
)

#: Extension and the pieces (offset, bytes) that tell a file's kind.
SIGNATURES = (
    (".7z", ((0, "377ABCAF271C"),)), (".bz2", ((0, "425A68"),)), (".gz", ((0, "1F8B08"),)), (".lz", ((0, "4C5A4950"),)), (".lz4", ((0, "04224D18"),)),
    (".rar", ((0, "526172211A0700"),)), (".rar", ((0, "526172211A070100"),)), (".tar", ((257, "7573746172003030"),)), (".tar", ((257, "7573746172202000"),)),
    (".xar", ((0, "78617221"),)), (".xz", ((0, "FD377A585A00"),)), (".z", ((0, "1F9D"),)), (".z", ((0, "1FA0"),)), (".zip", ((0, "504B0304"),)),
    (".zip", ((0, "504B0506"),)), (".z01", ((0, "504B0708"),)), (".zst", ((0, "28B52FFD"),)), (".chd", ((0, "4D436F6D70724844"),)), (".cso", ((0, "4349534F"),)),
    (".dax", ((0, "444158"),)), (".isz", ((0, "49735A21"),)), (".zso", ((0, "5A49534F"),)), (".elf", ((0, "7F454C46"),)), (".a78", ((1, "415441524937383030"),)),
    (".lnx", ((0, "4C594E58"),)), (".n64", ((0, "40123780"),)), (".v64", ((0, "37804012"),)), (".z64", ((0, "80371240"),)), (".ndd", ((0, "E848D31610"),)),
    (".fds", ((0, "012A4E494E54454E444F2D4856432A"),)), (".fds", ((0, "464453"),)), (".nes", ((0, "4E45531A"),)), (".gcz", ((0, "01C00BB1"),)),
    (".nkit.iso", ((512, "4E4B4954"),)), (".rvz", ((0, "52565A01"),)), (".wia", ((0, "57494101"),)), (".3dsx", ((0, "33445358"),)),
    (".3ds", ((0x100, "4E435344"),)), (".gba", ((0x04, "24FFAE51699AA221"),)), (".nds", ((0xC0, "24FFAE51699AA221"), (0x15C, "56CF"))),
)

#: As above, with the bytes as text.
TEXT_SIGNATURES = (
    (".lzh", ((0, "-lh"), (4, "-"))), (".oar", ((0, "OAR"),)), (".rs", ((0, "RSVKDATA"),)), (".crt", ((0, "C64 CARTRIDGE "),)), (".crt", ((0, "C128 CARTRIDGE "),)),
    (".crt", ((0, "CBM2 CARTRIDGE "),)), (".crt", ((0, "VIC20 CARTRIDGE "),)), (".crt", ((0, "PLUS4 CARTRIDGE "),)), (".g64", ((0, "GCR-1541"),)), (".p00", ((0, "C64File\0"),)),
    (".p64", ((0, "P64-1541"),)), (".t64", ((0, "C64S tape image file" + "\0" * 12),)), (".tap", ((0, "C64-TAPE-RAW"),)), (".tap", ((0, "C16-TAPE-RAW"),)), (".x64", ((0, "C\x15Ad"),)),
    (".bin", ((0, "main.bs"),)), (".smc", ((0, "\0\x01ME DOCTOR SF 3"),)), (".smc", ((0, "GAME DOCTOR SF 3"),)), (".nca", ((0x200, "NCA0"),)), (".nca", ((0x200, "NCA1"),)),
    (".nca", ((0x200, "NCA2"),)), (".nca", ((0x200, "NCA3"),)), (".ncz", ((0x4000, "NCZSECTN"),)), (".nro", ((0x10, "NRO0"),)), (".nso", ((0, "NSO0"),)), (".nsp", ((0, "PFS0"),)),
    (".zca", ((0, "ZCA0"),)), (".ccf", ((0, "CCF\0"),)), (".vff", ((0, "VFF "),)), (".wdf", ((0, "WII\x01DISC"),)), (".wud", ((0, "WUP-"),)), (".32x", ((0x100, "SEGA 32X"),)),
    (".gg", ((0x7FF0, "TMR SEGA"),)), (".md", ((0x100, "SEGA "),)), (".md", ((0x100, "SEGA IS A REGISTERED"),)),
)
SIGNATURES += tuple((extension, tuple((offset, text.encode("latin-1").hex()) for offset, text in pieces)) for extension, pieces in TEXT_SIGNATURES)


def literal_first(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths as globs: one that exists as it is written stands for itself, whatever signs it has; FileNotFoundError if none of them has a file."""
    configuration, out, found = spark._jsc.hadoopConfiguration(), [], False
    for text in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(text)
        system = path.getFileSystem(configuration)
        if system.exists(path):
            found = True
            out.append(re.sub(r"([\\*?\[\]{}])", r"\\\1", text))
        elif len(system.globStatus(path) or []):
            found = True
            out.append(text)
    if not found:
        raise FileNotFoundError(", ".join(paths))
    return out


def list_files(spark: SparkSession, paths: list[str], exclude: list[str] | None = None) -> DataFrame:
    """``path, size, mtime`` of all files below the paths or globs, once each, without junk and exclusions; contents are not read.

    Paths that do not exist are passed over, unless none does; a path that exists as it is written is no glob.
    Empty files are not listed, as Spark plans no read for them; a member of size 0 needs no file (see ``generate_plan``).
    """
    def listing(where: list[str]) -> DataFrame:
        where = literal_first(spark, where)
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(where)
        return rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).dropDuplicates(["path"])

    found = listing(paths).where(~F.col("path").rlike(JUNK))
    if not exclude:
        return found
    return found.join(listing(exclude).select(F.col("path").alias("x")), F.col("path") == F.col("x"), "left_anti")


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, size, mtime, content``; select only the digests that are needed and the rest is never computed."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return rows.where(~F.col("path").rlike(JUNK)).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


HASH_SCHEMA = "path string, size bigint, mtime timestamp, crc32 string, md5 string, sha1 string, sha256 string, error string"


def hash_stream(stream, kinds: tuple[str, ...], chunk: int = 1 << 20) -> dict:
    """Size and the wanted digests of a stream, read once in pieces."""
    states = {k: made() for k, made in (("md5", md5), ("sha1", sha1), ("sha256", sha256)) if k in kinds}
    size = crc = 0
    while piece := stream.read(chunk):
        size += len(piece)
        if "crc32" in kinds:
            crc = zlib.crc32(piece, crc)
        for state in states.values():
            state.update(piece)
    return {"size": size, **({"crc32": f"{crc:08x}"} if "crc32" in kinds else {}), **{k: state.hexdigest() for k, state in states.items()}}


def _file_system(path: str):
    """The file system that a path as Spark lists it names, and the path inside it."""
    from pyarrow import fs

    scheme, found, rest = path.partition(":")
    if not found or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if found else path).lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/@%"))


def hash_files(listing: DataFrame, kinds: tuple[str, ...] = ("crc32", "md5", "sha1", "sha256"), tasks: int | None = None) -> DataFrame:
    """``path, size, mtime``, the wanted digests and ``error`` of listed files (``path, size, mtime``), of any size.

    Contents are never a cell: each file is read in pieces of a megabyte through the
    file system its path names, and its digests are taken in that one pass.  A file that
    cannot be read is a row with its error.  ``tasks`` spreads the paths, which are few
    bytes each, over that many tasks.
    """
    columns = [c.split()[0] for c in HASH_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, size, mtime in zip(batch["path"], batch["size"], batch["mtime"]):
                row = dict.fromkeys(columns) | {"path": path, "size": size, "mtime": mtime}
                try:
                    system, inside = _file_system(path)
                    with system.open_input_stream(inside, compression=None) as stream:
                        row |= hash_stream(stream, kinds)
                except Exception as problem:  # an unreadable file is a row with its error, not the end of the scan
                    row["error"] = f"{type(problem).__name__}: {problem}"[:300]
                yield pd.DataFrame([row], columns=columns)

    spread = listing.select("path", "size", "mtime")
    return (spread.repartition(tasks) if tasks else spread).mapInPandas(run, HASH_SCHEMA)


def with_digests(files: DataFrame, kinds: tuple[str, ...] = ("crc32", "md5", "sha1", "sha256")) -> DataFrame:
    return files.withColumns(fingerprint(F.col("content"), kinds))


def with_missing_digests(files: DataFrame, cache: DataFrame, kinds: tuple[str, ...] = ("crc32", "md5", "sha1", "sha256")) -> DataFrame:
    """Digests from the cache where path, size and time agree, computed for all other files."""
    key = ["path", "size", "mtime"]
    known = cache.where(" AND ".join(f"{k} IS NOT NULL" for k in kinds)).select(*key, *kinds).dropDuplicates(key)
    hits = files.drop("content").join(known, key)
    misses = with_digests(files.join(known.select(*key), key, "left_anti"), kinds).drop("content")
    return hits.select(*misses.columns).unionByName(misses)


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def detect_header(content: Column, path: Column | None = None, always: bool = False) -> Column:
    """``struct(name, data_offset, extension)`` of the first header that fits; without ``always`` only for eligible extensions."""
    found = F.lit(None).cast("struct<name:string,data_offset:int,extension:string>")
    for name, offset, value, data, headered, bare in reversed(HEADERS):
        hit = F.substring(content, offset + 1, len(value) // 2) == F.unhex(F.lit(value))
        if path is not None and not always:
            hit = hit & _extension(path).isin(headered, bare)
        found = F.when(hit, F.struct(F.lit(name).alias("name"), F.lit(data).alias("data_offset"), F.lit(bare).alias("extension"))).otherwise(found)
    return found


def with_headerless(files: DataFrame, always: bool = False) -> DataFrame:
    """``files`` with ``header`` and the digests behind it (``*_headerless``), null without a header."""
    rows = files.withColumn("header", detect_header(F.col("content"), F.col("path"), always))
    body = F.when(F.col("header").isNotNull(), F.substring(F.col("content"), F.col("header.data_offset") + 1, F.length("content")))
    return rows.withColumns({f"{k}_headerless": v for k, v in fingerprint(body).items()})


#: Kinds of contents that are known to be trimmed.
TRIMMABLE = (".3ds", ".gba", ".nds")


def with_paddings(files: DataFrame, always: Column | None = None) -> DataFrame:
    """``files`` with ``paddings``: digests of trimmed contents filled to the next power of two with 0x00 and 0xFF.

    Only contents whose signature is that of a trimmable kind are filled, and those for
    which ``always`` holds.  Contents whose size is a power of two and empty ones are not
    trimmed.  What fills up is one array of at most the content's own size.
    """
    size = F.length("content")
    full = F.pow(F.lit(2.0), F.ceil(F.log2(size.cast("double")))).cast("int")
    eligible = F.coalesce(detect_signature(F.col("content")).isin(*TRIMMABLE), F.lit(False))
    eligible = eligible if always is None else eligible | F.coalesce(always, F.lit(False))
    trimmed = eligible & (size > 0) & (size.bitwiseAND(size - 1) != 0)

    def one(fill: int) -> Column:
        padded = F.rpad(F.col("content"), full, F.unhex(F.lit(f"{fill:02X}")))
        return F.struct(full.cast("bigint").alias("padded_size"), F.lit(fill).alias("fill"), *[c.alias(n) for n, c in fingerprint(padded).items()])

    kind = "array<struct<padded_size:bigint,fill:int,crc32:string,md5:string,sha1:string,sha256:string>>"
    return files.withColumn("paddings", F.when(trimmed, F.array(one(0x00), one(0xFF))).otherwise(F.array().cast(kind)))


def detect_signature(content: Column) -> Column:
    """The extension a content's bytes speak for: most pieces first, then most bytes; null if none fits."""
    ranked = sorted(SIGNATURES, key=lambda s: (-len(s[1]), -sum(len(v) for _, v in s[1])))
    found = F.lit(None).cast("string")
    for extension, pieces in reversed(ranked):
        hit = F.lit(True)
        for offset, value in pieces:
            hit = hit & (F.substring(content, offset + 1, len(value) // 2) == F.unhex(F.lit(value)))
        found = F.when(hit, extension).otherwise(found)
    return found


def corrected_extensions(files: DataFrame) -> DataFrame:
    """``path, extension, right, confidence``: extensions that the content contradicts; longer signatures are surer."""
    right = detect_signature(F.col("content"))
    sure = F.lit(0.5)
    for extension, pieces in SIGNATURES:
        sure = F.when(right == extension, min(1.0, 0.5 + 0.1 * sum(len(v) // 2 for _, v in pieces))).otherwise(sure)
    rows = files.select("path", _extension(F.col("path")).alias("extension"), right.alias("right"), sure.alias("confidence"))
    return rows.where(F.col("right").isNotNull() & (F.col("right") != F.col("extension")))


def disc_kinds(files: DataFrame) -> DataFrame:
    """``path, kind``: image kinds by magic bytes or name: chd, nkit, iso, pbp, cue."""
    c, ext = F.col("content"), _extension(F.col("path"))
    kind = (
        F.when(F.substring(c, 1, 8) == F.unhex(F.lit("4D436F6D70724844")), "chd").when(F.substring(c, 513, 4) == F.unhex(F.lit("4E4B4954")), "nkit")
        .when(F.substring(c, 0x8002, 5) == F.unhex(F.lit("4344303031")), "iso").when(F.substring(c, 1, 4) == F.unhex(F.lit("00504250")), "pbp").when(ext == ".cue", "cue")
    )
    return files.select("path", kind.alias("kind")).where(F.col("kind").isNotNull())


# -- archives -----------------------------------------------------------------

ARCHIVE_SCHEMA = "path string, archive string, entry_path string, size bigint, crc32 string, md5 string, sha1 string, sha256 string, error string"


def _digests(data: bytes) -> dict:
    return {"size": len(data), "crc32": f"{zlib.crc32(data):08x}", "md5": md5(data).hexdigest(), "sha1": sha1(data).hexdigest(), "sha256": sha256(data).hexdigest()}


def archive_entries(path: str, content: bytes, quick: bool = False) -> Iterator[dict]:
    """Members of one archive (zip, tar, gzip, bzip2, xz); ``quick`` takes sizes and CRCs from a zip's directory alone."""
    base = {"path": path, "error": None, "md5": None, "sha1": None, "sha256": None}
    try:
        if content[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for info in archive.infolist():
                    if info.is_dir():
                        continue
                    listed = {"size": info.file_size, "crc32": f"{info.CRC:08x}"}
                    yield base | {"archive": "zip", "entry_path": info.filename} | (listed if quick else _digests(archive.read(info)))
            return
        for name, magic, opener in (("gz", b"\x1f\x8b", gzip.decompress), ("bz2", b"BZh", bz2.decompress), ("xz", b"\xfd7zXZ\x00", lzma.decompress)):
            if content.startswith(magic):
                inner = opener(content)
                if inner[257:262] == b"ustar":
                    content = inner
                    break
                stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                yield base | {"archive": name, "entry_path": stem} | _digests(inner)
                return
        if content[257:262] == b"ustar":
            with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                for info in archive:
                    if info.isfile():
                        yield base | {"archive": "tar", "entry_path": info.name} | _digests(archive.extractfile(info).read())
    except Exception as problem:  # a broken archive is a row with its error, not the end of the scan
        yield base | {"archive": None, "entry_path": None, "size": None, "crc32": None, "error": f"{type(problem).__name__}: {problem}"[:300]}


def expand_archives(files: DataFrame, quick: bool = False) -> DataFrame:
    """A row for each member of each archive among ``files`` (``path, content``); other files give none."""
    columns = [c.split()[0] for c in ARCHIVE_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = list(archive_entries(path, bytes(content), quick))
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    archives = files.where(detect_signature(F.col("content")).isin(".zip", ".gz", ".bz2", ".xz", ".tar")).select("path", "content")
    return archives.mapInPandas(run, ARCHIVE_SCHEMA)


def unique_files(files: DataFrame, identity: str = "sha256") -> DataFrame:
    """One file per identity, the first by path; files without identity all stay.  A minimum per key, combined before the shuffle."""
    others = [c for c in files.columns if c != "path"]
    key = F.coalesce(F.col(identity), F.concat(F.lit("path:"), F.col("path")))
    first = files.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*files.columns), "path").alias("f"))
    return first.select(*[F.col(f"f.{c}").alias(c) for c in ["path", *others]])
