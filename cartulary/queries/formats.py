"""Queries of readers, codecs and sinks over contents made from the tables, and the SQL that states what must come out."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions import names as N
from cartulary.functions.digests import normal_digest
from cartulary.operators import matching as M
from cartulary.operators import plan as P
from cartulary.operators import records as R
from cartulary.plans import sinks as S
from cartulary.queries import reference as Q
from cartulary.sources import assets as A
from cartulary.sources import catalogs as X
from cartulary.sources import patches as H
from cartulary.session import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if it has one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# -- catalogs of any format ------------------------------------------------------------


def _quoted(c):
    return F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit("'")), F.lit('"'))


def _catalog_texts(spark, d) -> DataFrame:
    """A catalog text for each entry with its members: XML, software list, CMPro, SMDB or none of them, by the entry's id."""
    entries = Q._entries(spark, d, "dat_id", "name", "cloneof")
    members = Q._members(spark, d, entries).where(F.col("kind") != "disk")
    name = F.replace(F.coalesce("name", F.lit("")), F.lit('"'), F.lit("'"))
    listed = members.groupBy(F.col("game_id").alias("m_id")).agg(F.array_sort(F.collect_list(F.struct("ord", "rom_id", name.alias("name"), "size", "crc32", "md5", "sha1", "sha256"))).alias("m"))
    rows = entries.join(listed, F.col("game_id") == F.col("m_id"))
    rom = F.transform("m", lambda r: F.struct(r["name"].alias("_name"), r["size"].cast("string").alias("_size"), r["crc32"].alias("_crc"), r["md5"].alias("_md5"), r["sha1"].alias("_sha1"), r["sha256"].alias("_sha256")))
    game = F.array(F.struct(F.col("name").alias("_name"), F.col("cloneof").alias("_cloneof"), rom.alias("rom")))
    areas = F.array(F.struct(F.array(F.struct(rom.alias("rom"))).alias("dataarea")))
    software = F.array(F.struct(F.col("name").alias("_name"), F.col("cloneof").alias("_cloneof"), areas.alias("part")))
    xml = lambda tag, *inside: F.concat(F.lit('<?xml version="1.0"?>\n<!-- made -->\n'), F.to_xml(F.struct(*inside), {"rowTag": tag, "attributePrefix": "_"}))
    header = F.struct(F.concat(F.lit("set "), F.col("dat_id").cast("string")).alias("name"), F.lit("made & kept").alias("description"), F.lit("1.0").alias("version")).alias("header")
    list_name = F.concat(F.lit("list "), F.col("dat_id").cast("string")).alias("_name")
    word = lambda tag, c: F.when(c.isNotNull(), F.concat(F.lit(f" {tag} "), c)).otherwise("")
    block = F.array_join(F.transform("m", lambda r: F.concat(
        F.lit("\trom ( name "), _quoted(r["name"]), word("size", r["size"].cast("string")), word("crc", r["crc32"]), word("md5", r["md5"]), word("sha1", r["sha1"]), word("sha256", r["sha256"]), F.lit(" )"))), "\n")
    clone = F.when(F.col("cloneof").isNotNull(), F.concat(F.lit("\tcloneof "), _quoted(F.col("cloneof")), F.lit("\n"))).otherwise("")
    cmpro = F.concat(F.lit('clrmamepro (\n\tname "made"\n)\n\ngame (\n\tname '), _quoted(F.col("name")), F.lit("\n"), clone, block, F.lit("\n)\n"))
    lines = F.array_join(F.transform("m", lambda r: F.concat_ws("\t", *[F.coalesce(r[c].cast("string"), F.lit("")) for c in ("sha256", "name", "sha1", "md5", "crc32", "size")])), "\r\n")
    kind = F.pmod("game_id", F.lit(6))
    value = (
        F.when(kind == 0, xml("datafile", header, game.alias("game"))).when(kind == 1, xml("softwarelist", list_name, software.alias("software"))).when(kind == 2, cmpro).when(kind == 3, lines)
        .when(kind == 4, F.lit('game (\n\tname "never closed')).otherwise(F.lit("<datafile><game"))
    )
    return rows.select(F.col("game_id").cast("string").alias("path"), value.alias("value"))


_LISTED = f"""WITH {Q._ENTRIES}, {Q._MEMBERS}, m AS (SELECT game_id, rom_id, replace(coalesce(name, ''), '"', '''') AS name, coalesce(size, 0) AS size, crc32, md5, sha1, sha256 FROM members WHERE kind <> 'disk'),
g AS (SELECT DISTINCT e.game_id, e.name, e.cloneof, game_id % 6 AS kind FROM entries e JOIN m USING (game_id)),
formed AS (SELECT g.kind, g.name AS entry, m.* FROM g JOIN m USING (game_id) WHERE kind <> 3 OR regexp_matches(coalesce(sha256, ''), '^[0-9a-f]{{64}}$') OR regexp_matches(coalesce(sha1, ''), '^[0-9a-f]{{40}}$') OR regexp_matches(coalesce(md5, ''), '^[0-9a-f]{{32}}$') OR regexp_matches(coalesce(crc32, ''), '^[0-9a-f]{{8}}$'))"""


@query(f"""{_LISTED}, smdb AS (SELECT DISTINCT game_id FROM formed WHERE kind = 3 AND name <> '')
SELECT game_id::VARCHAR AS path, CASE WHEN kind IN (0, 1, 5) THEN 'xml' WHEN kind IN (2, 4) THEN 'cmpro' WHEN game_id IN (SELECT game_id FROM smdb) THEN 'smdb' END AS format,
  CASE kind WHEN 4 THEN 'unclosed quote' WHEN 5 THEN 'broken XML' WHEN 3 THEN CASE WHEN game_id NOT IN (SELECT game_id FROM smdb) THEN 'no known format' END END AS error FROM g""")
def sniffed_catalogs(spark, d):
    """Format and error of each catalog text."""
    return X.entries_of_texts(_catalog_texts(spark, d)).select("path", "format", "error").distinct()


@query(f"""{_LISTED} SELECT game_id::VARCHAR AS path, CASE kind WHEN 2 THEN replace(entry, '"', '''') WHEN 3 THEN regexp_replace(name, '([^/\\\\])\\.[^./\\\\]*$', '\\1') ELSE entry END AS entry, name, size,
  {', '.join(f"CASE WHEN kind = 3 THEN coalesce({x}, '') ELSE {x} END AS {x}" for x in Q._WIDTH)} FROM formed WHERE kind <= 3 AND (kind <> 3 OR name <> '')""")
def parsed_catalogs(spark, d):
    """Members of the catalogs that could be read, whatever their format."""
    read = X.entries_of_texts(_catalog_texts(spark, d)).where(F.col("error").isNull())
    flat = X.catalog_members(read)
    digests = [F.when(F.col(x) == "", F.lit("")).otherwise(F.col(x)).alias(x) for x in M.DIGESTS]
    return flat.where("kind = 'rom'").select("path", "entry", "name", "size", *digests)


@query(f"""{_LISTED}, smdb AS (SELECT DISTINCT game_id FROM formed WHERE kind = 3 AND name <> ''), h AS (SELECT g.*, e.dat_id FROM g JOIN entries e USING (game_id) WHERE kind < 3 OR game_id IN (SELECT game_id FROM smdb))
SELECT game_id::VARCHAR AS path, CASE WHEN kind < 2 THEN 'xml' WHEN kind = 2 THEN 'cmpro' ELSE 'smdb' END AS format, CASE kind WHEN 0 THEN 'set ' || dat_id WHEN 1 THEN 'list ' || dat_id WHEN 2 THEN 'made' ELSE game_id::VARCHAR END AS name,
  CASE kind WHEN 0 THEN 'made & kept' END AS description, CASE kind WHEN 0 THEN '1.0' END AS version FROM h""")
def catalog_headers(spark, d):
    """Names, descriptions and versions of the catalog texts that are whole."""
    return X.catalog_headers(_catalog_texts(spark, d).where(F.pmod(F.col("path").cast("bigint"), F.lit(6)) < 4))


# -- contents ---------------------------------------------------------------------------


def _documents(spark, d) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("binary").alias("body"))


_BODY = "SELECT doc_id, encode(text) AS body FROM documents WHERE text IS NOT NULL"
_DIGESTS = "md5({0}) AS md5, sha1({0}) AS sha1, sha256({0}) AS sha256"
_KINDS = ("zip", "tar", "gz", "bz2", "xz", "tar.gz")


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """An archive of each content, of a kind by its key."""
    for batch in batches:
        rows = []
        for key, body in zip(batch["doc_id"], batch["body"]):
            kind, body, out = _KINDS[key % len(_KINDS)], bytes(body), io.BytesIO()
            if kind == "zip":
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                    archive.writestr("d/inside.txt", body)
            elif kind.startswith("tar"):
                with tarfile.open(fileobj=out, mode="w:gz" if kind == "tar.gz" else "w") as archive:
                    info = tarfile.TarInfo("d/inside.txt")
                    info.size = len(body)
                    archive.addfile(info, io.BytesIO(body))
            else:
                out.write({"gz": gzip.compress, "bz2": bz2.compress, "xz": lzma.compress}[kind](body))
            rows.append((f"/packed/{key}.{kind}", out.getvalue()))
        yield pd.DataFrame(rows, columns=["path", "content"])


@query(f"""WITH b AS ({_BODY}) SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'zip' WHEN 1 THEN 'tar' WHEN 2 THEN 'gz' WHEN 3 THEN 'bz2' WHEN 4 THEN 'xz' ELSE 'tar' END AS archive,
  CASE WHEN doc_id % 6 IN (0, 1, 5) THEN 'd/inside.txt' ELSE doc_id::VARCHAR END AS entry_path, octet_length(body)::BIGINT AS size, {_DIGESTS.format('body')} FROM b""")
def archived_texts(spark, d):
    """Members of archives of six kinds, with the digests of their contents."""
    packed = _documents(spark, d).mapInPandas(_packed, "path string, content binary")
    return A.expand_archives(packed).select(F.regexp_extract("path", r"(\d+)\.[a-z0-9.]+$", 1).cast("bigint").alias("doc_id"), "archive", "entry_path", "size", "md5", "sha1", "sha256")


def _headered(spark, d) -> DataFrame:
    """Contents behind one of the known headers, or behind none, by the key."""
    made = F.lit(b"").cast("binary")
    for i, (_, offset, value, data, _, _) in enumerate(A.HEADERS):
        head = bytes(offset).hex() + value
        head = head[: data * 2].ljust(data * 2, "0") if i != 4 else "FF" * offset + value
        made = F.when(F.pmod("doc_id", F.lit(8)) == i, F.unhex(F.lit(head.ljust(data * 2, "0")))).otherwise(made)
    return _documents(spark, d).select("doc_id", F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".bin")).alias("path"), F.concat(made, F.col("body")).alias("content"))


_HEADER_NAMES = ", ".join(f"'{h[0]}'" for h in A.HEADERS)


@query(f"""WITH b AS ({_BODY}) SELECT doc_id, [{_HEADER_NAMES}][doc_id % 8 + 1] AS header, CASE WHEN doc_id % 8 < 7 THEN md5(body) END AS md5_headerless, CASE WHEN doc_id % 8 < 7 THEN sha256(body) END AS sha256_headerless FROM b""")
def headerless_texts(spark, d):
    """Headers of contents, and digests of what is behind them."""
    rows = A.with_headerless(_headered(spark, d), always=True)
    return rows.select("doc_id", F.col("header.name").alias("header"), "md5_headerless", "sha256_headerless")


@query(f"""WITH b AS ({_BODY}), p AS (SELECT *, octet_length(body)::BIGINT AS n FROM b), f AS (SELECT *, (2 ** ceil(log2(n)))::BIGINT AS full_size FROM p WHERE n > 0 AND (n & (n - 1)) <> 0 AND doc_id % 3 = 0)
SELECT doc_id, full_size AS padded_size, 255 AS fill, md5(body || repeat('\\xFF'::BLOB, full_size - n)) AS md5 FROM f UNION ALL SELECT doc_id, full_size, 0, md5(body || repeat('\\x00'::BLOB, full_size - n)) FROM f""")
def padded_texts(spark, d):
    """Digests of trimmed contents, filled up to the next power of two; every third content counts as trimmed."""
    rows = A.with_paddings(_documents(spark, d).withColumnRenamed("body", "content"), F.pmod("doc_id", F.lit(3)) == 0)
    return rows.select("doc_id", F.explode("paddings").alias("p")).select("doc_id", "p.padded_size", "p.fill", "p.md5")


_SIGNED = [s for s in A.SIGNATURES]
_RIGHT = "[" + ", ".join(f"'{e}'" for e, _ in _SIGNED) + "]"


@query(f"""WITH b AS ({_BODY}) SELECT doc_id, {_RIGHT}[doc_id % {len(_SIGNED)} + 1] AS extension FROM b""")
def signed_texts(spark, d):
    """Kinds of contents by their signatures."""
    made = F.lit(b"").cast("binary")
    for i, (_, pieces) in enumerate(_SIGNED):
        head = bytearray()
        for offset, value in pieces:
            head += b"." * (offset - len(head)) + bytes.fromhex(value)
        made = F.when(F.pmod("doc_id", F.lit(len(_SIGNED))) == i, F.unhex(F.lit(bytes(head).hex()))).otherwise(made)
    return _documents(spark, d).select("doc_id", A.detect_signature(F.concat(made, F.lit(b"\x20"), F.col("body"))).alias("extension"))


def _patching(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        kinds = ("ips", "ips32", "ups", "bps")
        rows = [(key, bytes(body), f"p.{kinds[key % 4]}", H.appending_patch(kinds[key % 4], bytes(body), b"!patched")) for key, body in zip(batch["doc_id"], batch["body"])]
        yield pd.DataFrame(rows, columns=["id", "source", "path", "patch"])


@query(f"""WITH b AS ({_BODY}) SELECT doc_id, (octet_length(body) + 8)::BIGINT AS size, md5(body || '!patched'::BLOB) AS md5, NULL::VARCHAR AS error FROM b""")
def patched_texts(spark, d):
    """Contents after patches of four formats that append to them."""
    pairs = _documents(spark, d).mapInPandas(_patching, "id bigint, source binary, path string, patch binary")
    return H.patched_contents(pairs).select(F.col("id").alias("doc_id"), "size", F.md5("content").alias("md5"), "error")


@query(f"""WITH b AS ({_BODY}), k AS (SELECT *, row_number() OVER (PARTITION BY body, doc_id % 4 ORDER BY '/p/' || doc_id) AS rn FROM b WHERE doc_id % 4 >= 2)
SELECT doc_id, CASE doc_id % 4 WHEN 2 THEN 'ups' ELSE 'bps' END AS format, (octet_length(body) + 8)::BIGINT AS size_after FROM k WHERE rn = 1""")
def patch_trailers(spark, d):
    """Format and target size of patches that tell them; equal patches once."""
    rows = _documents(spark, d).where(F.pmod("doc_id", F.lit(4)) >= 2).mapInPandas(_patching, "id bigint, source binary, path string, patch binary")
    files = rows.select(F.concat(F.lit("/p/"), F.col("id").cast("string")).alias("path"), F.col("patch").alias("content"))
    return H.read_patches(files).select(F.substring("path", 4, 20).cast("bigint").alias("doc_id"), "format", "size_after")


_PATCHES = """p AS (SELECT DISTINCT relative AS path, lower(trim(crc32)) AS crc_before, substring(sha1, 1, 8) AS crc_after FROM file_records_mirror WHERE crc32 IS NOT NULL AND regexp_matches(trim(crc32), '^[0-9a-f]{8}$'))"""


@query(f"""{Q._ALL}, {_PATCHES}, t AS (SELECT m.rom_id, m.crc32, m.name FROM members m JOIN matches USING (rom_id))
SELECT rom_id, crc32, name, false AS patched, NULL AS patch FROM t
UNION ALL SELECT rom_id, crc_after, {"regexp_replace(regexp_extract(path, '([^/\\\\]*)$', 1), '(.)\\.[^.]*$', '\\1')"} || regexp_extract(name, '(\\.[^./\\\\]*)$', 1), true, path FROM t JOIN p ON p.crc_before = lower(t.crc32)""")
def patch_candidates(spark, d):
    """Matched members and what patches would make of them; files of the mirror stand for patches."""
    matched = Q._members(spark, d).join(Q._matches(spark, d).select(F.col("rom_id").alias("h")), F.col("rom_id") == F.col("h")).select("rom_id", "crc32", "name")
    mirror = table(spark, d, "file_records_mirror").where(F.trim("crc32").rlike("^[0-9a-f]{8}$"))
    patches = mirror.select(F.col("relative").alias("path"), F.lower(F.trim("crc32")).alias("crc_before"), F.substring("sha1", 1, 8).alias("crc_after"), F.lit(None).cast("bigint").alias("size_after")).distinct()
    return M.patch_candidates(matched, patches)


@query(f"""WITH f AS (SELECT DISTINCT file_id, source || '/' || relative AS path, size, scanned_at AS mtime, md5, sha1 FROM file_records),
c AS (SELECT path, size, mtime, min(md5) AS md5, min(sha1) AS sha1 FROM (SELECT DISTINCT source || '/' || relative AS path, size, scanned_at AS mtime, md5, sha1 FROM file_records_mirror) GROUP BY 1, 2, 3)
SELECT file_id, coalesce(f.md5, c.md5) AS md5, coalesce(f.sha1, c.sha1) AS sha1 FROM f LEFT JOIN c ON c.path = f.path AND c.size = f.size AND c.mtime = f.mtime""")
def cached_digests(spark, d):
    """Missing digests of scanned files taken from a cache of the same path, size and time; the mirror is the cache."""
    path = F.concat("source", F.lit("/"), "relative").alias("path")
    files = table(spark, d, "file_records").select("file_id", path, "size", F.col("scanned_at").alias("mtime"), "md5", "sha1").distinct()
    cache = table(spark, d, "file_records_mirror").groupBy(path, "size", F.col("scanned_at").alias("mtime")).agg(F.min("md5").alias("md5"), F.min("sha1").alias("sha1"))
    return M.fill_from_cache(files, cache, ("md5", "sha1")).select("file_id", "md5", "sha1")


@query("""SELECT cache_id, nullif(lower(regexp_extract(json, '(?:^|[^0-9a-fA-F])([0-9a-fA-F]{40})(?:[^0-9a-fA-F]|$)', 1)), '') AS sha1, nullif(lower(regexp_extract(json, '(?:^|[^0-9a-fA-F])([0-9a-fA-F]{32})(?:[^0-9a-fA-F]|$)', 1)), '') AS md5 FROM igdb_cache""")
def json_digests(spark, d):
    """Digests anywhere in cached answers."""
    return R.digests_in_json(table(spark, d, "igdb_cache"), "cache_id", "json")


# -- sinks --------------------------------------------------------------------------------

_FLAGS = ", ".join(f'CAST({Q._flag_sql(w.lower())} AS VARCHAR) AS "{w}"' for w in S.REPORT[7:])


@query(f"""{Q._STATUS}, used AS (SELECT file_id, source || '/' || relative AS path, CASE WHEN file_id IN (SELECT file_id FROM matches) THEN 'used' WHEN identity IN (SELECT identity FROM files WHERE file_id IN (SELECT file_id FROM matches)) THEN 'duplicate' ELSE 'unused' END AS usage FROM files)
SELECT dat_id::VARCHAR AS "DAT Name", name AS "Game Name", status AS "Status", '' AS "ROM Files", 'false' AS "Patched", CAST({Q._BIOS} AS VARCHAR) AS "BIOS", CAST({Q._RETAIL} AS VARCHAR) AS "Retail Release", {_FLAGS} FROM status
UNION ALL SELECT '', '', upper(usage), path, {', '.join(["'false'"] * 13)} FROM used WHERE usage <> 'used'""")
def report_rows(spark, d):
    """The report: entries with their status, then files that no entry uses."""
    entries = Q._entries(spark, d, "dat_id", "name", "isbios", "category", "manufacturer")
    members, files = Q._members(spark, d, entries), Q._files(spark, d)
    matches = M.tiered_match(members, files)
    usage = M.file_usage(files, matches).join(files.select(F.col("file_id").alias("p_id"), F.concat("source", F.lit("/"), "relative").alias("path")), F.col("file_id") == F.col("p_id"))
    return S.report_rows(M.entry_status(entries, members, matches).withColumn("files", F.lit("")), usage.select("path", "usage"))


@query(f"""{Q._ALL}, lacking AS (SELECT e.* FROM entries e WHERE game_id IN (SELECT game_id FROM members m WHERE kind <> 'disk' AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT dat_id, identity FROM members JOIN matches USING (rom_id)) p WHERE p.dat_id = m.dat_id AND p.identity = m.identity)))
SELECT l.dat_id, l.name, CASE WHEN EXISTS (SELECT 1 FROM lacking k WHERE k.dat_id = l.dat_id AND k.name = l.cloneof) THEN cloneof END AS cloneof, count(m.rom_id) AS roms, coalesce(sum(m.size), 0)::BIGINT AS bytes
FROM lacking l LEFT JOIN (SELECT * FROM members WHERE kind <> 'disk') m USING (game_id) GROUP BY ALL""")
def fixdat_xml(spark, d):
    """The catalog of entries that lack a member, written as XML elements and read back."""
    entries = Q._entries(spark, d, "dat_id", "name", "cloneof", "isbios", "description", "category", "manufacturer")
    members = Q._members(spark, d, entries)
    lacking = M.fixdat(entries, members, M.tiered_match(members, Q._files(spark, d)))
    rows = S.catalog_xml(lacking, members.where(F.col("kind") != "disk"))
    game = F.struct(*[c for c in rows.columns if c != "dat_id"])
    text = rows.select("dat_id", F.to_xml(game, {"rowTag": "game", "attributePrefix": "_"}).alias("xml"))
    back = text.select("dat_id", F.from_xml("xml", "_name string, _cloneof string, rom array<struct<_name:string,_size:bigint>>", {"attributePrefix": "_"}).alias("g"))
    size = F.aggregate(F.coalesce("g.rom", F.array()), F.lit(0).cast("bigint"), lambda a, r: a + F.coalesce(r["_size"], F.lit(0)))
    return back.select("dat_id", F.col("g._name").alias("name"), F.col("g._cloneof").alias("cloneof"), F.coalesce(F.size("g.rom"), F.lit(0)).cast("bigint").alias("roms"), size.alias("bytes"))


@query(f"""{Q._STATUS}, c AS (SELECT dat_id, count(*) AS entries, count(*) FILTER (status = 'FOUND') AS found FROM status GROUP BY 1)
SELECT printf('%d: %d/%d games found (%.1f%%)', dat_id, found, entries, round(found * 100.0 / entries, 1)) AS line FROM c""")
def summary_lines(spark, d):
    """A line for each catalog with its share of entries found."""
    return S.summary_lines(Q.status_counts(spark, d).where("kind = 'games'"))


@query(f"""{Q._PLAN} SELECT count(*) AS members, count(DISTINCT game_id) AS entries, coalesce(sum(size), 0)::BIGINT AS bytes FROM outs""")
def plan_summary(spark, d):
    """Members, entries and bytes of the plan."""
    return S.run_summary(Q._plan(spark, d), Q.skip_breakdown(spark, d)).select("members", "entries", F.col("bytes").cast("bigint").alias("bytes"))


# -- discs and inferred catalogs ----------------------------------------------------------

_CUES = r"""f AS (SELECT DISTINCT file_id, source, relative, regexp_extract(relative, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(relative, '([^/]*)$', 1) AS base FROM file_records),
loose AS (SELECT * FROM f WHERE folder <> '' AND NOT regexp_matches(relative, '(?i)\.(zip|zipx|tar|tgz|gz|rar|7z|z|cso|dax|zso|gcz|rvz|wia|chd)$')),
sheets AS (SELECT source, folder, source || '/' || folder || CASE WHEN length(folder) % 2 = 0 THEN '/set.cue' ELSE '/set.gdi' END AS sheet FROM loose GROUP BY ALL)"""


def _sheets(spark, d) -> tuple[DataFrame, DataFrame]:
    """Loose files below folders with a sheet for each folder, cue or gdi, that lists its files but the last by name."""
    files = table(spark, d, "file_records").select("file_id", "source", "relative").distinct()
    folder = F.regexp_extract("relative", r"^(.*)/[^/]*$", 1)
    loose = files.withColumn("folder", folder).where((folder != "") & ~F.col("relative").rlike(M.ARCHIVE_PATTERN))
    listed = loose.groupBy("source", "folder").agg(F.array_sort(F.collect_set(F.regexp_extract("relative", r"([^/]*)$", 1))).alias("b"))
    kept = F.slice("b", 1, F.greatest(F.size("b") - 1, F.lit(0)))
    cue = F.array_join(F.transform(kept, lambda x: F.concat(F.lit('FILE "'), x, F.lit('" BINARY'))), "\n")
    gdi = F.concat(F.size(kept).cast("string"), F.lit("\n"), F.array_join(F.transform(kept, lambda x, i: F.concat((i + 1).cast("string"), F.lit(' 0 4 2352 "'), x, F.lit('" 0'))), "\n"))
    even = F.length("folder") % 2 == 0
    sheets = listed.select(F.concat("source", F.lit("/"), "folder", F.when(even, "/set.cue").otherwise("/set.gdi")).alias("path"), F.when(even, cue).otherwise(gdi).alias("text"))
    return loose.select("file_id", F.concat("source", F.lit("/"), "relative").alias("path")), sheets


@query(f"""WITH {_CUES}, r AS (SELECT l.*, s.sheet, row_number() OVER (PARTITION BY l.source, l.folder ORDER BY base DESC) AS back, dense_rank() OVER (PARTITION BY l.source, l.folder ORDER BY base DESC) AS place FROM loose l JOIN sheets s USING (source, folder))
SELECT file_id, sheet FROM r WHERE place > 1""")
def disc_tracks(spark, d):
    """Files that disc sheets list, with their sheet."""
    files, sheets = _sheets(spark, d)
    return P.sheet_files(sheets, files)
