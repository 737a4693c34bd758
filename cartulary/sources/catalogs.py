"""Catalog readers: XML of three dialects, CMPro text and SMDB tables, to one entry schema."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MEMBER = "struct<_name:string,_size:string,_crc:string,_md5:string,_sha1:string,_sha256:string,_status:string,_merge:string,_bios:string>"
_RELEASE = "array<struct<_name:string,_region:string,_language:string>>"
#: Explicit read schemas prune what is not read and keep names that look like numbers as text.
ENTRY_XML = (
    "_name string, _id string, _cloneof string, _romof string, _cloneofid string, _isbios string, _isdevice string, description string, "
    f"manufacturer string, category array<string>, release {_RELEASE}, rom array<{_MEMBER}>, disk array<{_MEMBER}>, device_ref array<struct<_name:string>>"
)
SOFTWARE_XML = (
    "_name string, _cloneof string, _romof string, description string, "
    f"part array<struct<dataarea:array<struct<rom:array<{_MEMBER}>>>,diskarea:array<struct<disk:array<{_MEMBER}>>>>>"
)
MEMBER = "struct<name:string,size:bigint,crc32:string,md5:string,sha1:string,sha256:string,status:string,merge:string,bios:string>"
ENTRY = (
    "path string, name string, id string, cloneof string, romof string, cloneofid string, isbios string, isdevice string, description string, "
    f"manufacturer string, category array<string>, release array<struct<name:string,region:string,language:string>>, members array<{MEMBER}>, "
    f"disks array<{MEMBER}>, device_refs array<string>"
)


def _members(column: Column) -> Column:
    def one(m):
        return F.struct(
            m["_name"].alias("name"), F.coalesce(m["_size"].try_cast("bigint"), F.lit(0)).alias("size"), m["_crc"].alias("crc32"), m["_md5"].alias("md5"),
            m["_sha1"].alias("sha1"), m["_sha256"].alias("sha256"), m["_status"].alias("status"), m["_merge"].alias("merge"), m["_bios"].alias("bios"))

    return F.coalesce(F.transform(column, one), F.from_json(F.lit("[]"), f"array<{MEMBER}>"))


def read_xml(spark: SparkSession, paths: str | list[str], tag: str = "game") -> DataFrame:
    """Entries of XML catalogs, one row per ``tag`` (game, machine), in the common schema."""
    rows = spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "_").schema(ENTRY_XML).load(paths)
    release = F.transform("release", lambda r: F.struct(r["_name"].alias("name"), r["_region"].alias("region"), r["_language"].alias("language")))
    return rows.select(
        F.input_file_name().alias("path"), F.col("_name").alias("name"), F.col("_id").alias("id"), F.col("_cloneof").alias("cloneof"), F.col("_romof").alias("romof"),
        F.col("_cloneofid").alias("cloneofid"), F.col("_isbios").alias("isbios"), F.col("_isdevice").alias("isdevice"), "description", "manufacturer", "category",
        release.alias("release"), _members(F.col("rom")).alias("members"), _members(F.col("disk")).alias("disks"),
        F.transform("device_ref", lambda r: r["_name"]).alias("device_refs"))


def read_datafile(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Entries of datafile or mame XML: ``game`` elements where a file has any, else its ``machine`` elements."""
    games, machines = read_xml(spark, paths, "game"), read_xml(spark, paths, "machine")
    have = games.select(F.col("path").alias("g_path")).distinct()
    return games.unionByName(machines.join(have, F.col("path") == F.col("g_path"), "left_anti"))


def read_softwarelist(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Entries of software lists: members of all data areas of all parts, and disks of all disk areas."""
    rows = spark.read.format("xml").option("rowTag", "software").option("attributePrefix", "_").schema(SOFTWARE_XML).load(paths)
    flat = lambda area, kind: F.flatten(F.transform(F.col("part"), lambda p: F.flatten(F.transform(F.coalesce(p[area], F.array()), lambda a: F.coalesce(a[kind], F.array())))))
    null = lambda n: F.lit(None).cast("string").alias(n)
    return rows.select(
        F.input_file_name().alias("path"), F.col("_name").alias("name"), null("id"), F.col("_cloneof").alias("cloneof"), F.col("_romof").alias("romof"), null("cloneofid"),
        null("isbios"), null("isdevice"), "description", null("manufacturer"), F.lit(None).cast("array<string>").alias("category"),
        F.lit(None).cast("array<struct<name:string,region:string,language:string>>").alias("release"), _members(flat("dataarea", "rom")).alias("members"),
        _members(flat("diskarea", "disk")).alias("disks"), F.lit(None).cast("array<string>").alias("device_refs"))


def read_smdb(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows of tab-separated catalogs: valid with a name and at least one well-formed digest; an entry per row."""
    rows = spark.read.schema("sha256 string, name string, sha1 string, md5 string, crc32 string, size string").option("sep", "\t").option("quote", "").csv(paths)
    widths = {"crc32": 8, "md5": 32, "sha1": 40, "sha256": 64}
    formed = [F.coalesce(F.col(d).rlike(f"^(0x)?[0-9a-fA-F]{{{w}}}$"), F.lit(False)) for d, w in widths.items()]
    valid = rows.where((F.length("name") > 0) & (formed[0] | formed[1] | formed[2] | formed[3]))
    stem = F.regexp_replace("name", r"(?<=[^/\\])\.[^./\\]*$", "")
    return valid.select(
        F.input_file_name().alias("path"), stem.alias("entry"), "name", F.coalesce(F.col("size").try_cast("bigint"), F.lit(0)).alias("size"), *[F.lower(d).alias(d) for d in widths]
    )


# -- CMPro text -----------------------------------------------------------------


def parse_cmpro(text: str) -> dict[str, list]:
    """Blocks of a CMPro text by tag: ``tag ( key value ... )``, nested, quoted, with backslash escapes.

    Every value is in a list, as tags can repeat.  An unclosed quote or bracket is a ValueError.
    """
    stack: list[tuple[dict[str, list], str | None]] = []
    here: dict[str, list] = {}
    key: str | None = None
    at, end = 0, len(text)
    while at < end:
        c = text[at]
        if c.isspace():
            at += 1
            continue
        if c == "(" and key is not None:
            stack.append((here, key))
            here, key, at = {}, None, at + 1
            continue
        if c == ")" and stack:
            outer, name = stack.pop()
            outer.setdefault(name, []).append(here)
            here, key, at = outer, None, at + 1
            continue
        if c == '"' and key is not None:
            stop = at + 1
            while stop < end and text[stop] != '"':
                stop += 2 if text[stop] == "\\" else 1
            if stop >= end:
                raise ValueError("unclosed quote")
            word, at = text[at + 1 : stop], stop + 1
        else:
            stop = at
            while stop < end and not text[stop].isspace():
                stop += 1
            word, at = text[at:stop], stop
        if key is None:
            key = word
        else:
            here.setdefault(key, []).append(word)
            key = None
    if stack:
        raise ValueError("unclosed bracket")
    return here


def _cmpro_entry(block: dict[str, list]) -> dict:
    def one(value: dict[str, list], name: str):
        found = value.get(name)
        return found[0] if found and isinstance(found[0], str) else None

    def member(m: dict[str, list]) -> dict:
        size = one(m, "size")
        return {"name": one(m, "name") or "", "size": int(size) if size and size.isdigit() else 0, "crc32": one(m, "crc"), "md5": one(m, "md5"), "sha1": one(m, "sha1"),
                "sha256": one(m, "sha256"), "status": one(m, "status"), "merge": one(m, "merge"), "bios": None}

    blocks = lambda k: [member(x) for x in block.get(k, []) if isinstance(x, dict)]
    releases = [{"name": one(r, "name"), "region": one(r, "region"), "language": one(r, "language")} for r in block.get("release", []) if isinstance(r, dict)]
    fields = {k: one(block, k) for k in ("id", "cloneof", "romof", "cloneofid", "isbios", "isdevice", "description", "manufacturer")}
    categories = [x for x in block.get("category", []) if isinstance(x, str)]
    return {"name": one(block, "name") or one(block, "comment"), **fields, "category": categories, "release": releases,
            "members": blocks("rom"), "disks": blocks("disk"), "device_refs": [x for x in block.get("device_ref", []) if isinstance(x, str)]}


_ORDER = "path name id cloneof romof cloneofid isbios isdevice description manufacturer category release members disks device_refs".split()
#: Fixed value: how a CMPro text begins a block.
CMPRO_MARK = r"(?m)^(clrmamepro|game|resource) \("


def cmpro_entries(texts: DataFrame) -> DataFrame:
    """Entries of CMPro ``texts`` (``path, value``), with ``error``; a text that does not parse is one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["value"]):
                try:
                    blocks = parse_cmpro(text)
                except ValueError as problem:
                    rows.append(dict.fromkeys(_ORDER) | {"path": path, "error": str(problem)})
                    continue
                rows += [{"path": path, "error": None, **_cmpro_entry(b)} for tag in ("game", "resource") for b in blocks.get(tag, []) if isinstance(b, dict)]
            if rows:
                yield pd.DataFrame(rows)[[*_ORDER, "error"]]

    return texts.select("path", "value").mapInPandas(run, ENTRY + ", error string")


def read_cmpro(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Entries of CMPro files, with ``error``; files that do not look like one give no rows."""
    texts = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return cmpro_entries(texts.where(F.col("value").rlike(CMPRO_MARK)))


def smdb_lines(value: Column) -> Column:
    """The valid lines of a tab-separated catalog as ``struct(name, size, crc32, md5, sha1, sha256)``."""
    widths = {"sha256": (0, 64), "sha1": (2, 40), "md5": (3, 32), "crc32": (4, 8)}

    def line(parts: Column) -> Column:
        return F.struct(F.get(parts, 1).alias("name"), F.coalesce(F.get(parts, 5).try_cast("bigint"), F.lit(0)).alias("size"), *[F.lower(F.get(parts, i)).alias(d) for d, (i, _) in widths.items()])

    def valid(x: Column) -> Column:
        formed = [F.coalesce(x[d].rlike(f"^(0x)?[0-9a-f]{{{w}}}$"), F.lit(False)) for d, (_, w) in widths.items()]
        return (F.length(x["name"]) > 0) & (formed[0] | formed[1] | formed[2] | formed[3])

    return F.filter(F.transform(F.split(value, r"\r?\n"), lambda r: line(F.split(r, "\t"))), valid)


_SOFTWARE_LIST = SOFTWARE_XML.replace(" string", ":string").replace(" array", ":array").replace(", ", ",")
_ENTRY_LIST = ENTRY_XML.replace(" string", ":string").replace(" array", ":array").replace(", ", ",")


def sniffed(texts: DataFrame) -> DataFrame:
    """``texts`` (``path, value``) with ``format``: xml, cmpro, smdb, or null where none can be told."""
    body = F.regexp_replace(F.regexp_replace(F.col("value"), r"^\ufeff", ""), r"(?s)^(\s|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^\[>]*(\[.*?\]\s*)?>)+", "")
    root = F.regexp_extract(body, r"^<([A-Za-z]+)[\s/>]", 1)
    kind = (
        F.when(root.isin("datafile", "mame", "softwarelists", "softwarelist"), "xml").when(F.col("value").rlike(CMPRO_MARK), "cmpro")
        .when(F.size(smdb_lines(F.col("value"))) > 0, "smdb")
    )
    return texts.select("path", "value", kind.alias("format"), F.when(root != "", root).alias("root"))


def entries_of_texts(texts: DataFrame) -> DataFrame:
    """Entries of catalog ``texts`` (``path, value``) of any format, tried as XML, then CMPro, then SMDB, with ``format`` and ``error``.

    A text that is none of them, or is broken, is one row with its error.  ``game``
    elements stand before ``machine`` elements, and a line of an SMDB is an entry of one
    member.  Of a text each format is parsed at most once; catalogs of many gigabytes
    are better read by ``read_datafile``, which splits them by their elements.
    """
    known = sniffed(texts)
    schema = f"struct<game:array<struct<{_ENTRY_LIST}>>,machine:array<struct<{_ENTRY_LIST}>>,software:array<struct<{_SOFTWARE_LIST}>>,softwarelist:array<struct<software:array<struct<{_SOFTWARE_LIST}>>>>,_broken:string>"
    options = {"attributePrefix": "_", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    read = known.where(F.col("format") == "xml").withColumn("x", F.from_xml("value", schema, options))
    null = lambda kind: F.lit(None).cast(kind)
    fields = ENTRY.split(", ", 1)[1]
    release = lambda e: F.transform(e["release"], lambda r: F.struct(r["_name"].alias("name"), r["_region"].alias("region"), r["_language"].alias("language")))

    def entry(e: Column) -> Column:
        return F.struct(
            e["_name"].alias("name"), e["_id"].alias("id"), e["_cloneof"].alias("cloneof"), e["_romof"].alias("romof"), e["_cloneofid"].alias("cloneofid"), e["_isbios"].alias("isbios"),
            e["_isdevice"].alias("isdevice"), e["description"].alias("description"), e["manufacturer"].alias("manufacturer"), e["category"].alias("category"), release(e).alias("release"),
            _members(e["rom"]).alias("members"), _members(e["disk"]).alias("disks"), F.transform(e["device_ref"], lambda r: r["_name"]).alias("device_refs"))

    def software(e: Column) -> Column:
        flat = lambda area, kind: F.flatten(F.transform(F.coalesce(e["part"], F.array()), lambda p: F.flatten(F.transform(F.coalesce(p[area], F.array()), lambda a: F.coalesce(a[kind], F.array())))))
        return F.struct(
            e["_name"].alias("name"), null("string").alias("id"), e["_cloneof"].alias("cloneof"), e["_romof"].alias("romof"), null("string").alias("cloneofid"), null("string").alias("isbios"),
            null("string").alias("isdevice"), e["description"].alias("description"), null("string").alias("manufacturer"), null("array<string>").alias("category"),
            null("array<struct<name:string,region:string,language:string>>").alias("release"), _members(flat("dataarea", "rom")).alias("members"),
            _members(flat("diskarea", "disk")).alias("disks"), null("array<string>").alias("device_refs"))

    lists = F.concat(F.coalesce("x.software", F.array()), F.flatten(F.transform(F.coalesce("x.softwarelist", F.array()), lambda l: F.coalesce(l["software"], F.array()))))
    own = F.when(F.size("x.game") > 0, F.col("x.game")).otherwise(F.coalesce("x.machine", F.array()))
    listed = F.when(F.col("root").isin("datafile", "mame"), F.transform(own, entry)).otherwise(F.transform(lists, software))
    broken = F.col("x").isNull() | F.col("x._broken").isNotNull()
    of_xml = read.where(~broken).select("path", F.inline(listed), null("string").alias("error"), "format")
    bad = read.where(broken).select("path", "format", F.lit("broken XML").alias("error")).unionByName(known.where(F.col("format").isNull()).select("path", "format", F.lit("no known format").alias("error")))
    names = [f.split(" ", 1)[0] for f in _fields(fields)]
    of_cmpro = cmpro_entries(known.where(F.col("format") == "cmpro")).withColumn("format", F.lit("cmpro"))
    lines = known.where(F.col("format") == "smdb").select("path", "format", F.explode(smdb_lines(F.col("value"))).alias("l"))
    member = F.struct(F.col("l.name").alias("name"), F.col("l.size").alias("size"), *[F.col(f"l.{d}").alias(d) for d in ("crc32", "md5", "sha1", "sha256")], *[null("string").alias(c) for c in ("status", "merge", "bios")])
    of_smdb = lines.select("path", F.regexp_replace("l.name", r"(?<=[^/\\])\.[^./\\]*$", "").alias("name"), F.array(member).alias("members"), F.array().cast(f"array<{MEMBER}>").alias("disks"), "format")
    out = of_xml
    for part in (of_cmpro, of_smdb, bad):
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select("path", "format", *names, "error")


def catalog_headers(texts: DataFrame) -> DataFrame:
    """``path, format, name, description, version`` of catalog ``texts`` (``path, value``) that have a header.

    An XML catalog is named by its header, by its build or by its list; of several lists
    the names are joined.  CMPro texts have a block of their own, lines of an SMDB none,
    so its name is that of the file.  Broken headers give null fields.
    """
    known = sniffed(texts)
    one = "struct<_name:string,_description:string>"
    schema = f"struct<header:struct<name:string,description:string,version:string>,_build:string,_name:string,_description:string,softwarelist:array<{one}>>"
    x = F.from_xml("value", schema, {"attributePrefix": "_", "mode": "PERMISSIVE"})
    listed = F.array_join(F.transform("x.softwarelist", lambda l: l["_name"]), ", ")
    name = F.coalesce("x.header.name", "x._build", "x._name", F.nullif(listed, F.lit("")))
    of_xml = known.where(F.col("format") == "xml").withColumn("x", x).select(
        "path", "format", F.trim(name).alias("name"), F.coalesce("x.header.description", "x._description").alias("description"), F.col("x.header.version").alias("version"))
    block = F.regexp_extract("value", r'(?s)clrmamepro \(((?:[^()"]|"(?:[^"\\]|\\.)*")*)\)', 1)

    def field(tag: str) -> Column:
        quoted = F.regexp_extract(block, rf'(?:^|\s){tag}\s+"((?:[^"\\]|\\.)*)"', 1)
        return F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(F.regexp_extract(block, rf'(?:^|\s){tag}\s+([^\s"]+)', 1), F.lit(""))).alias(tag)

    of_cmpro = known.where(F.col("format") == "cmpro").select("path", "format", *[field(t) for t in ("name", "description", "version")])
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    none = F.lit(None).cast("string")
    of_smdb = known.where(F.col("format") == "smdb").select("path", "format", stem.alias("name"), none.alias("description"), none.alias("version"))
    return of_xml.unionByName(of_cmpro).unionByName(of_smdb)


def scan_catalogs(spark: SparkSession, paths: str | list[str], include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """``(catalogs, entries)`` of files of any format: headers that pass the patterns, in the order of their names, and the entries of these files.

    Files that are no catalogs are among the entries as rows with their error.
    """
    texts = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), "value")
    kept = filter_catalogs(catalog_headers(texts), include, exclude)
    entries = entries_of_texts(texts)
    named = kept.select(F.col("path").alias("k_path")).distinct()
    return sort_catalogs(kept), entries.join(named, F.col("path") == F.col("k_path"), "left").where(F.col("k_path").isNotNull() | F.col("error").isNotNull()).drop("k_path")


def _fields(schema: str) -> list[str]:
    """The fields of a schema text, commas inside brackets aside."""
    out, depth, start = [], 0, 0
    for at, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:at].strip())
            start = at + 1
    return [*out, schema[start:].strip()]


def catalog_members(entries: DataFrame) -> DataFrame:
    """Members and disks of read entries as flat rows ``path, entry, kind, ord, ...``."""
    def part(column: str, kind: str) -> DataFrame:
        rows = entries.select("path", F.col("name").alias("entry"), F.posexplode(column).alias("ord", "m"))
        return rows.select("path", "entry", F.lit(kind).alias("kind"), "ord", "m.*")

    return part("members", "rom").unionByName(part("disks", "disk"))


def filter_catalogs(catalogs: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Catalogs (``name, description``) by patterns of either; a null description passes an inclusion by name alone."""
    hit = lambda patterns: F.coalesce(F.greatest(*[F.coalesce(F.col(c).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False)) for c in ("name", "description")]), F.lit(False))
    kept = catalogs.where(hit(include)) if include else catalogs
    return kept.where(~hit(exclude)) if exclude else kept


def sort_catalogs(catalogs: DataFrame) -> DataFrame:
    """Catalogs in the order of their names as people sort them."""
    return catalogs.orderBy(F.collate("name", "UNICODE"))
