"""Queries of the general problems 3 to 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions.digests import hex_number
from cartulary.operators.diff import compare_copies
from cartulary.operators.entries import in_force
from cartulary.operators.hierarchy import climb, descendants, entry_links
from cartulary.operators.multivalue import LANGUAGES, TITLES, split_values
from cartulary.operators.nested import flatten_nodes, level_table
from cartulary.operators.references import catalog_references, orphan_references, orphan_report
from cartulary.session import table


#: Columns of p7_found.
P7_KEYS = ("raw_id", "root", "list_pos", "entry_tag", "entry_pos", "part_pos", "area_pos", "kind", "member_pos")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entry_links(in_force(table(spark, sf_dir, "games"), "dat_id", "name", "cloneof", "romof"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root and depth of each entry with a parent, by cloneof and by romof."""
    return climb(_links(spark, sf_dir)).select(
        F.col("tree").alias("link"), F.col("node").alias("game_id"), F.col("root").alias("root_id"), "depth"
    )


def p3_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p3_found, with so few links in a task that forests are merged over many partitions."""
    links = _links(spark, sf_dir)
    return climb(links, per_task=max(50, links.count() // 12)).select(
        F.col("tree").alias("link"), F.col("node").alias("game_id"), F.col("root").alias("root_id"), "depth")


def p3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path from the root of each entry whose climb ends."""
    done = climb(_links(spark, sf_dir), with_path=True).where(F.col("path").isNotNull())
    return done.select(F.col("tree").alias("link"), F.col("node").alias("game_id"), F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entry with every entry below it and the number of links between them."""
    below = descendants(climb(_links(spark, sf_dir), with_path=True))
    return below.select(F.col("tree").alias("link"), F.col("ancestor").alias("ancestor_id"), F.col("descendant").alias("game_id"), "distance")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of roms and file_records from their mirrors."""
    roms = compare_copies(table(spark, sf_dir, "roms"), table(spark, sf_dir, "roms_mirror"), "rom_id", {"name": None, "size": None})
    digests = {"size": None, "crc32": hex_number, "md5": hex_number, "sha1": hex_number, "sha256": hex_number}
    files = compare_copies(table(spark, sf_dir, "file_records"), table(spark, sf_dir, "file_records_mirror"), "file_id", digests)
    return roms.select(F.lit("roms").alias("table_name"), "*").unionByName(files.select(F.lit("file_records").alias("table_name"), "*"))


def p4_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences counted by table, field and state."""
    return p4_found(spark, sf_dir).groupBy("table_name", "field", "state").agg(F.count("*").alias("rows"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title and language of the fields that hold two or more."""
    titles = split_values(table(spark, sf_dir, "games"), "game_id", "name", "dat_id", TITLES)
    languages = split_values(table(spark, sf_dir, "file_records"), "file_id", "derived_languages", "source", LANGUAGES)
    return titles.select(F.lit("games").alias("table_name"), "*").unionByName(languages.select(F.lit("file_records").alias("table_name"), "*"))


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    entries = in_force(table(spark, sf_dir, "games"), "dat_id", "name", "cloneof", "romof", "isbios")
    return catalog_references(entries, table(spark, sf_dir, "roms"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to entries and members that are missing, removed or delivered later."""
    return orphan_references(*_references(spark, sf_dir)).select("table_name", "field", "row_key", F.date_format("at", "yyyy-MM").alias("period"), "state")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, field, month and state."""
    return orphan_report(*_references(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of each rom and disk inside its catalog object: the keys of the member subtype tables."""
    return level_table(flatten_nodes(table(spark, sf_dir, "dat_objects")), "member").select(*P7_KEYS)


def p7_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roms and disks with the typed fields of their variant's table."""
    return level_table(flatten_nodes(table(spark, sf_dir, "dat_objects")), "member").select(*P7_KEYS, "variant", "name", "size", "status", "merge", "crc", "md5", "sha1")


def p7_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists, entries, parts and areas with the keys that tie them to their parents, and their names."""
    nodes = flatten_nodes(table(spark, sf_dir, "dat_objects")).where(F.col("level") != "member")
    return nodes.select(*[c for c in P7_KEYS if c not in ("kind", "member_pos")], "area_tag", "level", "variant", F.try_element_at("fields", F.lit("name")).alias("name"))


def p7_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of every level and structural variant, counted by root."""
    nodes = flatten_nodes(table(spark, sf_dir, "dat_objects"))
    return nodes.groupBy("root", "level", "variant").agg(F.count("*").alias("nodes"), F.count_distinct("raw_id").alias("texts"))


QUERIES = {
    f.__name__: f
    for f in (p3_found, p3_spread, p3_paths, p3_descendants, p4_found, p4_summary, p5_found, p6_found, p6_report, p7_found, p7_members, p7_holders, p7_variants)
}

_IN_FORCE = """
entries AS (SELECT game_id, dat_id, name, cloneof, romof, isbios, removed_at IS NOT NULL AS removed, delivered_at, first_delivered
  FROM (SELECT *, min(delivered_at) OVER (PARTITION BY game_id) AS first_delivered,
               row_number() OVER (PARTITION BY game_id ORDER BY delivered_at DESC) AS rn FROM games WHERE game_id IS NOT NULL)
  WHERE rn = 1)"""

_CLIMB = f"""
WITH RECURSIVE {_IN_FORCE},
refs AS (SELECT 'cloneof' AS link, game_id, dat_id, cloneof AS ref FROM entries WHERE NOT removed AND cloneof IS NOT NULL
  UNION ALL SELECT 'romof', game_id, dat_id, romof FROM entries WHERE NOT removed AND romof IS NOT NULL),
links AS (SELECT r.link, r.game_id AS child, min(p.game_id) AS parent FROM refs r JOIN entries p
  ON NOT p.removed AND p.dat_id = r.dat_id AND p.name = r.ref GROUP BY ALL),
climb(link, node, cur, path) AS (
  SELECT link, child, parent, [parent, child] FROM links
  UNION ALL
  SELECT c.link, c.node, l.parent, list_prepend(l.parent, c.path) FROM climb c JOIN links l ON l.link = c.link AND l.child = c.cur
  WHERE NOT list_contains(c.path[2:], c.cur)),
ends AS (SELECT c.* FROM climb c WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.link = c.link AND l.child = c.cur))
"""

_DIFF = {
    "roms": ("rom_id", {"name": "name", "size": "size"}),
    "file_records": ("file_id", {"size": "size"}
        | {d: f"""CASE WHEN trim({d}) <> '' THEN coalesce(nullif(ltrim(regexp_replace(lower(trim({d})), '^0x', ''), '0'), ''), '0') END"""
           for d in ("crc32", "md5", "sha1", "sha256")}),
}


def _diff_sql(table_name: str) -> str:
    key, fields = _DIFF[table_name]
    columns = ", ".join(f"{e} AS {f}" for f, e in fields.items())
    a = f"(SELECT DISTINCT {key} AS row_key, {columns} FROM {table_name})"
    b = f"(SELECT DISTINCT {key} AS row_key, {columns} FROM {table_name}_mirror)"
    out = [
        f"SELECT '{table_name}' AS table_name, row_key, '' AS field, 'only_first' AS state FROM {a} a WHERE NOT EXISTS (SELECT 1 FROM {table_name}_mirror m WHERE m.{key} = a.row_key)",
        f"SELECT '{table_name}', row_key, '', 'only_mirror' FROM {b} b WHERE NOT EXISTS (SELECT 1 FROM {table_name} m WHERE m.{key} = b.row_key)",
    ]
    out += [f"SELECT '{table_name}', row_key, '{f}', 'differs' FROM {a} a JOIN {b} b USING (row_key) WHERE a.{f} IS DISTINCT FROM b.{f}" for f in fields]
    return "\nUNION ALL ".join(out)


_P4 = _diff_sql("roms") + "\nUNION ALL " + _diff_sql("file_records")

_P6 = f"""
WITH {_IN_FORCE},
r AS (SELECT DISTINCT rom_id, game_id, dat_id, merge, bios, delivered_at FROM roms),
refs AS (
  SELECT 'games' AS table_name, 'cloneof' AS field, game_id AS row_key, dat_id, cloneof AS ref, delivered_at FROM entries WHERE NOT removed AND cloneof <> ''
  UNION ALL SELECT 'games', 'romof', game_id, dat_id, romof, delivered_at FROM entries WHERE NOT removed AND romof <> ''
  UNION ALL SELECT 'roms', 'bios', rom_id, r.dat_id, bios, r.delivered_at FROM r LEFT JOIN entries o USING (game_id) WHERE bios <> '' AND NOT coalesce(o.removed, false)),
plain AS (
  SELECT f.table_name, f.field, f.row_key, f.delivered_at, t.game_id AS target, t.removed, t.first_delivered
  FROM refs f LEFT JOIN entries t ON t.dat_id = f.dat_id AND t.name = f.ref AND (f.field <> 'bios' OR t.isbios = 'yes')),
merged AS (
  SELECT 'roms' AS table_name, 'merge' AS field, rom_id AS row_key, r.delivered_at,
         CASE WHEN EXISTS (SELECT 1 FROM roms m WHERE m.game_id = t.game_id AND m.name = r.merge) THEN t.game_id END AS target, t.removed, t.first_delivered
  FROM r LEFT JOIN entries o USING (game_id) LEFT JOIN entries t ON t.dat_id = o.dat_id AND t.name = o.romof
  WHERE merge <> '' AND NOT coalesce(o.removed, false)),
cases AS (SELECT *, CASE WHEN target IS NULL THEN 'missing' WHEN removed THEN 'deleted' WHEN first_delivered > delivered_at THEN 'late' END AS state
  FROM (SELECT * FROM plain UNION ALL SELECT * FROM merged))
"""



def _listed(value: str) -> str:
    return f"(CASE json_type({value}) WHEN 'ARRAY' THEN CAST({value} AS JSON[]) WHEN 'OBJECT' THEN [{value}] ELSE CAST([] AS JSON[]) END)"


def _given(*names: str) -> str:
    return "(" + " OR ".join(f"coalesce(json_extract_string(m, '$.{n}') <> '', false)" for n in names) + ")"


_KINDS = "(VALUES ('rom'), ('disk')) k(kind)"
_P7_NODES = f"""
WITH j AS (SELECT raw_id, CAST(raw AS JSON) AS d FROM dat_objects WHERE raw IS NOT NULL AND json_valid(raw)),
roots AS (SELECT raw_id, root, json_extract(d, '$.' || root) AS c FROM j, (VALUES ('datafile'), ('mame')) r(root)),
flat AS (SELECT raw_id, root, -1 AS list_pos, tag AS entry_tag, unnest(range(len(a))) AS entry_pos, unnest(a) AS e
  FROM (SELECT raw_id, root, tag, {_listed("json_extract(c, '$.' || tag)")} AS a FROM roots, (VALUES ('game'), ('machine')) t(tag) WHERE json_type(c) = 'OBJECT')),
lists AS (SELECT raw_id, 'softwarelist' AS root, -1 AS list_pos, json_extract(d, '$.softwarelist') AS c FROM j
  UNION ALL SELECT raw_id, 'softwarelists', unnest(range(len(a))), unnest(a) FROM (SELECT raw_id, {_listed("json_extract(d, '$.softwarelists.softwarelist')")} AS a FROM j WHERE json_type(d, '$.softwarelists') = 'OBJECT')),
soft AS (SELECT raw_id, root, list_pos, 'software' AS entry_tag, unnest(range(len(a))) AS entry_pos, unnest(a) AS e
  FROM (SELECT raw_id, root, list_pos, {_listed("json_extract(c, '$.software')")} AS a FROM lists WHERE json_type(c) = 'OBJECT')),
parts AS (SELECT * EXCLUDE (a, e), unnest(range(len(a))) AS part_pos, unnest(a) AS p FROM (SELECT *, {_listed("json_extract(e, '$.part')")} AS a FROM soft WHERE json_type(e) = 'OBJECT')),
areas AS (SELECT * EXCLUDE (a, p), unnest(range(len(a))) AS area_pos, unnest(a) AS h FROM (SELECT parts.*, area AS area_tag, {_listed("json_extract(p, '$.' || area)")} AS a FROM parts, (VALUES ('dataarea'), ('diskarea')) q(area) WHERE json_type(p) = 'OBJECT')),
holders AS (SELECT raw_id, root, list_pos, entry_tag, entry_pos, -1 AS part_pos, NULL AS area_tag, -1 AS area_pos, e AS h FROM flat WHERE json_type(e) = 'OBJECT'
  UNION ALL SELECT raw_id, root, list_pos, entry_tag, entry_pos, part_pos, area_tag, area_pos, h FROM areas WHERE json_type(h) = 'OBJECT'),
members AS (SELECT * EXCLUDE (a, h), unnest(range(len(a))) AS member_pos, unnest(a) AS m FROM (SELECT holders.*, kind, {_listed("json_extract(h, '$.' || kind)")} AS a FROM holders, {_KINDS})),
found AS (SELECT *, CASE WHEN {_given('md5', 'sha1', 'sha256')} THEN 'digested' WHEN {_given('crc')} THEN 'summed' ELSE 'plain' END AS variant FROM members WHERE json_type(m) = 'OBJECT' AND len(json_keys(m)) > 0)
"""
_P7_COLUMNS = "raw_id, root, list_pos::BIGINT AS list_pos, entry_tag, entry_pos::BIGINT AS entry_pos, part_pos::BIGINT AS part_pos, area_pos::BIGINT AS area_pos"
_P7 = f"{_P7_NODES} SELECT {_P7_COLUMNS}, kind, member_pos::BIGINT AS member_pos FROM found"
_TEXT = "json_extract_string({0}, '$.{1}')"
_SIZE = "lower(trim(json_extract_string(m, '$.size')))"
_P7_MEMBERS = f"""{_P7_NODES} SELECT {_P7_COLUMNS}, kind, member_pos::BIGINT AS member_pos, variant, {', '.join(f"{_TEXT.format('m', n)} AS {n}" for n in ('name', 'status', 'merge'))},
  CASE WHEN {_SIZE} LIKE '0x%' THEN try_cast({_SIZE} AS BIGINT) ELSE try_cast({_SIZE} AS BIGINT) END AS size,
  CASE WHEN variant <> 'plain' THEN {_TEXT.format('m', 'crc')} END AS crc, CASE WHEN variant = 'digested' THEN {_TEXT.format('m', 'md5')} END AS md5, CASE WHEN variant = 'digested' THEN {_TEXT.format('m', 'sha1')} END AS sha1 FROM found"""
_UP = ["raw_id", "root", "list_pos", "entry_tag", "entry_pos", "part_pos", "area_tag", "area_pos"]
_P7_HOLDERS = f"""{_P7_NODES},
area_rows AS (SELECT h.* EXCLUDE (h), 'area' AS level, CASE WHEN f.raw_id IS NULL THEN 'vacant' ELSE 'filled' END AS variant, {_TEXT.format('h', 'name')} AS name
  FROM holders h LEFT JOIN (SELECT DISTINCT {', '.join(_UP)} FROM found WHERE area_pos >= 0) f USING ({', '.join(_UP)}) WHERE h.area_pos >= 0),
part_rows AS (SELECT p.* EXCLUDE (p), NULL AS area_tag, -1 AS area_pos, 'part' AS level, CASE WHEN a.best IS NULL THEN 'alone' WHEN a.best = 'filled' THEN 'housed' ELSE 'hollow' END AS variant, {_TEXT.format('p', 'name')} AS name
  FROM parts p LEFT JOIN (SELECT {', '.join(_UP[:6])}, min(variant) AS best FROM area_rows GROUP BY ALL) a USING ({', '.join(_UP[:6])}) WHERE json_type(p) = 'OBJECT'),
set_rows AS (SELECT s.* EXCLUDE (e), -1 AS part_pos, NULL AS area_tag, -1 AS area_pos, 'entry' AS level, CASE WHEN p.full_ THEN 'composed' WHEN p.full_ IS NOT NULL THEN 'outlined' ELSE 'empty' END AS variant, {_TEXT.format('e', 'name')} AS name
  FROM soft s LEFT JOIN (SELECT {', '.join(_UP[:5])}, bool_or(variant = 'housed') AS full_ FROM part_rows GROUP BY ALL) p USING ({', '.join(_UP[:5])}) WHERE json_type(e) = 'OBJECT'),
entry_rows AS (SELECT f.* EXCLUDE (e), -1 AS part_pos, NULL AS area_tag, -1 AS area_pos, 'entry' AS level, CASE WHEN m.raw_id IS NULL THEN 'empty' ELSE 'direct' END AS variant, {_TEXT.format('e', 'name')} AS name
  FROM flat f LEFT JOIN (SELECT DISTINCT {', '.join(_UP[:5])} FROM found WHERE area_pos < 0) m USING ({', '.join(_UP[:5])}) WHERE json_type(e) = 'OBJECT'),
entries_ AS (SELECT * FROM set_rows UNION ALL BY NAME SELECT * FROM entry_rows),
list_rows AS (SELECT l.raw_id, l.root, l.list_pos, NULL AS entry_tag, -1 AS entry_pos, -1 AS part_pos, NULL AS area_tag, -1 AS area_pos, 'list' AS level,
    CASE WHEN x.full_ THEN 'stocked' WHEN x.full_ IS NOT NULL THEN 'listed' ELSE 'blank' END AS variant, {_TEXT.format('c', 'name')} AS name
  FROM (SELECT raw_id, root, list_pos, c FROM lists UNION ALL SELECT raw_id, root, -1, c FROM roots) l
  LEFT JOIN (SELECT raw_id, root, list_pos, bool_or(variant IN ('direct', 'composed')) AS full_ FROM entries_ GROUP BY ALL) x USING (raw_id, root, list_pos) WHERE json_type(c) = 'OBJECT'),
above AS (SELECT * FROM area_rows UNION ALL BY NAME SELECT * FROM part_rows UNION ALL BY NAME SELECT * FROM entries_ UNION ALL BY NAME SELECT * FROM list_rows)"""

ORACLE_SQL = {
    "p7_found": _P7,
    "p7_members": _P7_MEMBERS,
    "p7_holders": f"{_P7_HOLDERS} SELECT {_P7_COLUMNS}, area_tag, level, variant, name FROM above",
    "p7_variants": f"{_P7_HOLDERS} SELECT root, level, variant, count(*) AS nodes, count(DISTINCT raw_id) AS texts FROM (SELECT raw_id, root, level, variant FROM above UNION ALL SELECT raw_id, root, 'member', variant FROM found) GROUP BY 1, 2, 3",
    "p3_found": _CLIMB + """SELECT l.link, l.child AS game_id, coalesce(e.path[1], -1)::BIGINT AS root_id, coalesce(len(e.path) - 1, -1)::BIGINT AS depth
        FROM links l LEFT JOIN ends e ON e.link = l.link AND e.node = l.child""",
    "p3_spread": _CLIMB + """SELECT l.link, l.child AS game_id, coalesce(e.path[1], -1)::BIGINT AS root_id, coalesce(len(e.path) - 1, -1)::BIGINT AS depth
        FROM links l LEFT JOIN ends e ON e.link = l.link AND e.node = l.child""",
    "p3_paths": _CLIMB + "SELECT link, node AS game_id, array_to_string(path, '/') AS path FROM ends",
    "p3_descendants": _CLIMB + """SELECT link, path[i] AS ancestor_id, node AS game_id, (len(path) - i)::BIGINT AS distance
        FROM (SELECT *, unnest(range(1, len(path))) AS i FROM ends)""",
    "p4_found": _P4,
    "p4_summary": f'SELECT table_name, field, state, count(*) AS "rows" FROM ({_P4}) GROUP BY ALL',
    "p6_found": _P6 + "SELECT table_name, field, row_key, strftime(delivered_at, '%Y-%m') AS period, state FROM cases WHERE state IS NOT NULL",
    "p6_report": _P6 + "SELECT table_name, field, strftime(delivered_at, '%Y-%m') AS period, state, count(*) AS \"references\" FROM cases WHERE state IS NOT NULL GROUP BY ALL",
}
