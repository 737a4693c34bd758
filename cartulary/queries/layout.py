"""Queries of paths, archives, plans across catalogs and platforms, and the SQL that states them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions import names as N
from cartulary.functions import paths as L
from cartulary.functions.digests import normal_digest
from cartulary.operators import archives as A
from cartulary.operators import matching as M
from cartulary.operators import plan as P
from cartulary.operators import records as R
from cartulary.queries import reference as Q
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


_PATHS = "f AS (SELECT DISTINCT file_id, source, relative, source || '/' || relative AS path FROM file_records)"
_STEM = "regexp_replace(regexp_extract({0}, '([^/\\\\]*)$', 1), '(.)\\.[^.]*$', '\\1')"


def _paths(spark, d) -> DataFrame:
    return table(spark, d, "file_records").select("file_id", "source", "relative", F.concat("source", F.lit("/"), "relative").alias("path")).distinct()


_LEGAL = "regexp_replace(regexp_replace(replace({0}, ':', ';'), '[<>:\"|?*]', '_', 'g'), '[\\\\/]', '/', 'g')"


@query(f"""WITH n AS (SELECT game_id, name, manufacturer FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY delivered_at DESC) AS rn FROM games) WHERE rn = 1 AND removed_at IS NULL)
SELECT game_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(name), '-( +-)+', '- ', 'g'), '^[ -]+', ''), '[ -]+$', ''), '  +', ' ', 'g')) AS display,
  {_LEGAL.format("trim(trim(name) || CASE WHEN coalesce(manufacturer, '') <> '' THEN ' (' || manufacturer || ')' ELSE '' END || '.dat')")} AS file FROM n""")
def catalog_names(spark, d):
    """Display and file names, with the maker in place of a version."""
    rows = Q._entries(spark, d, "name", "manufacturer")
    return rows.select("game_id", L.display_name(F.col("name")).alias("display"), L.catalog_filename(F.col("name"), F.col("manufacturer")).alias("file"))


@query(f"""WITH {_PATHS} SELECT file_id, nullif(regexp_replace(trim(regexp_replace(regexp_replace(replace(replace(trim(relative), '/', '_'), '\\', '_'), '\\p{{Cc}}', '', 'g'), '^\\.+|\\.+$', '', 'g')), '^-+|-+$', '', 'g'), '') AS segment FROM f""")
def path_segments(spark, d):
    """Relative paths as single segments."""
    return _paths(spark, d).select("file_id", L.segment(F.col("relative")).alias("segment"))


@query(f"""WITH {_PATHS}, n AS (SELECT *, {_STEM.format('relative')} AS entry, CASE WHEN regexp_extract(path, '[^.]+((\\.[a-zA-Z0-9]+)+)$', 1) = '' THEN '.zip' ELSE regexp_extract(path, '[^.]+((\\.[a-zA-Z0-9]+)+)$', 1) END AS ext FROM f),
i AS (SELECT *, regexp_replace(ext, '\\.[^.]*$', '') AS inner_ FROM n)
SELECT file_id, CASE WHEN inner_ <> '' AND ends_with(entry, inner_) THEN substring(entry, 1, length(entry) - length(inner_)) || ext ELSE entry || ext END AS basename,
  CASE WHEN instr(relative, CASE WHEN regexp_extract(relative, '^(.*)/[^/]*$', 1) = '' THEN './' ELSE regexp_extract(relative, '^(.*)/[^/]*$', 1) || '/' END) > 0
    THEN regexp_extract(relative, '([^/]*)$', 1) ELSE relative END AS inside FROM i""")
def kept_names(spark, d):
    """Names of archives that stay archives, and paths of members inside them."""
    entry = N.file_stem(F.col("relative"))
    return _paths(spark, d).select("file_id", L.kept_basename(entry, F.col("path"), F.lit(".zip")).alias("basename"), L.entry_path(F.col("relative"), F.col("relative")).alias("inside"))


@query(f"""WITH {_PATHS}, m AS (SELECT file_id, regexp_replace(regexp_replace(path, '^/intake/shelf/?', ''), '^/intake/?', '') AS p FROM f)
SELECT file_id, CASE WHEN regexp_extract(p, '^(.*)/[^/]*$', 1) <> '' THEN regexp_extract(p, '^(.*)/[^/]*$', 1) WHEN p LIKE '/%' THEN '/' ELSE '.' END AS folder FROM m""")
def mirrored_folders(spark, d):
    """Folders of files relative to two overlapping input paths."""
    return _paths(spark, d).select("file_id", L.mirrored_folder(F.col("path"), ("/intake/shelf", "/intake")).alias("folder"))


@query(f"""WITH {_PATHS} SELECT file_id, path FROM f WHERE regexp_matches(path, '^/intake/(crate|shelf)/0[1-4]/([^/]+/)*[^/]*\\.(zip|7z)$') OR regexp_matches(path, '^/intake/spare/.*[Rr]ev[^/]*\\.bin$') OR path = '/intake/shelf/01/[x].bin'""")
def glob_files(spark, d):
    """Files that globs name."""
    globs = ("/intake/{crate,shelf}/0[1-4]/**/*.{zip,7z}", "/intake/spare/**[Rr]ev*.bin", "/intake/shelf/01/[x].bin")
    return _paths(spark, d).where(L.matches_globs(F.col("path"), globs)).select("file_id", "path")


_KEY = "CASE WHEN contains(lower(name), 'disc') THEN substring(name, 1, instr(lower(name), 'disc') - 1) WHEN contains(name, '(') THEN regexp_extract(name, '(?s)^(.*)\\(', 1) WHEN contains(name, '-') THEN regexp_extract(name, '(?s)^(.*)-', 1) ELSE name END"


@query(f"""WITH {Q._ENTRIES}, k AS (SELECT dat_id, name, trim(regexp_replace(regexp_replace(trim(lower(trim({_KEY}))), '-+$', ''), '_+$', '')) AS k FROM entries)
SELECT dat_id, upper(substring(k, 1, 1)) || substring(k, 2) AS title, count(*) AS parts, min(name) AS first_name, max(name) AS last_name FROM k GROUP BY 1, 2""")
def multi_file_sets(spark, d):
    """Entries of each catalog that look like parts of one set."""
    rows = Q._entries(spark, d, "dat_id", "name").select("dat_id", "name", L.multi_file_key(F.col("name")).alias("title"))
    return rows.groupBy("dat_id", "title").agg(F.count("*").alias("parts"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))


@query(f"""WITH {_PATHS}, p(prefix, label) AS (VALUES ('/intake', 'intake'), ('/intake/shelf', 'shelf'), ('/intake/shelf/0', 'shelf 0x'), ('/intake/sp', 'sp'))
SELECT file_id, coalesce(label, '') AS label FROM f LEFT JOIN p ON starts_with(path, prefix)""")
def prefix_assign(spark, d):
    """Every input path that a file's path starts with."""
    prefixes = spark.createDataFrame([("/intake", "intake"), ("/intake/shelf", "shelf"), ("/intake/shelf/0", "shelf 0x"), ("/intake/sp", "sp")], "prefix string, label string")
    return M.assign_by_prefix(_paths(spark, d), prefixes)


_CLONES = f"""{Q._ALL}, full_ AS (SELECT m.game_id FROM members m LEFT JOIN matches h USING (rom_id) GROUP BY 1 HAVING count(*) = count(h.rom_id)),
planned AS (SELECT DISTINCT game_id FROM full_)"""


@query(f"""{_CLONES}, have AS (SELECT e.* FROM entries e JOIN planned USING (game_id)),
asks AS (SELECT dat_id, game_id, cloneof AS missing FROM have WHERE cloneof IS NOT NULL
  UNION SELECT h.dat_id, h.game_id, h.romof FROM have h WHERE romof IS NOT NULL AND EXISTS (SELECT 1 FROM entries e WHERE e.dat_id = h.dat_id AND e.name = h.romof AND EXISTS (SELECT 1 FROM members m WHERE m.game_id = e.game_id AND m.kind <> 'disk')))
SELECT DISTINCT dat_id, game_id, missing FROM asks a WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.dat_id = a.dat_id AND h.name = a.missing)""")
def missing_dependencies(spark, d):
    """What the complete entries depend on and no plan has; romof stands for device references."""
    entries = Q._entries(spark, d, "dat_id", "name", "cloneof", "romof")
    members = Q._members(spark, d, entries)
    matches = M.tiered_match(members, Q._files(spark, d)).select(F.col("rom_id").alias("h_id"))
    counts = members.join(matches, F.col("rom_id") == F.col("h_id"), "left").groupBy("game_id").agg(F.count("*").alias("n"), F.count("h_id").alias("f"))
    devices = entries.where(F.col("romof").isNotNull()).select("game_id", F.col("romof").alias("device"))
    return A.missing_dependencies(entries, counts.where(F.col("n") == F.col("f")), "split", devices, members)


@query(f"""{Q._PLAN} SELECT game_id, rom_id, CASE WHEN kind = 'disk' THEN output ELSE 'catalog ' || dat_id || '.zip' END AS output, CASE WHEN kind <> 'disk' AND members > 1 THEN name || '/' || base ELSE base END AS entry_path FROM outs""")
def combined_plan(spark, d):
    """The plan of complete entries with each catalog as one archive."""
    names = Q._entries(spark, d, "dat_id").select("dat_id").distinct().select("dat_id", F.concat(F.lit("catalog "), F.col("dat_id").cast("string")).alias("dat_name"))
    return A.combined_plan(P.output_paths(Q._plan(spark, d)), names).select("game_id", "rom_id", "output", "entry_path")


_DIG = Q._WIDTH
_HEADLESS = f"""variants AS (SELECT f.*, h.size AS h_size, {', '.join(f'h.{x} AS h_{x}' for x in _DIG)} FROM files f LEFT JOIN
  (SELECT DISTINCT file_id, size, {', '.join(f'{Q._dig(x)} AS {x}' for x in _DIG)} FROM file_records_mirror) h USING (file_id)),
vk AS (SELECT 0 AS variant, * FROM ({Q._TIERS.format(id='file_id, container, source, relative', t='files')}) UNION ALL
  SELECT 1, file_id, container, source, relative, unnest([1, 2, 3, 4]), unnest([h_sha256, h_sha1, h_md5, h_crc32 || '|' || h_size::VARCHAR]) FROM variants)"""


@query(f"""WITH {Q._ENTRIES}, {Q._MEMBERS}, {Q._FILES}, {_HEADLESS},
vb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tier, key ORDER BY variant, container, source, relative, file_id) AS rn FROM vk WHERE key IS NOT NULL) WHERE rn = 1)
SELECT rom_id, file_id, tier, variant FROM (SELECT rom_id, file_id, tier, variant, row_number() OVER (PARTITION BY rom_id ORDER BY tier) AS rn FROM ({Q._TIERS.format(id='rom_id', t='members')}) k JOIN vb USING (tier, key)) WHERE rn = 1""")
def variant_match(spark, d):
    """The file of each member by raw digests, else by those of its variant, for which the mirror's digests stand."""
    return M.variant_match(Q._members(spark, d), _with_variants(spark, d))


def _with_variants(spark, d) -> DataFrame:
    mirror = table(spark, d, "file_records_mirror").select("file_id", "size", *M.DIGESTS).distinct()
    behind = mirror.select(F.col("file_id").alias("h_id"), F.col("size").alias("size_headerless"), *[normal_digest(F.col(x), x).alias(f"{x}_headerless") for x in M.DIGESTS])
    return Q._files(spark, d).join(behind, F.col("file_id") == F.col("h_id"), "left").drop("h_id")


_CONTENTS = "contents AS (SELECT *, CASE WHEN regexp_extract(relative, '^(.*)/[^/]*$', 1) <> '' THEN source || '/' || regexp_extract(relative, '^(.*)/[^/]*$', 1) END AS archive FROM files)"
_CHOICE = f"""WITH {Q._ENTRIES}, {Q._MEMBERS}, {Q._FILES}, {_CONTENTS},
ck AS (SELECT * FROM ({Q._TIERS.format(id='file_id, archive', t='contents')}) WHERE key IS NOT NULL),
mk AS (SELECT * FROM ({Q._TIERS.format(id='game_id, rom_id', t="(SELECT * FROM members WHERE kind <> 'disk')")}) WHERE key IS NOT NULL),
w AS (SELECT game_id, rom_id, tier, key FROM (SELECT *, row_number() OVER (PARTITION BY game_id, rom_id ORDER BY tier, key) AS rn FROM mk WHERE EXISTS (SELECT 1 FROM ck WHERE ck.tier = mk.tier AND ck.key = mk.key)) WHERE rn = 1),
n AS (SELECT game_id, count(DISTINCT rom_id) AS members FROM members WHERE kind <> 'disk' GROUP BY 1),
s AS (SELECT archive, count(DISTINCT file_id) AS held FROM contents WHERE archive IS NOT NULL GROUP BY 1),
a AS (SELECT DISTINCT tier, key, archive FROM ck WHERE archive IS NOT NULL),
m AS (SELECT game_id, archive, count(DISTINCT rom_id) AS found, count(DISTINCT (w.tier, w.key)) AS digests FROM w JOIN a USING (tier, key) GROUP BY 1, 2),
c AS (SELECT m.game_id, archive, members, held, greatest(held - digests, 0) AS excess, row_number() OVER (PARTITION BY m.game_id ORDER BY held, NOT lower(archive) LIKE '%.chd', NOT contains(regexp_extract(archive, '([^/]*)$', 1), e.name), archive) AS rn
  FROM m JOIN n ON n.game_id = m.game_id AND n.members = m.found JOIN s USING (archive) JOIN entries e ON e.game_id = m.game_id)
SELECT game_id, archive, members, held, excess FROM c WHERE rn = 1"""


def _contents(spark, d) -> DataFrame:
    folder = F.regexp_extract("relative", r"^(.*)/[^/]*$", 1)
    return Q._files(spark, d).withColumn("archive", F.when(folder != "", F.concat("source", F.lit("/"), folder)))


@query(_CHOICE)
def archive_choice(spark, d):
    """The archive that holds every member of an entry; folders stand for archives."""
    entries = Q._entries(spark, d, "dat_id", "name")
    return A.archive_choice(entries, Q._members(spark, d, entries), _contents(spark, d))


@query(f"""{Q._PLAN} SELECT rom_id, member FROM outs WHERE file_id IS NULL OR regexp_extract(relative, '^(.*)/[^/]*$', 1) = '' OR regexp_extract(relative, '([^/]*)$', 1) = member""")
def legal_inputs(spark, d):
    """Members of the plan that could be taken from archives as they are."""
    folder = F.regexp_extract("relative", r"^(.*)/[^/]*$", 1)
    plan = P.output_paths(Q._plan(spark, d)).withColumn("archive", F.when(folder != "", folder)).withColumn("inside", F.regexp_extract("relative", r"([^/]*)$", 1))
    return A.legal_inputs(plan, raw=True).select("rom_id", "member")


@query("""WITH p AS (SELECT token, name, abbreviation, row_number() OVER (ORDER BY token) AS ord FROM canonical_values WHERE kind = 'platform'),
v AS (SELECT DISTINCT derived_platform AS name FROM file_records WHERE derived_platform IS NOT NULL)
SELECT v.name, coalesce((SELECT arg_max(token, ord) FROM p WHERE regexp_matches(v.name, '(?i)\\Q' || p.name || '\\E')), (SELECT arg_min(token, ord) FROM p WHERE lower(p.abbreviation) = lower(v.name))) AS platform FROM v""")
def platform_lookup(spark, d):
    """Platforms of freely typed names by patterns, the last that fits; else by abbreviation, which stands for the extension."""
    known = table(spark, d, "canonical_values").where("kind = 'platform'").select(
        F.col("token").alias("ord"), F.col("token").alias("platform"), F.concat(F.lit("(?i)\\Q"), "name", F.lit("\\E")).alias("pattern"), F.array_compact(F.array("abbreviation")).alias("extensions"))
    names = table(spark, d, "file_records").select(F.col("derived_platform").alias("name")).where("name IS NOT NULL").distinct()
    return R.assign_platforms(names.withColumn("extension", F.col("name")), known).select("name", "platform")


@query(f"""{Q._PLAN}, t AS (SELECT *, coalesce(nullif(regexp_replace(regexp_extract(base, '(\\.[^.]*)$', 1), '^\\.', ''), ''), '-') AS ext FROM outs)
SELECT rom_id, {_LEGAL.format("'sets/catalog_' || dat_id || '/' || ext || '/' || CASE WHEN kind = 'disk' OR (members > 1 AND NOT regexp_matches(base, '" + "(?i)" + chr(92) + ".(zip|zipx|tar|tgz|gz|rar|7z|z|cso|dax|zso|gcz|rvz|wia|chd)$')) THEN name || '/' || base ELSE base END")} AS output, true AS valid FROM t
UNION ALL SELECT rom_id, {_LEGAL.format("'{pocket}/' || CASE WHEN kind = 'disk' OR (members > 1 AND NOT regexp_matches(base, '" + "(?i)" + chr(92) + ".(zip|zipx|tar|tgz|gz|rar|7z|z|cso|dax|zso|gcz|rvz|wia|chd)$')) THEN name || '/' || base ELSE base END")}, false FROM t""")
def token_paths(spark, d):
    """Output paths by catalog name and extension, and by a platform token that finds no value."""
    plan = Q._plan(spark, d).withColumn("dat_name", F.concat(F.lit("catalog/"), F.col("dat_id").cast("string")))
    parts = [P.output_paths(plan, template).select("rom_id", "output", "valid") for template in ("sets/{datName}/{outputExt}", "{pocket}")]
    return parts[0].unionByName(parts[1])


_INSIDE = "CASE WHEN kind = 'disk' OR (members > 1 AND NOT regexp_matches(base, '(?i)\\.(zip|zipx|tar|tgz|gz|rar|7z|z|cso|dax|zso|gcz|rvz|wia|chd)$')) THEN name || '/' || base ELSE base END"


@query(f"""{Q._PLAN}, {Q._LOCALE}, x AS (SELECT game_id, unnest(regions) AS region, languages FROM locale), y AS (SELECT game_id, region, unnest(languages) AS language FROM x)
SELECT DISTINCT o.game_id, rom_id, file_id, {_LEGAL.format("'out/' || region || '/' || language || '/' || " + _INSIDE)} AS output FROM outs o JOIN y ON y.game_id = o.game_id WHERE region <> '' AND language <> ''""")
def expanded_plan(spark, d):
    """The plan of complete entries with a path for each region and language."""
    return P.expanded_plan(Q._entries(spark, d, "name", "release", "category"), Q._plan(spark, d), "out/{region}/{language}")


@query("""SELECT DISTINCT file_id, CASE WHEN NOT coalesce(regexp_matches(relative, '(?i)\\.(zip|7z|bin)$'), false) THEN 'not included' WHEN coalesce(regexp_matches(relative, '\\[b[0-9]*\\]|\\(Proto'), false) THEN 'excluded' END AS reason FROM (SELECT DISTINCT file_id, relative FROM file_records)""")
def pattern_reasons(spark, d):
    """Why patterns leave files out."""
    return R.pattern_reasons(table(spark, d, "file_records").select("file_id", "relative").distinct(), (r"(?i)\.(zip|7z|bin)$",), (r"\[b[0-9]*\]", r"\(Proto"))


@query(f"""WITH {Q._ENTRIES}, {Q._MEMBERS}, {Q._FILES}, {_HEADLESS},
vb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tier, key ORDER BY variant, container, source, relative, file_id) AS rn FROM vk WHERE key IS NOT NULL) WHERE rn = 1),
vm AS (SELECT rom_id, file_id, variant FROM (SELECT rom_id, file_id, variant, row_number() OVER (PARTITION BY rom_id ORDER BY tier) AS rn FROM ({Q._TIERS.format(id='rom_id', t='members')}) k JOIN vb USING (tier, key)) WHERE rn = 1)
SELECT rom_id, {', '.join(f'CASE WHEN variant = 1 THEN h_{x} ELSE {x} END AS {x}' for x in ('size', *Q._WIDTH))} FROM vm JOIN variants USING (file_id)""")
def expected_outputs(spark, d):
    """Size and digests that each written member must have, by the variant of the file that was matched."""
    files = _with_variants(spark, d)
    return M.expected_outputs(M.variant_match(Q._members(spark, d), files), files)


@query(f"""{Q._PLAN}, a AS (SELECT *, CASE WHEN regexp_extract(relative, '^(.*)/[^/]*$', 1) <> '' THEN source || '/' || regexp_extract(relative, '^(.*)/[^/]*$', 1) END AS archive, regexp_extract(relative, '([^/]*)$', 1) AS inside FROM outs WHERE kind <> 'disk')
SELECT game_id, min(archive) AS archive FROM a GROUP BY 1 HAVING bool_and(archive IS NOT NULL AND coalesce(inside = member, false)) AND min(archive) = max(archive)""")
def raw_archives(spark, d):
    """Entries whose members all lie in one folder under their own names."""
    folder = F.regexp_extract("relative", r"^(.*)/[^/]*$", 1)
    plan = Q._plan(spark, d).withColumn("archive", F.when(folder != "", F.concat("source", F.lit("/"), folder))).withColumn("inside", F.regexp_extract("relative", r"([^/]*)$", 1))
    return A.raw_archives(plan)


@query(f"""{Q._ALL} SELECT DISTINCT source || '/' || relative AS path FROM files JOIN (SELECT DISTINCT file_id FROM matches) m USING (file_id) WHERE source || '/' || relative NOT IN (SELECT source || '/' || relative FROM file_records_mirror WHERE source IS NOT NULL AND relative IS NOT NULL)""")
def deletable_inputs(spark, d):
    """Matched inputs that could be deleted once moved; the mirror's paths stand for what was written."""
    path = F.concat("source", F.lit("/"), "relative").alias("path")
    files = Q._files(spark, d)
    moved = files.join(Q._matches(spark, d).select(F.col("file_id").alias("m_id")).distinct(), F.col("file_id") == F.col("m_id")).select(path).distinct()
    return M.deletable(moved.where(F.col("path").isNotNull()), table(spark, d, "file_records_mirror").select(path))


@query(f"""WITH {Q._ENTRIES}, {Q._MEMBERS}, b AS (SELECT dat_id, bit_or(CASE WHEN crc32 IS NOT NULL AND size IS NOT NULL THEN 1 WHEN md5 IS NOT NULL THEN 16 WHEN sha1 IS NOT NULL THEN 256 WHEN sha256 IS NOT NULL THEN 4096 ELSE 0 END)::INT AS need FROM members GROUP BY 1)
SELECT dat_id, CASE WHEN ((need | 16) & 17) = 0 THEN 1 ELSE ((need | 16) & 17) | 1 END AS patched, ((need & 17) | 273) AS inferred FROM b""")
def scanning_masks(spark, d):
    """Digest masks that a scan needs with patches (from MD5 up to MD5), and for a catalog made from files."""
    members = Q._members(spark, d)
    patched = M.required_digests(members, "md5", "md5", patches=True).withColumnRenamed("mask", "patched")
    inferred = M.required_digests(members, None, "md5", inferred=True).select(F.col("dat_id").alias("i"), F.col("mask").alias("inferred"))
    return patched.join(inferred, F.col("dat_id").eqNullSafe(F.col("i"))).drop("i")
