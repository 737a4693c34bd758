"""Queries of the catalog operators, and the SQL that states them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions import names as N
from cartulary.functions.digests import fingerprint, normal_digest
from cartulary.operators import catalog as C
from cartulary.operators import matching as M
from cartulary.operators import plan as P
from cartulary.operators import records as R
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


def _entries(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return C.catalog_entries(table(spark, d, "games"), *columns)


def _members(spark: SparkSession, d: str, entries: DataFrame | None = None) -> DataFrame:
    return C.catalog_members(table(spark, d, "roms"), entries if entries is not None else _entries(spark, d, "dat_id"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return M.scanned_files(table(spark, d, "file_records"))


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return M.tiered_match(_members(spark, d), _files(spark, d))


# -- shared SQL ---------------------------------------------------------------

_WIDTH = {"crc32": 8, "md5": 32, "sha1": 40, "sha256": 64}


def _dig(d: str) -> str:
    b = f"regexp_replace(lower(trim({d})), '^0x', '')"
    return f"CASE WHEN {b} = '' THEN NULL WHEN length({b}) < {_WIDTH[d]} THEN lpad({b}, {_WIDTH[d]}, '0') ELSE {b} END"


_IDENTITY = "coalesce(sha256, sha1, md5, coalesce(crc32, 'undefined') || '|' || coalesce(size::VARCHAR, '0'))"
_PRINT = "count(identity)::VARCHAR || '-' || sum(('0x' || substring(md5(identity), 1, 15))::BIGINT::DECIMAL(38,0))::VARCHAR || '-' || sum(('0x' || substring(md5(identity), 16, 15))::BIGINT::DECIMAL(38,0))::VARCHAR"
_ENTRIES = """entries AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY delivered_at DESC) AS rn FROM games) WHERE rn = 1 AND removed_at IS NULL)"""
_MEMBERS = f"""members AS (SELECT *, {_IDENTITY} AS identity FROM (SELECT DISTINCT rom_id, r.game_id, e.dat_id, ord, kind, r.name, size, {', '.join(f'{_dig(d)} AS {d}' for d in _WIDTH)}, status, merge, bios
  FROM roms r JOIN entries e USING (game_id)))"""
_RANK = "CASE WHEN NOT regexp_matches(relative, '(?i)\\.(zip|zipx|tar|tgz|gz|rar|7z|z|cso|dax|zso|gcz|rvz|wia|chd)$') THEN 0 ELSE coalesce(map {'zip': 1, 'tar': 2, 'rar': 3, '7z': 4, 'cso': 5, 'gcz': 6, 'rvz': 6, 'wia': 6, 'chd': 7}[lower(regexp_extract(relative, '\\.([A-Za-z0-9]+)$', 1))], 99) END"
_FILES = f"""files AS (SELECT *, {_IDENTITY} AS identity, {_RANK} AS container FROM (SELECT DISTINCT file_id, source, relative, size, {', '.join(f'{_dig(d)} AS {d}' for d in _WIDTH)} FROM file_records))"""
_TIERS = "SELECT {id}, unnest([1, 2, 3, 4]) AS tier, unnest([sha256, sha1, md5, crc32 || '|' || size::VARCHAR]) AS key FROM {t}"
_MATCHES = f"""fk AS (SELECT * FROM ({_TIERS.format(id='file_id, container, source, relative', t='files')}) WHERE key IS NOT NULL),
best AS (SELECT tier, key, file_id FROM (SELECT *, row_number() OVER (PARTITION BY tier, key ORDER BY container, source, relative, file_id) AS rn FROM fk) WHERE rn = 1),
matches AS (SELECT rom_id, file_id, tier FROM (SELECT rom_id, file_id, tier, row_number() OVER (PARTITION BY rom_id ORDER BY tier) AS rn
    FROM ({_TIERS.format(id='rom_id', t='members')}) k JOIN best USING (tier, key)) WHERE rn = 1)"""
_ALL = f"WITH {_ENTRIES},\n{_MEMBERS},\n{_FILES},\n{_MATCHES}\n"
_STATUS = f"""{_ALL}, per AS (SELECT m.game_id, count(*) AS members, count(h.rom_id) AS found FROM members m LEFT JOIN matches h USING (rom_id) GROUP BY 1),
status AS (SELECT e.*, coalesce(p.members, 0) AS members, coalesce(p.found, 0) AS found,
  CASE WHEN coalesce(p.found, 0) = coalesce(p.members, 0) THEN 'FOUND' WHEN p.found > 0 THEN 'INCOMPLETE' ELSE 'MISSING' END AS status FROM entries e LEFT JOIN per p USING (game_id))
"""


def _flag_sql(which: str) -> str:
    if which == "bad":
        return "(regexp_matches(name, '\\[b[0-9]*\\]') OR (NOT contains(name, '[!]') AND (contains(name, '[c]') OR contains(name, '[x]'))))"
    tests = [f"regexp_matches(name, '{N.FLAGS[which]}')"] if which in N.FLAGS else []
    if which in N.FLAG_CATEGORIES:
        tests.append(f"coalesce(list_contains(list_transform(category, lambda c: lower(c)), '{N.FLAG_CATEGORIES[which]}'), false)")
    if which in N.FLAG_MAKERS:
        tests.append(f"coalesce(contains(lower(manufacturer), '{N.FLAG_MAKERS[which]}'), false)")
    return "coalesce(" + " OR ".join(tests) + ", false)"


_BIOS = "(coalesce(isbios = 'yes', false) OR coalesce(regexp_matches(name, '(?i)\\[BIOS\\]'), false))"
_RETAIL = "NOT (" + " OR ".join(_flag_sql(w) for w in N.NOT_RETAIL) + ")"
_TYPE = f"CASE WHEN {_BIOS} THEN 'BIOS' WHEN contains(name, '[!]') THEN 'Retail' " + " ".join(
    f"WHEN {_flag_sql(w) if w != 'device' else 'coalesce(isdevice = ' + chr(39) + 'yes' + chr(39) + ', false)'} THEN '{label}'" for w, label in N.TYPE_ORDER) + " ELSE 'Retail' END"
_REVISION = r"""CASE WHEN regexp_extract(name, '(?i)\((?:Rev|Version)\s*([0-9.]+)\)', 1) <> '' THEN try_cast(regexp_extract(name, '(?i)\((?:Rev|Version)\s*([0-9.]+)\)', 1) AS DOUBLE)
  WHEN regexp_extract(name, '(?i)\(Rev\s*([A-Z])\)', 1) <> '' THEN (ascii(upper(regexp_extract(name, '(?i)\(Rev\s*([A-Z])\)', 1))) - 64)::DOUBLE
  WHEN regexp_extract(name, '(?i)\Wv([0-9]+\.[0-9]+)\W', 1) <> '' THEN try_cast(regexp_extract(name, '(?i)\Wv([0-9]+\.[0-9]+)\W', 1) AS DOUBLE)
  WHEN regexp_matches(name, '(?i)\(RE?-?[0-9]*\)') THEN CASE WHEN regexp_extract(name, '(?i)\(RE?-?([0-9]*)\)', 1) = '' THEN 1.0 ELSE try_cast(regexp_extract(name, '(?i)\(RE?-?([0-9]*)\)', 1) AS DOUBLE) END
  ELSE 0.0 END"""
_LONG = "|".join(N.REGION_NAMES)
_CODES = "map {" + ", ".join(f"'{long.lower()}': '{code}'" for code, long, _, _ in N.REGIONS) + "}"
_REGIONS = f"""CASE WHEN regexp_extract(name, '(?i)\\(((?:{_LONG})(?:, (?:{_LONG}))*)\\)', 1) <> ''
    THEN list_transform(string_split_regex(lower(regexp_extract(name, '(?i)\\(((?:{_LONG})(?:, (?:{_LONG}))*)\\)', 1)), ', ?'), lambda r: {_CODES}[r]) """ + " ".join(
    f"WHEN regexp_matches(name, '(?i)\\((?:{short})\\)') THEN ['{code}']" for code, _, _, short in N.REGIONS if short) + " ELSE coalesce(list_transform(list_filter(release, lambda r: r.region IS NOT NULL), lambda r: upper(r.region)), []) END"
_KNOWN_L = "[" + ", ".join(f"'{x}'" for x in N.LANGUAGES) + "]"
_L3 = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in N.LONG_LANGUAGES.items()) + "}"
_SPOKEN = "map {" + ", ".join(f"'{code}': '{language}'" for code, _, language, _ in N.REGIONS) + "}"
_UNIQ = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_SHORT_L = f"list_filter(string_split_regex(upper(regexp_replace(regexp_extract(name, '\\(([a-zA-Z]{{2}}(?:[,+-][a-zA-Z]{{2}})*)\\)', 1), '-[a-zA-Z]+$', '')), '[,+]'), lambda x: list_contains({_KNOWN_L}, x))"
_LONG_L = f"list_filter(list_transform(string_split(upper(regexp_extract(name, '\\(([a-zA-Z]{{3}}(?:-[a-zA-Z]{{3}})*)\\)', 1)), '-'), lambda x: {_L3}[x]), lambda x: x IS NOT NULL)"
_LOCALE = f"""locale AS (SELECT *, CASE WHEN len(s) > 0 THEN {_UNIQ.format('s')} WHEN len(l) > 0 THEN {_UNIQ.format('l')} WHEN len(rl) > 0 THEN rl
    ELSE list_filter(list_transform(regions, lambda r: {_SPOKEN}[r]), lambda x: x IS NOT NULL) END AS languages
  FROM (SELECT *, {_REGIONS} AS regions, {_SHORT_L} AS s, {_LONG_L} AS l, coalesce(list_transform(list_filter(release, lambda r: r."language" IS NOT NULL), lambda r: r."language"), []) AS rl FROM entries))"""


def _first(expr: str, rule) -> str:
    pattern, groups, replacement = rule if isinstance(rule, tuple) else (rule, 0, "")
    pattern = pattern.replace("'", "''")
    if replacement is None:
        return f"regexp_replace({expr}, '{pattern}', '', 'g')"
    return f"regexp_replace({expr}, '{pattern}', '{replacement.replace('{1}', chr(92) + '1').replace('{2}', chr(92) + '2')}')"


def _strips(source: str, column: str, rules: tuple, out: str, of: str) -> str:
    """CTEs that apply the rules in turn, a few in each step to keep expressions flat."""
    steps, previous, current = [], source, column
    for k in range(0, len(rules), 12):
        expr = current
        for rule in rules[k : k + 12]:
            expr = _first(expr, rule)
        steps.append(f"{out}{k} AS (SELECT * EXCLUDE ({of}), {expr} AS {of} FROM {previous})" if current == of else f"{out}{k} AS (SELECT *, {expr} AS {of} FROM {previous})")
        previous, current = f"{out}{k}", of
    steps.append(f"{out} AS (SELECT * EXCLUDE ({of}), trim(regexp_replace({of}, '  +', ' ', 'g')) AS {of} FROM {previous})")
    return ",\n".join(steps)


_PLAIN = _strips("entries", "name", N.region_language_rules(), "plain", "plain_name")
_STRIPPED = _PLAIN + ",\n" + _strips("plain", "plain_name", N.VARIANTS, "stripped", "stripped_name")
_DISC = "regexp_replace(regexp_replace(regexp_replace({0}, '(?i) ?\\(Track [0-9]+\\)', ''), '(?i) ?\\(Dis[ck] [0-9]+\\)', ''), '(?i) ?\\(Dis[ck] [0-9]+ of [0-9]+\\)', '')"
_GROUPED = """grouped AS (SELECT e.*, CASE WHEN cloneofid IS NOT NULL THEN coalesce(i.i_name, cloneof, name) ELSE coalesce(nullif(cloneof, ''), name) END AS group_name
  FROM entries e LEFT JOIN (SELECT dat_id AS i_dat, id AS i_id, arg_min(name, game_id) AS i_name FROM entries WHERE id IS NOT NULL GROUP BY 1, 2) i ON i.i_dat = e.dat_id AND i.i_id = e.cloneofid)"""


# -- digests and identity -------------------------------------------------------


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def fingerprints(spark, d):
    """MD5, SHA-1 and SHA-256 of each text."""
    f = fingerprint(F.col("text").cast("binary"), ("md5", "sha1", "sha256"))
    return table(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in f.items()])


@query(f"SELECT DISTINCT file_id, {', '.join(f'{_dig(x)} AS {x}' for x in _WIDTH)} FROM file_records")
def normal_digests(spark, d):
    """Digests of scanned files in their normal spelling."""
    return table(spark, d, "file_records").select("file_id", *[normal_digest(F.col(x), x).alias(x) for x in _WIDTH]).distinct()


@query(f"""WITH {_ENTRIES}, {_MEMBERS}
SELECT dat_id, bit_or(CASE WHEN crc32 IS NOT NULL AND size IS NOT NULL THEN 1 WHEN md5 IS NOT NULL THEN 16 WHEN sha1 IS NOT NULL THEN 256 WHEN sha256 IS NOT NULL THEN 4096 ELSE 0 END)::INT AS needed,
  CASE WHEN (bit_or(CASE WHEN crc32 IS NOT NULL AND size IS NOT NULL THEN 1 WHEN md5 IS NOT NULL THEN 16 WHEN sha1 IS NOT NULL THEN 256 WHEN sha256 IS NOT NULL THEN 4096 ELSE 0 END) & 273) = 0 THEN 1
    ELSE bit_or(CASE WHEN crc32 IS NOT NULL AND size IS NOT NULL THEN 1 WHEN md5 IS NOT NULL THEN 16 WHEN sha1 IS NOT NULL THEN 256 WHEN sha256 IS NOT NULL THEN 4096 ELSE 0 END) & 273 END::INT AS up_to_sha1
FROM members GROUP BY 1""")
def required_digests(spark, d):
    """Digest masks that the members of each catalog need, in full and up to SHA-1."""
    members = _members(spark, d)
    full = members.groupBy("dat_id").agg(F.bit_or(M.required_bit(*[F.col(x) for x in M.DIGESTS], F.col("size"))).alias("needed"))
    cut = M.required_digests(members, most="sha1").select(F.col("dat_id").alias("c"), F.col("mask").alias("up_to_sha1"))
    return full.join(cut, F.col("dat_id").eqNullSafe(F.col("c"))).drop("c")


@query(f"WITH {_ENTRIES}, {_MEMBERS} SELECT dat_id, bool_or(regexp_matches(name, '(?i)\\.(zip|zipx|tar|tgz|gz|rar|7z|z|cso|dax|zso|gcz|rvz|wia|chd)$')) AS archives FROM members GROUP BY 1")
def archive_members(spark, d):
    """Catalogs with members that are archives."""
    return M.member_archives(_members(spark, d))


@query(f"WITH {_FILES} SELECT identity, min(file_id) AS file_id, count(*) AS copies FROM files GROUP BY 1")
def keep_first_files(spark, d):
    """The first file of each identity and the number of its copies."""
    files = _files(spark, d)
    first = M.keep_first(files.select("identity", "file_id"), "identity", "file_id")
    copies = files.groupBy(F.col("identity").alias("i")).agg(F.count("*").alias("copies"))
    return first.join(copies, F.col("identity") == F.col("i")).drop("i")


@query(f"""WITH {_ENTRIES}, {_MEMBERS}
SELECT e.game_id, sha256(e.name || '|' || coalesce(m.ids, '')) AS identity FROM entries e LEFT JOIN
  (SELECT game_id, {_PRINT} AS ids FROM members WHERE kind <> 'disk' GROUP BY 1) m USING (game_id)""")
def entry_identities(spark, d):
    """Identity of each entry: name and sorted member identities."""
    entries = _entries(spark, d, "dat_id", "name")
    return C.entry_identity(entries, _members(spark, d, entries)).select("game_id", F.sha2("identity", 256).alias("identity"))


# -- names -------------------------------------------------------------------


@query(f"WITH {_ENTRIES} SELECT game_id, {', '.join(f'{_flag_sql(w)} AS is_{w}' for w in (*N.FLAGS, 'bad', 'bootleg'))}, {_BIOS} AS is_bios, {_RETAIL} AS is_retail, {_TYPE} AS entry_type FROM entries")
def name_flags(spark, d):
    """Every naming flag, the retail test and the type of each entry."""
    name, category, maker = F.col("name"), F.col("category"), F.col("manufacturer")
    flags = [N.flag(w, name, category, maker).alias(f"is_{w}") for w in (*N.FLAGS, "bad", "bootleg")]
    return _entries(spark, d, "name", "isbios", "isdevice", "category", "manufacturer").select(
        "game_id", *flags, N.is_bios(F.col("isbios"), name).alias("is_bios"), N.is_retail(name, category, maker).alias("is_retail"),
        N.entry_type(name, F.col("isbios"), F.col("isdevice"), category, maker).alias("entry_type"))


@query(f"WITH {_ENTRIES} SELECT game_id, {_REVISION} AS revision FROM entries")
def revisions(spark, d):
    """Revision number of each entry's name."""
    return _entries(spark, d, "name").select("game_id", N.revision(F.col("name")).alias("revision"))


@query(f"WITH {_ENTRIES}, {_LOCALE} SELECT game_id, array_to_string(regions, ',') AS regions, array_to_string(languages, ',') AS languages FROM locale")
def locales(spark, d):
    """Regions and languages of each entry."""
    name, release = F.col("name"), F.col("release")
    return _entries(spark, d, "name", "release").select("game_id", F.array_join(N.regions(name, release), ",").alias("regions"), F.array_join(N.languages(name, release), ",").alias("languages"))


@query(f"WITH {_ENTRIES}, {_STRIPPED} SELECT game_id, plain_name, stripped_name FROM stripped")
def stripped_titles(spark, d):
    """Names without region and language, and without any variant mark."""
    plain = _entries(spark, d, "name").select("game_id", N.strip_locale(F.col("name")).alias("plain_name"))
    return plain.select("game_id", "plain_name", N.strip_variants(F.col("plain_name")).alias("stripped_name"))


# -- curation ------------------------------------------------------------------


@query(f"WITH {_ENTRIES}, {_GROUPED} SELECT dat_id, count(*) AS entries, count(DISTINCT group_name) AS groups, count(DISTINCT group_name) > 0 AND count(DISTINCT group_name) <> count(*) AS has_parents FROM grouped GROUP BY 1")
def parent_info(spark, d):
    """Groups of parents and clones in each catalog."""
    return C.parent_info(C.group_entries(_entries(spark, d, "dat_id", "id", "name", "cloneof", "cloneofid")))


@query(f"""WITH {_ENTRIES}, {_STRIPPED}, elected AS (SELECT dat_id, stripped_name, coalesce(min(game_id) FILTER (plain_name = stripped_name), min(game_id)) AS parent_id FROM stripped GROUP BY 1, 2)
SELECT s.game_id, s.stripped_name AS stripped, e.parent_id FROM stripped s JOIN elected e ON e.dat_id IS NOT DISTINCT FROM s.dat_id AND e.stripped_name IS NOT DISTINCT FROM s.stripped_name""")
def infer_parents(spark, d):
    """Parents inferred from stripped titles."""
    return C.infer_parents(_entries(spark, d, "dat_id", "name")).select("game_id", "stripped", "parent_id")


@query(f"""WITH {_ENTRIES}, {_MEMBERS}, t AS (SELECT dat_id, game_id, name AS entry_name, {_DISC.format('name')} AS title FROM entries),
s AS (SELECT dat_id, title, count(*) AS entries FROM t GROUP BY 1, 2),
r AS (SELECT t.*, m.rom_id, m.name AS m_name FROM t JOIN members m USING (game_id)),
c AS (SELECT dat_id, title, count(*) FILTER (n > 1) AS clashes FROM (SELECT dat_id, title, m_name, count(*) AS n FROM r GROUP BY ALL) GROUP BY 1, 2)
SELECT r.dat_id, r.title, s.entries, r.game_id, r.rom_id, CASE WHEN s.entries > 1 AND c.clashes > 1 THEN entry_name || '/' || m_name ELSE m_name END AS name FROM r JOIN s USING (dat_id, title) JOIN c USING (dat_id, title)""")
def merge_discs(spark, d):
    """Members of entries that are discs of one title, under that title."""
    entries = _entries(spark, d, "dat_id", "name")
    return C.merge_discs(entries, _members(spark, d, entries))


@query(f"""WITH {_ENTRIES}, {_MEMBERS}, i AS (SELECT e.dat_id, e.game_id, e.name, sha256(e.name || '|' || coalesce(m.ids, '')) AS identity_sha256 FROM entries e LEFT JOIN
  (SELECT game_id, {_PRINT} AS ids FROM members WHERE kind <> 'disk' GROUP BY 1) m USING (game_id))
SELECT dat_id, game_id, name, identity_sha256, copies FROM (SELECT *, count(*) OVER (PARTITION BY identity_sha256) AS copies, row_number() OVER (PARTITION BY identity_sha256 ORDER BY dat_id, game_id) AS rn FROM i) WHERE rn = 1""")
def combine_catalogs(spark, d):
    """All catalogs as one, equal entries once."""
    entries = _entries(spark, d, "dat_id", "name")
    return C.combine_catalogs(entries, _members(spark, d, entries))


FILTERS = C.Filters(exclude=(r"(?i)\(Proto",), languages=("EN", "JA"), regions=("USA", "EUR", "JPN", "WORLD"), no=("bios", "demo", "beta", "bad"))
_FILTER_SQL = f"""NOT regexp_matches(name, '(?i)\\(Proto') AND list_has_any(languages, ['EN', 'JA']) AND list_has_any(regions, ['USA', 'EUR', 'JPN', 'WORLD'])
  AND NOT {_BIOS} AND NOT {_flag_sql('demo')} AND NOT {_flag_sql('beta')} AND NOT {_flag_sql('bad')}"""


@query(f"""WITH {_ENTRIES}, {_GROUPED}, {_LOCALE.replace('FROM entries', 'FROM grouped')}, kept AS (SELECT * FROM locale WHERE {_FILTER_SQL}),
heads AS (SELECT dat_id, group_name, CASE WHEN bool_or(name = group_name) THEN group_name ELSE arg_min(name, game_id) END AS parent_name FROM kept GROUP BY 1, 2)
SELECT k.game_id, k.name, h.parent_name FROM kept k JOIN heads h USING (dat_id, group_name)""")
def filter_entries(spark, d):
    """Entries that pass a set of filters, with parents elected anew."""
    return C.filter_entries(C.group_entries(_entries(spark, d)), FILTERS).select("game_id", "name", "parent_name")


@query(f"WITH {_ENTRIES} SELECT dat_id, count(*) FILTER ({_RETAIL}) AS retail, count(*) FILTER ({_flag_sql('verified')}) AS verified, count(*) FILTER (NOT {_flag_sql('verified')}) AS unverified, count(*) FILTER ({_flag_sql('unlicensed')}) AS unlicensed, count(*) FILTER (coalesce(isdevice = 'yes', false)) AS devices FROM entries GROUP BY 1")
def filter_counts(spark, d):
    """What the single filters leave of each catalog."""
    entries = _entries(spark, d, "dat_id", "name", "isbios", "isdevice", "category", "manufacturer")
    count = lambda **k: F.count_if(C.passes(C.Filters(**k)))
    return entries.groupBy("dat_id").agg(
        count(only_retail=True).alias("retail"), count(no=("unverified",)).alias("verified"), count(only=("unverified",)).alias("unverified"),
        count(only=("unlicensed",)).alias("unlicensed"), count(only=("device",)).alias("devices"))


PREFER = C.Preferences(verified=True, good=True, languages=("EN", "JA"), regions=("USA", "WORLD", "EUR"), revision="newer", retail=True, parent=True)


@query(f"""WITH {_ENTRIES}, {_GROUPED}, {_LOCALE.replace('FROM entries', 'FROM grouped')}
SELECT dat_id, group_name, game_id, name, candidates FROM (SELECT *, count(*) OVER (PARTITION BY dat_id, group_name) AS candidates, row_number() OVER (PARTITION BY dat_id, group_name ORDER BY
  NOT {_flag_sql('verified')}, {_flag_sql('bad')}, NOT list_contains(languages, 'EN'), NOT list_contains(languages, 'JA'),
  NOT list_contains(regions, 'USA'), NOT list_contains(regions, 'WORLD'), NOT list_contains(regions, 'EUR'), coalesce({_REVISION}, 0) DESC, {_RETAIL} DESC,
  cloneof IS NOT NULL OR cloneofid IS NOT NULL, game_id) AS rn FROM locale) WHERE rn = 1""")
def prefer_one(spark, d):
    """The one entry preferred in each group."""
    return C.prefer(C.group_entries(_entries(spark, d)), PREFER)


def _merged(mode: str):
    def run(spark, d):
        entries = _entries(spark, d, "dat_id", "id", "name", "cloneof", "cloneofid", "romof", "isbios")
        rows = C.merge_split(entries, _members(spark, d, entries), mode)
        return rows.where(F.col("kind") != "disk") if mode == "merged" else rows  # as its SQL states; merge_merged_disks has the disks

    run.__name__ = f"merge_{mode}"
    run.__doc__ = f"Members of each set under the merge mode {mode}."
    return run


_SANE = "sane AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id, kind, name ORDER BY ord, rom_id) AS srn FROM members WHERE coalesce(status, '') <> 'nodump') WHERE srn = 1 OR kind = 'disk')"
_ROOTS = """named AS (SELECT dat_id AS p_dat, name AS p_name, max(game_id) AS parent FROM entries GROUP BY 1, 2),
links AS (SELECT game_id AS child, parent FROM entries LEFT JOIN named ON p_dat = dat_id AND p_name = romof WHERE romof IS NOT NULL),
up(node, cur, path) AS (SELECT child, parent, [child] FROM links WHERE parent IS NOT NULL
  UNION ALL SELECT u.node, l.parent, list_append(u.path, u.cur) FROM up u JOIN links l ON l.child = u.cur WHERE l.parent IS NOT NULL AND NOT list_contains(u.path, u.cur)),
roots AS (SELECT node AS game_id, cur AS root_id FROM up WHERE cur NOT IN (SELECT child FROM links))"""
_DIFF = """{out} AS (SELECT r.* FROM {rows} r WHERE NOT EXISTS (SELECT 1 FROM {above} a JOIN {held} h ON h.game_id = a.parent_id
  WHERE a.game_id = r.game_id AND h.kind = r.kind AND h.name = coalesce(r.merge, r.name) AND h.identity = r.identity))"""
_LAST = "(SELECT game_id, kind, name, arg_max(identity, row(ord, rom_id)) AS identity FROM {0} GROUP BY 1, 2, 3)"
_NON = f"""WITH RECURSIVE {_ENTRIES},\n{_MEMBERS},\n{_SANE},\n{_ROOTS},
above1 AS (SELECT game_id, root_id AS parent_id FROM roots),
held1 AS (SELECT * FROM {_LAST.format("(SELECT s.* FROM sane s JOIN entries e USING (game_id) WHERE s.kind <> 'disk' AND (" + _BIOS.replace('name', 'e.name') + " OR s.bios IS NOT NULL))")}),
{_DIFF.format(out='non', rows='sane', above='above1', held='held1')}"""
_SPLIT = f"""{_NON},
above2 AS (SELECT game_id, parent AS parent_id FROM entries JOIN named ON p_dat = dat_id AND p_name = cloneof),
held2 AS (SELECT * FROM {_LAST.format('sane')}),
{_DIFF.format(out='splits', rows='non', above='above2', held='held2')}"""
_COLS = "dat_id, game_id, rom_id, kind, name, identity"
for _mode, _sql in {
    "fullnonmerged": f"WITH {_ENTRIES}, {_MEMBERS}, {_SANE} SELECT {_COLS} FROM sane",
    "nonmerged": f"{_NON} SELECT {_COLS} FROM non",
    "split": f"{_SPLIT} SELECT {_COLS} FROM splits",
    "merged": f"""{_SPLIT}, {_GROUPED},
      flat AS (SELECT s.dat_id, g.group_name, (g.cloneof IS NOT NULL OR g.cloneofid IS NOT NULL) AS clone, s.game_id, s.ord, s.rom_id, s.kind, s.identity,
        CASE WHEN g.cloneof IS NOT NULL OR g.cloneofid IS NOT NULL THEN g.name || '\\' || s.name ELSE s.name END AS name FROM splits s JOIN grouped g USING (game_id) WHERE s.kind <> 'disk')
      SELECT dat_id, group_name, game_id, rom_id, kind, name, identity FROM (SELECT *, row_number() OVER (PARTITION BY dat_id, group_name, identity ORDER BY NOT clone, game_id, ord, rom_id, kind, name) AS rn FROM flat) WHERE rn = 1""",
}.items():
    query(_sql)(_merged(_mode))


@query(f"""{_SPLIT}, {_GROUPED},
  flat AS (SELECT s.dat_id, g.group_name, (g.cloneof IS NOT NULL OR g.cloneofid IS NOT NULL) AS clone, s.game_id, s.ord, s.rom_id, s.kind, s.identity,
    CASE WHEN g.cloneof IS NOT NULL OR g.cloneofid IS NOT NULL THEN g.name || '\\' || s.name ELSE s.name END AS name FROM splits s JOIN grouped g USING (game_id))
  SELECT dat_id, group_name, game_id, rom_id, kind, name, identity FROM (SELECT *, row_number() OVER (PARTITION BY dat_id, group_name, identity ORDER BY NOT clone, game_id, ord, rom_id, kind, name) AS rn FROM flat WHERE kind <> 'disk') WHERE rn = 1
  UNION ALL SELECT dat_id, group_name, game_id, rom_id, kind, name, identity FROM flat WHERE kind = 'disk' AND NOT clone""")
def merge_merged_disks(spark, d):
    """Members and disks of each set under the merge mode merged."""
    entries = _entries(spark, d, "dat_id", "id", "name", "cloneof", "cloneofid", "romof", "isbios")
    return C.merge_split(entries, _members(spark, d, entries), "merged")


@query(f"""WITH RECURSIVE {_ENTRIES}, {_ROOTS} SELECT game_id, root_id FROM roots""")
def romof_roots(spark, d):
    """Topmost ancestors by romof over unbroken chains."""
    return C.romof_roots(_entries(spark, d, "dat_id", "name", "romof"))


# -- matching ------------------------------------------------------------------


@query(f"{_ALL} SELECT rom_id, file_id, tier FROM matches")
def tiered_match(spark, d):
    """The file of each member by its strongest shared digest."""
    return _matches(spark, d)


_REASONS = f"""WITH {_ENTRIES}, {_MEMBERS}, {_FILES},
mk AS (SELECT DISTINCT unnest(['sha1', 'sha256', 'md5', 'crc32+size', 'size+name']) AS way, unnest([sha1, sha256, md5, crc32 || '|' || size::VARCHAR, size::VARCHAR || '|' || regexp_extract(name, '([^/\\\\]*)$', 1)]) AS key FROM members),
fk AS (SELECT file_id, unnest(['sha1', 'sha256', 'md5', 'crc32+size', 'size+name']) AS way, unnest([sha1, sha256, md5, crc32 || '|' || size::VARCHAR, size::VARCHAR || '|' || regexp_extract(relative, '([^/\\\\]*)$', 1)]) AS key FROM files),
reasons AS (SELECT file_id, string_agg(DISTINCT way, ',' ORDER BY way) AS reasons FROM fk JOIN mk USING (way, key) GROUP BY 1)"""


@query(f"{_REASONS} SELECT * FROM reasons")
def match_reasons(spark, d):
    """Every way in which a file meets the catalogs."""
    return M.match_reasons(_files(spark, d), _members(spark, d))


@query(f"{_REASONS} SELECT file_id, source, relative FROM files WHERE file_id NOT IN (SELECT file_id FROM reasons)")
def unmatched_files(spark, d):
    """Files that meet no catalog."""
    return M.unmatched_files(_files(spark, d), _members(spark, d)).select("file_id", "source", "relative")


@query(f"{_STATUS} SELECT game_id, name, members, found, status, {_RETAIL} AS retail, {_BIOS} AS bios FROM status")
def status_report(spark, d):
    """Found, incomplete or missing: the state of every entry."""
    entries = _entries(spark, d, "dat_id", "name", "isbios", "category", "manufacturer")
    members = _members(spark, d, entries)
    status = M.entry_status(entries, members, M.tiered_match(members, _files(spark, d)))
    name, category, maker = F.col("name"), F.col("category"), F.col("manufacturer")
    return status.select("game_id", "name", "members", "found", "status", N.is_retail(name, category, maker).alias("retail"), N.is_bios(F.col("isbios"), name).alias("bios"))


@query(f"""{_STATUS}, kinds AS (SELECT dat_id, status, unnest(list_filter(['games', CASE WHEN {_BIOS} THEN 'bioses' END, CASE WHEN isdevice = 'yes' THEN 'devices' END, CASE WHEN {_RETAIL} THEN 'retail' END], lambda x: x IS NOT NULL)) AS kind FROM status)
SELECT dat_id, kind, count(*) AS entries, count(*) FILTER (status = 'FOUND') AS found, count(*) FILTER (status = 'INCOMPLETE') AS incomplete, count(*) FILTER (status = 'MISSING') AS missing FROM kinds GROUP BY 1, 2""")
def status_counts(spark, d):
    """Entries of each catalog and kind by status."""
    entries = _entries(spark, d, "dat_id", "name", "isbios", "isdevice", "category", "manufacturer")
    members = _members(spark, d, entries)
    status = M.entry_status(entries, members, M.tiered_match(members, _files(spark, d)))
    name, category, maker = F.col("name"), F.col("category"), F.col("manufacturer")
    kinds = F.array_compact(F.array(
        F.lit("games"), F.when(N.is_bios(F.col("isbios"), name), "bioses"), F.when(F.col("isdevice") == "yes", "devices"), F.when(N.is_retail(name, category, maker), "retail")))
    return status.select("dat_id", "status", F.explode(kinds).alias("kind")).groupBy("dat_id", "kind").agg(
        F.count("*").alias("entries"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("FOUND", "INCOMPLETE", "MISSING")])


@query(f"""{_ALL}, planned AS (SELECT DISTINCT dat_id, identity FROM members JOIN matches USING (rom_id))
SELECT game_id, dat_id, name FROM entries WHERE game_id IN (SELECT game_id FROM members m WHERE kind <> 'disk' AND NOT EXISTS (SELECT 1 FROM planned p WHERE p.dat_id = m.dat_id AND p.identity = m.identity))""")
def fixdat(spark, d):
    """Entries that lack a member."""
    entries = _entries(spark, d, "dat_id", "name")
    members = _members(spark, d, entries)
    return M.fixdat(entries, members, M.tiered_match(members, _files(spark, d))).select("game_id", "dat_id", "name")


@query(f"""{_ALL} SELECT file_id, CASE WHEN file_id IN (SELECT file_id FROM matches) THEN 'used' WHEN identity IN (SELECT identity FROM files WHERE file_id IN (SELECT file_id FROM matches)) THEN 'duplicate' ELSE 'unused' END AS usage FROM files""")
def file_usage(spark, d):
    """Used, duplicate and unused files."""
    return M.file_usage(_files(spark, d), _matches(spark, d))


@query(f"""WITH {_ENTRIES}, {_MEMBERS}, {_FILES},
want AS (SELECT game_id, {_PRINT} AS ids FROM members WHERE kind <> 'disk' GROUP BY 1),
have AS (SELECT source || '/' || regexp_extract(relative, '^(.*)/[^/]*$', 1) AS archive, {_PRINT} AS ids FROM files WHERE regexp_extract(relative, '^(.*)/[^/]*$', 1) <> '' GROUP BY 1)
SELECT game_id, archive FROM want JOIN have USING (ids)""")
def covering_archives(spark, d):
    """Folders that hold exactly the members of an entry."""
    return M.covering_archives(_members(spark, d), _files(spark, d))


def _parts_sql(key: str, name: str, source: str, extra: str = "") -> str:
    stem = f"regexp_replace(regexp_extract({name}, '([^/\\\\]*)$', 1), '(.)\\.[^.]*$', '\\1')"
    title = f"coalesce(lower(trim(regexp_replace(regexp_replace({stem}, '\\([^()]*\\)|\\[[^\\[\\]]*\\]', '', 'g'), '\\s+', ' ', 'g'))), '')"
    return f"""(SELECT *, list_distinct(list_filter(string_split_regex(title, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) AS w
  FROM (SELECT {key}, size, crc32, md5, sha1, regexp_extract({name}, '([^/\\\\]*)$', 1) AS base, {title} AS title{extra} FROM {source}))"""


_FUZZY = f"""WITH {_ENTRIES}, {_MEMBERS}, {_FILES}, l AS {_parts_sql('rom_id', 'name', 'members')},
r AS {_parts_sql('file_id', 'relative', 'files', ", row_number() OVER (ORDER BY coalesce(source || '::' || relative, ''), file_id) AS place")},
words AS (SELECT rom_id, file_id, count(*) AS shared FROM (SELECT rom_id, unnest(w) AS word FROM l) a JOIN (SELECT file_id, unnest(w) AS word FROM r) b USING (word) GROUP BY 1, 2),
pairs AS (SELECT rom_id, file_id FROM words UNION SELECT rom_id, file_id FROM l JOIN r USING (sha1) UNION SELECT rom_id, file_id FROM l JOIN r USING (md5) UNION SELECT rom_id, file_id FROM l JOIN r USING (crc32, size)
  UNION SELECT rom_id, file_id FROM l JOIN r USING (size, base) UNION SELECT rom_id, file_id FROM l JOIN r USING (title) WHERE title <> ''),
scored AS (SELECT rom_id, file_id, place, coalesce(l.sha1 = r.sha1, false) OR coalesce(l.md5 = r.md5, false) OR coalesce(l.crc32 = r.crc32 AND l.size = r.size, false) AS by_digest,
    CASE WHEN l.sha1 = r.sha1 THEN 900.0::DOUBLE ELSE 0 END + CASE WHEN l.md5 = r.md5 THEN 850.0::DOUBLE ELSE 0 END + CASE WHEN l.crc32 = r.crc32 AND l.size = r.size THEN 800.0::DOUBLE ELSE 0 END
    + CASE WHEN l.size = r.size AND l.base = r.base THEN 700.0::DOUBLE WHEN l.size = r.size THEN 20.0::DOUBLE ELSE 0 END
    + CASE WHEN l.title <> '' AND l.title = r.title THEN 300.0::DOUBLE ELSE coalesce(shared / (len(l.w) + len(r.w) - shared)::DOUBLE * 300, 0) END AS score
  FROM pairs JOIN l USING (rom_id) JOIN r USING (file_id) LEFT JOIN words USING (rom_id, file_id))
SELECT rom_id, file_id, round(score, 6) AS score, by_digest FROM (SELECT *, row_number() OVER (PARTITION BY rom_id ORDER BY by_digest DESC, score DESC, place) AS rn FROM scored WHERE by_digest OR score >= 25) WHERE rn = 1"""


@query(_FUZZY)
def fuzzy_match(spark, d):
    """The best file of each member by score."""
    return M.fuzzy_match(_members(spark, d), _files(spark, d))


@query()
def assigned_files(spark, d):
    """Each file for one member at most, by descending score."""
    return M.fuzzy_assign(_members(spark, d), _files(spark, d))


def _enrich_sql() -> str:
    steps, previous = [f"e0 AS (SELECT file_id, {', '.join(_WIDTH)} FROM files)"], "e0"
    for i, by in enumerate(_WIDTH, 1):
        others = [x for x in _WIDTH if x != by]
        known = ", ".join(f"arg_max({x}, file_id) FILTER ({x} IS NOT NULL) AS k_{x}" for x in others)
        steps.append(f"e{i} AS (SELECT file_id, e.{by}, {', '.join(f'coalesce(k_{x}, e.{x}) AS {x}' for x in others)} FROM {previous} e LEFT JOIN (SELECT {by} AS by_, {known} FROM {previous} WHERE {by} IS NOT NULL GROUP BY 1) k ON k.by_ = e.{by})")
        previous = f"e{i}"
    return f"WITH {_FILES}, " + ", ".join(steps) + f" SELECT * FROM {previous}"


@query(_enrich_sql())
def enrich_digests(spark, d):
    """Digests completed from files that share one."""
    return M.enrich_digests(_files(spark, d))


@query(f"""WITH {_ENTRIES}, p AS (SELECT dat_id AS p_dat, name AS p_name, arg_min(genre, game_id) AS p_genre FROM entries GROUP BY 1, 2)
SELECT game_id, coalesce(nullif(genre, ''), p_genre) AS genre, nullif(genre, '') IS NULL AND p_genre IS NOT NULL AS inherited FROM entries LEFT JOIN p ON p_dat = dat_id AND p_name = cloneof""")
def inherited_genres(spark, d):
    """Genres, taken from the parent where an entry has none."""
    return M.inherit_genres(_entries(spark, d, "dat_id", "name", "cloneof", "genre"))


@query("SELECT cache_id, json ->> '$.name' AS json_name, json ->> '$.id' AS json_id FROM igdb_cache WHERE json IS NULL OR json_valid(json) ")
def json_fields(spark, d):
    """Fields of cached answers."""
    rows = table(spark, d, "igdb_cache")
    valid = rows.where(F.col("json").isNull() | F.try_parse_json("json").isNotNull())
    return M.json_fields(valid, "cache_id", "json", {"json_name": "$.name", "json_id": "$.id"})


@query(f"""{_ALL} SELECT archive, count(*) AS files, count(u) AS moved FROM (SELECT source || '/' || regexp_extract(relative, '^(?:(.*)/)?[^/]*$', 1) AS archive, m.file_id AS u FROM files f LEFT JOIN (SELECT DISTINCT file_id FROM matches) m USING (file_id)) GROUP BY 1 HAVING count(*) = count(u)""")
def consumed_archives(spark, d):
    """Folders whose files were all moved."""
    return M.consumed_archives(_files(spark, d), _matches(spark, d).select("file_id").distinct())


# -- records -------------------------------------------------------------------


_TAG_MAP = {which: "map {" + ", ".join(f"'{w}': '{code}'" for code, words in table_.items() for w in words) + "}" for which, table_ in (("region", N.TAG_REGIONS), ("language", N.TAG_LANGUAGES))}
_HAS = "len(list_filter(up, lambda t: regexp_matches(t, '{0}'))) > 0"
_NUM = "try_cast(regexp_extract(t, '{0}', {1}) AS BIGINT)"
_VER = "^V(?:ER(?:SION)?)?\\.?\\s*(\\d+)(?:\\.(\\d+))?(?:\\.(\\d+))?$"
_VARIANTS = f"""WITH f AS (SELECT DISTINCT file_id, relative FROM file_records),
s AS (SELECT *, regexp_replace(regexp_extract(relative, '([^/\\\\]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem FROM f),
t AS (SELECT *, list_transform(regexp_extract_all(stem, '\\([^()]*\\)|\\[[^\\[\\]]*\\]'), lambda x: trim(x)) AS tags, trim(regexp_replace(regexp_replace(stem, '\\([^()]*\\)|\\[[^\\[\\]]*\\]', '', 'g'), '\\s+', ' ', 'g')) AS bare FROM s),
w AS (SELECT *, list_transform(tags, lambda x: upper(x)) AS up, list_filter(string_split_regex(upper(array_to_string(tags, ' ')), '[^A-Z0-9]+'), lambda x: x <> '') AS words FROM t),
m AS (SELECT *, list_filter(list_transform(words, lambda x: {_TAG_MAP['region']}[x]), lambda x: x IS NOT NULL) AS rs, list_filter(list_transform(words, lambda x: {_TAG_MAP['language']}[x]), lambda x: x IS NOT NULL) AS ls,
  list_sort(list_concat([[255, 4294967295]], list_transform(list_transform(up, lambda x: trim(regexp_replace(x, '^[(\\[]|[)\\]]$', '', 'g'))), lambda t:
    CASE WHEN regexp_matches(t, '^PRG\\s*\\d+$') THEN [0, 4294967295 - {_NUM.format('^PRG' + chr(92) + 's*(' + chr(92) + 'd+)$', 1)}]
      WHEN regexp_matches(t, '{_VER}') THEN [1, 4294967295 - (coalesce({_NUM.format(_VER, 1)}, 0) * 1048576 + coalesce({_NUM.format(_VER, 2)}, 0) * 1024 + coalesce({_NUM.format(_VER, 3)}, 0))]
      WHEN regexp_matches(t, '^REV\\s*\\d+$') THEN [2, 4294967295 - {_NUM.format('^REV' + chr(92) + 's*(' + chr(92) + 'd+)$', 1)}]
      WHEN regexp_matches(t, '^REV\\s*[A-Z]$') THEN [3, 4294967295 - (ascii(right(t, 1)) - 64)] ELSE [255, 4294967295] END)))[1] AS rank FROM w)
SELECT file_id, CASE WHEN bare = '' THEN stem ELSE bare END AS title, rs[1] AS region, array_to_string({_UNIQ.format('ls')}, ',') AS languages,
  CASE WHEN {_HAS.format('^' + chr(92) + '[' + chr(92) + 's*!' + chr(92) + 's*' + chr(92) + ']$')} THEN 'verified' WHEN {_HAS.format('^' + chr(92) + '[' + chr(92) + 's*B')} THEN 'bad' WHEN {_HAS.format('^' + chr(92) + '[' + chr(92) + 's*F')} THEN 'fixed'
    WHEN {_HAS.format('^' + chr(92) + '[' + chr(92) + 's*!P' + chr(92) + 's*' + chr(92) + ']$')} THEN 'pending' WHEN {_HAS.format('^' + chr(92) + '[' + chr(92) + 's*[HPTOAU]|^' + chr(92) + '(.*(?:BETA|PROTO|ALPHA|SAMPLE|DEMO|TRIAL)')} THEN 'modified' ELSE 'clean' END AS quality,
  rank[1]::INT AS priority, rank[2] AS score, try_cast(regexp_extract(upper(array_to_string(tags, ' ')), 'SET[^\\d)\\]]*(\\d+)', 1) AS BIGINT) AS set_number FROM m"""


@query(_VARIANTS)
def file_variants(spark, d):
    """Title, region, languages, quality and revision read off each file's name."""
    rows = R.described(table(spark, d, "file_records"))
    return rows.select("file_id", "title", "region", F.array_join("languages", ",").alias("languages"), "quality", F.col("rank.priority").alias("priority"), F.col("rank.score").alias("score"), "set_number")


_CHOSEN = f"""WITH v AS ({_VARIANTS}), r AS (SELECT v.*, f.relative, coalesce(list_position(['USA', 'WORLD', 'EUR'], region) - 1, 3) AS rr,
  CASE WHEN list_contains(string_split(languages, ','), 'EN') THEN 0 WHEN list_contains(string_split(languages, ','), 'JA') THEN 1 ELSE 2 END AS lr, list_position(['verified', 'fixed', 'pending', 'clean', 'modified', 'bad'], quality) AS q
  FROM v JOIN (SELECT DISTINCT file_id, relative FROM file_records) f USING (file_id)),
o AS (SELECT *, rr < 3 OR lr < 2 AS fits, row_number() OVER (PARTITION BY title, rr < 3 OR lr < 2 ORDER BY rr, lr, q, priority, score, set_number IS NULL, set_number, relative, file_id) AS rn FROM r),
b AS (SELECT title, rr AS br, lr AS bl, q AS bq, priority AS bp, score AS bs FROM o WHERE fits AND rn = 1),
x AS (SELECT o.*, fits AND rn = 1 AS kept, CASE WHEN fits AND rn = 1 THEN NULL WHEN NOT fits THEN 'not in preferences' WHEN rr > br THEN 'region' WHEN lr > bl THEN 'language' WHEN q > bq THEN 'quality'
  WHEN priority > bp OR (priority = bp AND score > bs) THEN 'revision' ELSE 'another variant' END AS reason FROM o LEFT JOIN b USING (title))"""


@query(f"{_CHOSEN} SELECT file_id, title, kept, reason FROM x")
def chosen_variants(spark, d):
    """The variant kept of each title, and why the others were not."""
    return R.choose_variants(R.described(table(spark, d, "file_records")), ("USA", "WORLD", "EUR"), ("EN", "JA"))


@query(f"{_CHOSEN} SELECT reason, count(*) AS files FROM x WHERE NOT kept GROUP BY 1")
def skip_breakdown(spark, d):
    """Skipped variants by reason."""
    return R.skip_breakdown(chosen_variants(spark, d))


@query(f"""WITH v AS ({_VARIANTS}) SELECT f.file_id, coalesce(nullif(trim(derived_region), ''), v.region) AS region, coalesce(nullif(trim(derived_languages), ''), nullif(v.languages, '')) AS languages
FROM (SELECT DISTINCT file_id, relative, derived_region, derived_languages FROM file_records) f JOIN v USING (file_id)""")
def localized_files(spark, d):
    """Regions and languages completed from the tags of file names."""
    return R.localized(table(spark, d, "file_records"))


@query("""WITH w AS (SELECT cache_id, name, list_filter(string_split_regex(trim(regexp_replace(regexp_replace(regexp_replace(name, '\\.[^.]{1,8}$', ''), '\\([^)]*\\)|\\[[^\\]]*\\]', '', 'g'), '[^A-Za-z0-9\\s]|\\s+', ' ', 'g')), '\\s+'), lambda w: w <> '') AS words FROM igdb_cache)
SELECT cache_id, CASE WHEN name IS NOT NULL THEN array_to_string(list_filter(words, lambda t, i: lower(t) <> 'rev' AND NOT (regexp_matches(t, '^[0-9]+$') AND i > 1 AND coalesce(lower(words[i - 1]) = 'rev', false))
  AND NOT regexp_matches(t, '^[0-9]{4}$') AND lower(t) NOT IN ('usa', 'eu', 'japan', 'pal', 'ntsc', 'psx', 'ps2', 'ps3', 'ps4', 'snes', 'nes', 'md', 'gen', 'mega', 'sega', 'n64', 'ds', '3ds', 'switch', 'xbox', 'xbox360', 'pc')), ' ') END AS search_name FROM w""")
def search_names(spark, d):
    """Words to search each cached title by."""
    return table(spark, d, "igdb_cache").select("cache_id", N.search_name(F.col("name")).alias("search_name"))


# -- plans -------------------------------------------------------------------


def _plan(spark: SparkSession, d: str, incomplete: bool = False) -> DataFrame:
    entries = _entries(spark, d, "dat_id", "name", "genre", "category", "release", "isbios", "isdevice", "manufacturer")
    members, files = _members(spark, d, entries), _files(spark, d)
    return P.generate_plan(entries, members, M.tiered_match(members, files), files, incomplete)


_PLAN = f"""{_ALL}, rows_ AS (SELECT m.game_id, m.rom_id, m.name AS member, m.kind, m.identity, m.size, h.file_id, f.source, f.relative, h.file_id IS NOT NULL OR coalesce(m.size = 0, false) AS matched
  FROM members m LEFT JOIN matches h USING (rom_id) LEFT JOIN files f ON f.file_id = h.file_id),
cnt AS (SELECT game_id, count(*) AS members, count(*) FILTER (matched) AS found FROM rows_ GROUP BY 1),
plan AS (SELECT e.dat_id, e.name, e.category, e.manufacturer, e.isbios, e.isdevice, r.*, c.members FROM rows_ r JOIN cnt c USING (game_id) JOIN entries e USING (game_id) WHERE r.matched AND c.members = c.found),
paths AS (SELECT *, 'out/' || {_TYPE} || '/' || CASE WHEN kind = 'disk' OR (members > 1 AND NOT regexp_matches(base, '(?i)\\.(zip|zipx|tar|tgz|gz|rar|7z|z|cso|dax|zso|gcz|rvz|wia|chd)$')) THEN name || '/' || base ELSE base END AS raw_output
  FROM (SELECT *, regexp_extract(regexp_replace(regexp_replace(replace(member, ':', ';'), '[<>:"|?*]', '_', 'g'), '[\\\\/]', '/', 'g'), '([^/]*)$', 1) AS base FROM plan)),
outs AS (SELECT * EXCLUDE (raw_output), regexp_replace(regexp_replace(replace(raw_output, ':', ';'), '[<>:"|?*]', '_', 'g'), '[\\\\/]', '/', 'g') AS output FROM paths)
"""


@query(f"{_PLAN} SELECT game_id, rom_id, file_id, output FROM outs")
def write_plan(spark, d):
    """Where each member of every complete entry is written, and from which file."""
    return P.output_paths(_plan(spark, d)).select("game_id", "rom_id", "file_id", "output")


@query(f"{_PLAN} SELECT dat_id, output, count(DISTINCT game_id) AS entries, count(DISTINCT identity) AS inputs FROM outs GROUP BY 1, 2 HAVING count(DISTINCT game_id) > 1 OR count(DISTINCT identity) > 1")
def output_conflicts(spark, d):
    """Paths that would be written twice."""
    return P.output_conflicts(P.output_paths(_plan(spark, d)))


@query(f"{_PLAN}, bad AS (SELECT dat_id FROM outs GROUP BY dat_id, output HAVING count(DISTINCT game_id) > 1) SELECT dat_id, count(*) AS members, count(DISTINCT game_id) AS entries FROM outs WHERE dat_id NOT IN (SELECT dat_id FROM bad) GROUP BY 1")
def valid_plans(spark, d):
    """Members and entries of the catalogs without a conflict."""
    return P.valid_plan(P.output_paths(_plan(spark, d))).groupBy("dat_id").agg(F.count("*").alias("members"), F.count_distinct("game_id").alias("entries"))


@query(f"""WITH {_ENTRIES}, {_LOCALE}, x AS (SELECT game_id, unnest(CASE WHEN len(regions) = 0 THEN [NULL] ELSE regions END) AS region, languages, category FROM locale),
y AS (SELECT game_id, region, unnest(CASE WHEN len(languages) = 0 THEN [NULL] ELSE languages END) AS "language", category FROM x)
SELECT game_id, region, "language", unnest(CASE WHEN category IS NULL OR len(category) = 0 THEN [NULL] ELSE category END) AS one_category FROM y""")
def expanded_entries(spark, d):
    """One row for each region, language and category of an entry."""
    return P.expanded(_entries(spark, d, "name", "release", "category")).select("game_id", "region", "language", "one_category")


_LETTER = "regexp_replace(upper(rpad(substring(name, 1, 1), 1, 'A')), '[^A-Z]', '#', 'g')"


@query(f"""WITH {_ENTRIES}, n AS (SELECT DISTINCT dat_id AS scope, name, {_LETTER} AS letter FROM entries),
r AS (SELECT *, row_number() OVER (PARTITION BY scope, letter ORDER BY name) - 1 AS rank, count(*) OVER (PARTITION BY scope, letter) AS total FROM n)
SELECT scope, name, CASE WHEN total > 5 THEN letter || (rank // 5 + 1)::VARCHAR ELSE letter END AS folder FROM r""")
def letter_folders(spark, d):
    """Letter folders of at most five entries."""
    return P.letter_folders(_entries(spark, d, "dat_id", "name").select(F.col("dat_id").alias("scope"), "name"), 5)


@query(f"""WITH {_ENTRIES}, n AS (SELECT DISTINCT dat_id AS scope, name, regexp_replace(upper(rpad(substring(name, 1, 1), 1, 'A')), '[^A-Z0-9]', '#', 'g') AS letter FROM entries),
r AS (SELECT *, (row_number() OVER (PARTITION BY scope ORDER BY letter, name) - 1) // 20 AS chunk FROM n)
SELECT scope, name, min(letter) OVER (PARTITION BY scope, chunk) || '-' || max(letter) OVER (PARTITION BY scope, chunk) AS folder FROM r""")
def letter_groups(spark, d):
    """Folders of twenty entries over ranges of letters."""
    return P.letter_folders(_entries(spark, d, "dat_id", "name").select(F.col("dat_id").alias("scope"), "name"), 20, grouped=True)


@query(f"""WITH {_ENTRIES}, l AS (SELECT DISTINCT {_LETTER} AS letter FROM entries), r AS (SELECT *, (row_number() OVER (ORDER BY letter) - 1) // 4 AS chunk FROM l)
SELECT letter, min(letter) OVER (PARTITION BY chunk) || '-' || max(letter) OVER (PARTITION BY chunk) AS folder FROM r""")
def letter_ranges(spark, d):
    """Folders of four letters each."""
    return P.letter_ranges(_entries(spark, d, "name"), 4)


@query(f"{_PLAN}, p AS (SELECT DISTINCT dat_id, {_DISC.format('name')} AS title, output FROM outs) SELECT dat_id, title, count(*) AS files, string_agg(output, chr(10) ORDER BY output) AS lines FROM p GROUP BY 1, 2 HAVING count(*) > 1")
def playlists(spark, d):
    """Playlists of sets of two or more files."""
    return P.playlists(P.output_paths(_plan(spark, d)))


_LISTED = f"""{_PLAN}, p AS (SELECT DISTINCT dat_id, {_DISC.format('name')} AS title, output, string_split(regexp_extract(output, '^(.*)/[^/]*$', 1), '/') AS dirs FROM outs),
k AS (SELECT *, count(*) OVER (PARTITION BY dat_id, title) AS files FROM p),
n AS (SELECT dat_id, title, output, files, unnest(range(1, len(dirs) + 1)) AS depth, dirs FROM k WHERE files > 1),
h AS (SELECT dat_id, title, depth, any_value(array_to_string(dirs[1:depth], '/')) AS head FROM n GROUP BY dat_id, title, depth, files HAVING count(DISTINCT array_to_string(dirs[1:depth], '/')) = 1 AND count(*) = files),
c AS (SELECT dat_id, title, arg_max(head, depth) AS folder FROM h GROUP BY 1, 2)"""


@query(f"""{_LISTED} SELECT k.dat_id, c.folder || '/' || k.title || '.m3u' AS path, substring(k.output, length(c.folder) + 2) AS line FROM k JOIN c ON c.dat_id IS NOT DISTINCT FROM k.dat_id AND c.title = k.title""")
def playlist_lines(spark, d):
    """Lines of each playlist, below the common folder of its files."""
    return P.playlist_lines(P.output_paths(_plan(spark, d)))


@query("""WITH f AS (SELECT DISTINCT file_id, source || '/' || relative AS path, size FROM file_records), m AS (SELECT DISTINCT source || '/' || relative AS path, size AS m_size FROM file_records_mirror)
SELECT f.file_id, CASE WHEN m.path IS NOT NULL AND (f.size = m.m_size OR f.size IS NULL OR m.m_size IS NULL) THEN 'skip_valid' ELSE 'write' END AS decision
FROM f LEFT JOIN (SELECT path, max(m_size) AS m_size FROM m GROUP BY 1) m USING (path)""")
def write_decisions(spark, d):
    """What overwriting invalid files would do, with the mirror as output."""
    path = F.concat("source", F.lit("/"), "relative")
    files = table(spark, d, "file_records").select("file_id", path.alias("path"), "size").distinct()
    there = table(spark, d, "file_records_mirror").groupBy(path.alias("m_path")).agg(F.max("size").alias("m_size"))
    joined = files.join(there, F.col("path") == F.col("m_path"), "left")
    ok = P.content_test({"size": F.col("size"), "crc32": F.lit("")}, {"size": F.col("m_size")})
    return joined.select("file_id", P.write_decision(F.col("m_path").isNotNull(), F.lit(False), True, False, True, ok).alias("decision"))


@query("""SELECT DISTINCT source || '/' || relative AS path FROM file_records_mirror WHERE source || '/' || relative NOT IN (SELECT source || '/' || relative FROM file_records WHERE source IS NOT NULL AND relative IS NOT NULL)""")
def clean_candidates(spark, d):
    """Files of the mirror that no scan knows."""
    path = F.concat("source", F.lit("/"), "relative").alias("path")
    return P.clean_candidates(table(spark, d, "file_records_mirror").select(path).where(F.col("path").isNotNull()).distinct(), table(spark, d, "file_records").select(path))


@query(f"""WITH {_FILES}, i AS (SELECT source, relative, file_id, regexp_extract(relative, '^(.*)/[^/]*$', 1) AS folder FROM files)
SELECT source, regexp_replace(regexp_extract(CASE WHEN folder <> '' THEN folder ELSE relative END, '([^/\\\\]*)$', 1), '(.)\\.[^.]*$', '\\1') AS entry, file_id, regexp_extract(relative, '([^/]*)$', 1) AS member FROM i""")
def inferred_catalog(spark, d):
    """A catalog made from the scanned files."""
    return P.infer_catalog(_files(spark, d))


@query(f"""WITH {_ENTRIES}, {_MEMBERS}, a AS (SELECT dat_id, count(*) AS n, max(game_id) AS game_id, bool_and({_BIOS}) AS bios FROM entries GROUP BY 1),
c AS (SELECT game_id, count(*) AS k FROM members GROUP BY 1), w AS (SELECT a.game_id FROM a JOIN c USING (game_id) WHERE n = 1 AND bios AND k > 10)
SELECT dat_id, game_id, rom_id, regexp_replace(regexp_extract(name, '([^/\\\\]*)$', 1), '(.)\\.[^.]*$', '\\1') AS entry_name FROM (SELECT *, row_number() OVER (PARTITION BY game_id, identity ORDER BY ord, rom_id) AS rn FROM members WHERE game_id IN (SELECT game_id FROM w)) WHERE rn = 1""")
def single_bios(spark, d):
    """Catalogs of a single BIOS as one entry per member."""
    entries = _entries(spark, d, "dat_id", "name", "isbios")
    return C.split_single_bios(entries, _members(spark, d, entries))


@query("""SELECT strftime(scanned_at, '%Y-%m-%d') AS day, source, count(*) AS files, sum(size)::BIGINT AS bytes FROM (SELECT DISTINCT file_id, source, size, scanned_at FROM file_records) GROUP BY 1, 2""")
def scans_by_day(spark, d):
    """Files and bytes of each source and day of scan, as the stream over a landing folder counts them."""
    rows = table(spark, d, "file_records").select("file_id", "source", "size", "scanned_at").distinct()
    return rows.groupBy(F.date_format("scanned_at", "yyyy-MM-dd").alias("day"), "source").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query(f"""WITH {_ENTRIES}, {_LOCALE}, r AS (SELECT DISTINCT dat_id, unnest(regions) AS region FROM locale WHERE len(regions) > 0)
SELECT dat_id, string_agg(region, ',' ORDER BY region) AS regions FROM r GROUP BY 1""")
def catalog_regions(spark, d):
    """Regions that occur in each catalog: unique output folders of a template by region."""
    rows = _entries(spark, d, "dat_id", "name", "release").select("dat_id", F.explode(N.regions(F.col("name"), F.col("release"))).alias("region")).distinct()
    return rows.groupBy("dat_id").agg(F.array_join(F.array_sort(F.collect_list("region")), ",").alias("regions"))
