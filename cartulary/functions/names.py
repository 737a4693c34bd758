"""Expressions over catalog names: regions, languages, flags, revisions, stripped titles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Region code, long name, language, short codes in names; the first match wins.
REGIONS = (
    ("ARG", "Argentina", "ES", "AR"), ("AUS", "Australia", "EN", "A|AU"), ("BEL", "Belgium", "FR", "BE"),
    ("BRA", "Brazil", "PT", "B|BR"), ("CAN", "Canada", "EN", "C|CA"), ("CHN", "China", "ZH", "C|CH|CHI|CN"),
    ("DAN", "Denmark", "DA", "DK"), ("FRA", "France", "FR", "F|FR"), ("FYN", "Finland", "FI", "FI|FN"),
    ("GER", "Germany", "DE", "DE|G|GE"), ("GRE", "Greece", "EL", "GR"), ("HK", "Hong Kong", "ZH", "HK"),
    ("HOL", "Netherlands", "NL", "D|H|NL"), ("ITA", "Italy", "IT", "I|IT"), ("JPN", "Japan", "JA", "1|J|JP"),
    ("KOR", "Korea", "KO", "K|KR"), ("MEX", "Mexico", "ES", "MX"), ("NOR", "Norway", "NO", "No"),
    ("NZ", "New Zealand", "EN", None), ("POR", "Portugal", "PT", "P|PT"), ("RUS", "Russia", "RU", "R|RU"),
    ("SPA", "Spain", "ES", "ES|S"), ("SWE", "Sweden", "SV", "SE|SW"), ("TAI", "Taiwan", "ZH", "TW"),
    ("UK", "United Kingdom", "EN", "GB|UK"), ("UNK", "Unknown", "EN", "Unk"), ("USA", "USA", "EN", "4|5|U|US"),
    ("ASI", "Asia", "ZH", "As"), ("EUR", "Europe", "EN", "8|E|EU|PAL"), ("", "Scandinavia", "", None),
    ("WORLD", "World", "EN", "F|W|WO"),
)
#: Three-letter language codes in names.
LONG_LANGUAGES = {"DAN": "DA", "GER": "DE", "ENG": "EN", "SPA": "ES", "FRE": "FR", "ITA": "IT", "DUT": "NL", "NOR": "NO", "SWE": "SV", "CHI": "ZH"}
LANGUAGES = sorted({r[2] for r in REGIONS if r[2]})
REGION_CODES = sorted({r[0] for r in REGIONS if r[0]})
REGION_NAMES = sorted({r[1] for r in REGIONS})

#: Fixed value: what marks a demonstration.
DEMO = (
    r"\(Demo[a-z0-9. -]*\)|@barai|\(Kiosk[a-z0-9. -]*\)|\(Preview\)|GameCube Preview|Kiosk Demo Disc|PS2 Kiosk"
    r"|PSP System Kiosk|Taikenban|Trial Edition"
)
#: Patterns of the naming conventions; (?i) where case does not matter.
FLAGS = {
    "aftermarket": r"(?i)\(Aftermarket[a-z0-9. ]*\)",
    "alpha": r"(?i)\(Alpha[a-z0-9. ]*\)",
    "alternate": r"(?i)\(Alt( [a-z0-9. ]*)?\)|\[a[0-9]*\]",
    "beta": r"(?i)\(Beta[a-z0-9. ]*\)",
    "cracked": r"\[cr([0-9]+| [^\]]+)?\]",
    "debug": r"(?i)\(Debug[a-z0-9. ]*\)",
    "demo": "(?i)" + DEMO,
    "enhancement": r"(?i)\(Enhancement Chip\)",
    "fixed": r"\[f[0-9]*\]",
    "homebrew": r"(?i)\(Homebrew[a-z0-9. ]*\)",
    "mia": r"(?i)\[MIA\]",
    "overdump": r"\[o[0-9]*\]",
    "pending": r"\[!p\]",
    "pirated": r"(?i:\(Pirate[a-z0-9. ]*\))|\[p[0-9]*\]",
    "program": r"(?i)\([a-z0-9. ]*Program\)|(Check|Sample) Program",
    "prototype": r"(?i)\([^)]*Proto[a-z0-9. ]*\)",
    "sample": r"(?i)\([^)]*Sample[a-z0-9. ]*\)",
    "translated": r"\[T[+-][^\]]+\]",
    "unlicensed": r"(?i)\(Unl[a-z0-9. ]*\)",
    "verified": r"\[!\]",
    "bung": r"(?i)\(Bung\)|\[bf\]",
    "hack": r"(?i:\(Hack\))|\[h[a-zA-Z90-9+]*\]",
    "trainer": r"\[t[0-9]*\]",
}
#: Categories and makers that set a flag besides the name.
FLAG_CATEGORIES = {"demo": "demos", "program": "applications", "prototype": "preproduction"}
FLAG_MAKERS = {"bootleg": "bootleg", "hack": "hack"}
#: What a retail entry is free of, and the order in which types are told apart.
NOT_RETAIL = ("debug", "demo", "beta", "sample", "prototype", "program", "aftermarket", "homebrew", "bad", "alpha", "bootleg", "cracked",
              "enhancement", "fixed", "mia", "overdump", "pending", "pirated", "translated", "bung", "hack", "trainer")
TYPE_ORDER = (("aftermarket", "Aftermarket"), ("alpha", "Alpha"), ("bad", "Bad"), ("beta", "Beta"), ("cracked", "Cracked"), ("debug", "Debug"),
              ("demo", "Demo"), ("device", "Device"), ("fixed", "Fixed"), ("hack", "Hacked"), ("homebrew", "Homebrew"), ("overdump", "Overdump"),
              ("pending", "Pending Dump"), ("pirated", "Pirated"), ("program", "Program"), ("prototype", "Prototype"), ("sample", "Sample"),
              ("trainer", "Trained"), ("translated", "Translated"), ("unlicensed", "Unlicensed"))

#: Variant marks that are stripped from a name in this order, each at its first place.
VARIANTS = (
    r"(?i)\(Alt( [a-z0-9. ]*)?\)", r"(?i)\([^)]*Collector's Edition\)", r"(?i)\(Digital Release\)", r"(?i)\(Disney Classic Games\)",
    r"(?i)\(Evercade\)", r"(?i)\(Extra Box\)", r"(?i) - European Version", r"(?i)\(Fukkokuban\)", r"(?i)\([^)]*Genteiban\)",
    r"(?i)\(Limited[^)]+Edition\)", r"(?i)\(Limited Run Games\)", r"(?i)\(LodgeNet\)", r"(?i)\(Made in [^)]+\)", r"(?i)\(Major Wave\)",
    r"(?i)\((Midway Classics)\)", r"(?i)\([^)]*Premium [^)]+\)", r"(?i)\([^)]*Preview Disc\)", r"(?i)\(QUByte Classics\)", r"(?i)\(Recalled\)",
    r"(?i)\(Renkaban\)", r"(?i)\(Reprint\)", r"(?i)\(Rerelease\)", r"(?i)\(Retro-Bit\)", r"(?i)\((Rev|Version)\s*[a-z0-9.-]*\)",
    r"(?i)\([^)]*Seisanban\)", r"(?i)\(Shotenban\)", r"(?i)\(Special Pack\)", r"(?i)\(Steam\)", r"(?i)\(Switch Online\)", r"(?i)\([^)]+ the Best\)",
    r"(?i)\([^)]*Taiouban[^)]*\)", r"(?i)\([^)]*Tokubetsu-?ban[^)]*\)", r"(?i)\([^)]*Virtual Console\)",
    r"\([0-9]{4}-[0-9]{2}-[0-9]{2}\)", r"(?i)\(Aftermarket[a-z0-9. ]*\)", r"(?i)\(Alpha[a-z0-9. ]*\)", r"(?i)\(Beta[a-z0-9. ]*\)",
    r"(?i)\(Build [a-z0-9. ]+\)", r"(?i)\(Bung\)", r"(?i)\(Debug[a-z0-9. ]*\)", "(?i)" + DEMO, r"(?i)\(Hack\)", r"(?i)\(Homebrew[a-z0-9. ]*\)",
    r"(?i)\(Kiosk[^)]*\)", r"(?i)\(Not for Resale\)", r"(?i)\(PD\)", r"(?i)\(Pirate[a-z0-9. ]*\)",
    r"(?i)\([a-z0-9. ]*Program\)|(Check|Sample) Program", r"(?i)\([^)]*Proto[a-z0-9. ]*\)", r"(?i)\([^)]*Sample[a-z0-9. ]*\)",
    r"(?i)\(Spaceworld[a-z0-9. ]*\)", r"(?i)\(Unl[a-z0-9. ]*\)", r"(?i)\(v[0-9.-]+[a-z]*\)", r"(?i)\(Version [0-9.]+[a-z]*\)",
    r"\[!\]", r"\[a[0-9]*\]", r"\[b[0-9]*\]", r"\[bf\]", r"\[c\]", r"\[f[0-9]*\]", r"\[h[a-zA-Z90-9+]*\]", r"\[MIA\]", r"\[o[0-9]*\]", r"\[!p\]",
    r"\[p[0-9]*\]", r"\[t[0-9]*\]", r"\[T[+-][^\]]+\]", r"\[x\]", r"(?i)\(Wxn\)", r"\((SC-3000|SG-1000|SF-7000|GG2SMS|MSX2SMS|SG2GG)\)",
    r"\[(v|eb|eba|ebb|f125|f126)\]", r"\((IQue|MB|MB2GBA)\)", r"\[(C|S|BF)\]", r"\((1|4|5|8|F|B|J-Cart|SN|REVXB|REVSC02|MP|MD Bundle|Alt Music)\)",
    r"\[(c|x)\]", r"\((RU|PC10|VS|Aladdin|Sachen|KC|FamiStudio|PRG0|PRG1|FDS Hack|GBA E-reader|E-GC|J-GC)\)", r"\[(FDS|FCN|U)\]",
    r"\((BS|ST|NP|NSS)\)", r"\((Beta-WIP|Debug Version|GC|Save|Save-PAL|Z64-Save)\)",
    r"\((AE|AL|AS|AT|AU|BA|BE|BG|BR|CA|CH|CL|CN|CS|CY|CZ|DE|DK|EE|EG|ES|EU|FI|FR|GB|GR|HK|HR|HU|ID|IE|IL|IN|IR|IS|IT|JO|JP|KR|LT|LU|LV|MN|MX|MY|NL|NO|NP|NZ|OM|PE|PH|PL|PT|QA|RO|RU|SE|SG|SI|SK|TH|TR|TW|US|VN|YU|ZA)\)",
    r"\((ar|bg|bs|cs|cy|da|de|el|en|eo|es|et|fa|fi|fr|ga|gu|he|hi|hr|hu|is|it|ja|ko|lt|lv|ms|nl|no|pl|pt|ro|ru|sk|sl|sq|sr|sv|th|tr|ur|vi|yi|zh)\)",
    r"\((demo|demo-kiosk|demo-playable|demo-rolling|demo-slideshow)\)", r"\([0-9x]{4}(-[0-9x]{2}(-[0-9x]{2})?)?\)",
    r"(?i)\((CGA|EGA|HGC|MCGA|MDA|NTSC|NTSC-PAL|PAL|PAL-60|PAL-NTSC|SVGA|VGA|XGA)\)", r"\(M[0-9]+\)", r"(?i)\((CW|CW-R|FW|GW|GW-R|LW|PD|SW|SW-R)\)",
    r"(?i)\((alpha|beta|preview|pre-release|proto)\)", r"(?i)(\[(cr|f|h|m|p|t|tr|o|u|v|b|a|!)([0-9]+| [^\]]+)?\])+",
    (r"(?i)(\W)v[0-9]+\.[0-9]+(\W)", 2, "{1} {2}"), (r"'([0-9][0-9])", 1, "{1}"),
    r"(?i)\(SGB Enhanced\)", r"(?i)\(GB Compatible\)", r"(?i)\(GameCube\)", r"(?i)\(NP\)", r"\[([0-9A-Z ]+(, )?)+\]$", r"\[[0-9]+S\]",
    (r"(?i)\[(compilation|data identical to retail|fixed version|keyboard|limited edition|req\. microphone|scrambled|unscrambled|white label)\]", 0, None),
    r"(?i)for Dreamcast", r"(?i)\(MP\)", r"\(RE?-?[0-9]*\)", r"(?i)\(EDC\)", r"(?i)\(PSone Books\)", r"(?i)[(\]](SCES|SCUS|SLES|SLUS)-[0-9]+[(\]]",
    r"\((Arcade|AVTool|Debug|Disc|Patch|Shop|Tool)\)", r"(?i)[(\]][UN][CLP][AEJKU][BFGHJMSXZ]-[0-9]+[(\]]",
)

#: Marks of one part of a set.
DISC_MARKS = (r"(?i) ?\(Track [0-9]+\)", r"(?i) ?\(Dis[ck] [0-9]+\)", r"(?i) ?\(Dis[ck] [0-9]+ of [0-9]+\)")


def replace_first(col: Column, pattern: str, replacement: str = "") -> Column:
    """``col`` with the first match of ``pattern`` replaced; groups in ``replacement`` are ``{1}``, ``{2}``."""
    with_groups = replacement.replace("{1}", "$2").replace("{2}", "$3")
    return F.regexp_replace(col, rf"^([\s\S]*?)(?:{pattern})", "$1" + with_groups)


def _strip_all(col: Column, patterns: tuple) -> Column:
    for rule in patterns:
        pattern, groups, replacement = rule if isinstance(rule, tuple) else (rule, 0, "")
        col = F.regexp_replace(col, pattern, "") if replacement is None else replace_first(col, pattern, replacement)
    return col


def squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, "  +", " "))


def region_language_rules() -> tuple[str, ...]:
    """Patterns of regions and languages in names, in the order they are stripped."""
    short = tuple(rf"(?i)\(({codes})\)" for _, _, _, codes in REGIONS if codes)
    return (
        rf"(?i)\((({'|'.join(REGION_CODES)})[,+-]? ?)+\)", rf"(?i)\((({'|'.join(REGION_NAMES)})[,+-]? ?)+\)", r"(?i)\(Latin America\)",
        *short, rf"(?i)\((({'|'.join(LANGUAGES)})[,+-]? ?)+\)",
    )


def strip_locale(name: Column) -> Column:
    """``name`` without regions and languages; names without brackets pass untouched."""
    return F.when(name.contains("("), squeeze(_strip_all(name, region_language_rules()))).otherwise(squeeze(name))


def strip_variants(name: Column) -> Column:
    """``name`` without any variant mark."""
    touched = name.rlike(r"[(\[@'\]]|(?i: - European|GameCube|Kiosk|Taikenban|Trial|Program|Dreamcast|\Wv[0-9])")
    return F.when(touched, squeeze(_strip_all(name, VARIANTS))).otherwise(squeeze(name))


def strip_disc(name: Column) -> Column:
    """``name`` without the number of a disc or track."""
    return _strip_all(name, DISC_MARKS)


def flag(which: str, name: Column, categories: Column | None = None, maker: Column | None = None) -> Column:
    """True if the naming convention, a category or the maker sets the flag."""
    if which == "bad":
        verified = name.contains("[!]")
        found = name.rlike(r"\[b[0-9]*\]") | (~verified & (name.contains("[c]") | name.contains("[x]")))
    else:
        found = name.rlike(FLAGS[which]) if which in FLAGS else F.lit(False)
    if which in FLAG_CATEGORIES and categories is not None:
        found = found | F.coalesce(F.exists(categories, lambda c: F.lower(c) == FLAG_CATEGORIES[which]), F.lit(False))
    if which in FLAG_MAKERS and maker is not None:
        found = found | F.coalesce(F.lower(maker).contains(FLAG_MAKERS[which]), F.lit(False))
    return F.coalesce(found, F.lit(False))


def is_bios(isbios: Column, name: Column) -> Column:
    return F.coalesce(isbios == "yes", F.lit(False)) | F.coalesce(name.rlike(r"(?i)\[BIOS\]"), F.lit(False))


def is_retail(name: Column, categories: Column | None = None, maker: Column | None = None) -> Column:
    """True if none of the flags that set an entry apart from retail is set."""
    return ~reduce(lambda a, b: a | b, [flag(w, name, categories, maker) for w in NOT_RETAIL])


def entry_type(name: Column, isbios: Column, isdevice: Column, categories: Column | None = None, maker: Column | None = None) -> Column:
    """The type of an entry: BIOS, then verified dumps as retail, then the first flag in order."""
    kind = F.when(is_bios(isbios, name), "BIOS").when(flag("verified", name), "Retail")
    for which, label in TYPE_ORDER:
        hit = F.coalesce(isdevice == "yes", F.lit(False)) if which == "device" else flag(which, name, categories, maker)
        kind = kind.when(hit, label)
    return kind.otherwise("Retail")


def revision(name: Column) -> Column:
    """Revision as a number: numbered, lettered, version, ring code; 0 without; null for one that is no number."""
    number = F.regexp_extract(name, r"(?i)\((?:Rev|Version)\s*([0-9.]+)\)", 1)
    letter = F.upper(F.regexp_extract(name, r"(?i)\(Rev\s*([A-Z])\)", 1))
    version = F.regexp_extract(name, r"(?i)\Wv([0-9]+\.[0-9]+)\W", 1)
    ring = F.regexp_extract(name, r"(?i)\(RE?-?([0-9]*)\)", 1)
    return (
        F.when(number != "", number.try_cast("double"))
        .when(letter != "", (F.ascii(letter) - 64).cast("double"))
        .when(version != "", version.try_cast("double"))
        .when(name.rlike(r"(?i)\(RE?-?[0-9]*\)"), F.when(ring == "", 1.0).otherwise(ring.try_cast("double")))
        .otherwise(0.0)
    )


def regions(name: Column, release: Column | None = None) -> Column:
    """Region codes: of long names in one bracket, else the first short code, else of the releases."""
    names = "|".join(REGION_NAMES)
    listed = F.lower(F.regexp_extract(name, rf"(?i)\(((?:{names})(?:, (?:{names}))*)\)", 1))
    codes = F.create_map(*[F.lit(x) for code, long, _, _ in REGIONS for x in (long.lower(), code)])
    long = F.transform(F.split(listed, ", ?"), lambda r: F.try_element_at(codes, r))
    short = F.lit(None).cast("string")
    for code, _, _, letters in reversed(REGIONS):
        if letters:
            short = F.when(name.rlike(rf"(?i)\((?:{letters})\)"), code).otherwise(short)
    none = F.array().cast("array<string>")
    released = none if release is None else F.coalesce(F.transform(F.filter(release["region"], lambda r: r.isNotNull()), F.upper), none)
    return F.when(listed != "", long).when(short.isNotNull(), F.array(short)).otherwise(released)


def languages(name: Column, release: Column | None = None) -> Column:
    """Languages: two-letter codes, three-letter codes, those of the releases, those of the regions."""
    two = F.regexp_replace(F.regexp_extract(name, r"\(([a-zA-Z]{2}(?:[,+-][a-zA-Z]{2})*)\)", 1), "-[a-zA-Z]+$", "")
    known = [F.lit(x) for x in LANGUAGES]
    short = F.array_distinct(F.filter(F.split(F.upper(two), "[,+]"), lambda x: F.array_contains(F.array(*known), x)))
    three = F.regexp_extract(name, r"\(([a-zA-Z]{3}(?:-[a-zA-Z]{3})*)\)", 1)
    codes = F.create_map(*[F.lit(x) for pair in LONG_LANGUAGES.items() for x in pair])
    long = F.array_distinct(F.filter(F.transform(F.split(F.upper(three), "-"), lambda x: F.try_element_at(codes, x)), lambda x: x.isNotNull()))
    none = F.array().cast("array<string>")
    released = none if release is None else F.coalesce(F.filter(release["language"], lambda r: r.isNotNull()), none)
    spoken = F.create_map(*[F.lit(x) for code, _, language, _ in reversed(REGIONS) for x in (code, language)])
    implied = F.filter(F.transform(regions(name, release), lambda r: F.try_element_at(spoken, r)), lambda x: x.isNotNull())
    return F.when(F.size(short) > 0, short).when(F.size(long) > 0, long).when(F.size(released) > 0, released).otherwise(implied)


# -- names of scanned files ------------------------------------------------

#: Region and language words in the tags of file names.
TAG_REGIONS = {
    "EUR": ("EUROPE", "EURO", "EUR", "EU", "FR", "FRANCE", "GERMANY", "SPAIN", "ITALY", "NETHERLANDS", "BELGIUM", "PORTUGAL", "SWEDEN", "NORWAY", "FINLAND", "DENMARK", "POLAND", "CZECH", "CZECHOSLOVAKIA", "HUNGARY", "KINGDOM", "UK", "ENGLAND", "SCOTLAND", "IRELAND", "WALES",),
    "USA": ("USA", "US", "AMERICA", "STATES", "NORTHAMERICA", "CANADA", "MEXICO",),
    "WORLD": ("WORLD", "GLOBAL", "INTERNATIONAL",),
}
TAG_LANGUAGES = {
    "EN": ("EN", "ENG", "ENGLISH", "UK", "BRITISH", "AMERICAN", "USA", "US", "STATES",), "FR": ("FR", "FRE", "FRENCH", "FRANCE", "FRA",), "DE": ("DE", "GER", "GERMAN", "GERMANY",),
    "ES": ("ES", "SPA", "SPANISH", "SPAIN", "ESP",), "IT": ("IT", "ITA", "ITALIAN", "ITALY",), "PT": ("PT", "POR", "PORTUGUESE", "PORTUGAL", "BRAZIL", "BRA",), "DA": ("DA", "DAN", "DANISH", "DENMARK",),
    "FI": ("FI", "FIN", "FINNISH", "FINLAND",), "EL": ("EL", "ELL", "GRE", "GREEK", "GREECE", "GR",), "JA": ("JA", "JPN", "JAP", "JAPANESE", "JAPAN",), "KO": ("KO", "KOR", "KOREAN", "KOREA",),
    "NL": ("NL", "DUT", "DUTCH", "NETHERLANDS", "HOLLAND",), "NO": ("NO", "NOR", "NORWEGIAN", "NORWAY",), "RU": ("RU", "RUS", "RUSSIAN", "RUSSIA",), "SV": ("SV", "SWE", "SWEDISH", "SWEDEN",),
    "ZH": ("ZH", "CH", "CHN", "CHINESE", "CHINA", "MANDARIN",),
}
#: Words that say nothing in a search.
NOISE = ("usa", "eu", "japan", "pal", "ntsc", "psx", "ps2", "ps3", "ps4", "snes", "nes", "md", "gen", "mega", "sega", "n64", "ds", "3ds",
         "switch", "xbox", "xbox360", "pc")
QUALITY_TIERS = ("verified", "fixed", "pending", "clean", "modified", "bad")


def file_stem(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


#: Names whose brackets are closed by their like and not nested: all but a few.
_FLAT_BRACKETS = r"^[^()\[\]]*(?:(?:\([^()\[\]]*\)|\[[^()\[\]]*\])[^()\[\]]*)*$"


def _nested_tags(name: Column) -> Column:
    """Outermost tags of any name: signs are read one by one, open brackets kept on a stack; a bracket that closes none, or one of the other kind, drops all that is open."""
    none = F.struct(F.lit("").alias("open"), F.lit("").alias("text"), F.array().cast("array<string>").alias("done"))

    def read(a: Column, c: Column) -> Column:
        last, depth = F.right(a["open"], F.lit(1)), F.length(a["open"])
        fits = ((c == ")") & (last == "(")) | ((c == "]") & (last == "["))
        whole = fits & (depth == 1) & (F.trim(a["text"]) != "")
        made = F.concat(last, F.trim(a["text"]), c)
        left = F.when(fits, F.left(a["open"], depth - 1)).otherwise("")
        opened = F.struct(F.concat(a["open"], c).alias("open"), F.when(depth == 0, "").otherwise(a["text"]).alias("text"), a["done"].alias("done"))
        closed = F.struct(
            left.alias("open"), F.when(fits & ~whole, a["text"]).otherwise("").alias("text"), F.when(whole, F.concat(a["done"], F.array(made))).otherwise(a["done"]).alias("done"))
        inside = F.struct(a["open"].alias("open"), F.when(depth > 0, F.concat(a["text"], c)).otherwise(a["text"]).alias("text"), a["done"].alias("done"))
        return F.when(c.isin("(", "["), opened).when(c.isin(")", "]"), closed).otherwise(inside)

    return F.aggregate(F.split(name, ""), none, read)["done"]


def tags(name: Column) -> Column:
    """Bracketed tags of a name, brackets included, blanks inside them aside; of nested brackets the outer one, flattened; empty ones are none."""
    found = F.regexp_extract_all(name, F.lit(r"(\([^()]*\)|\[[^\[\]]*\])"), 1)
    plain = F.transform(found, lambda t: F.concat(F.left(t, F.lit(1)), F.trim(F.substring(t, F.lit(2), F.length(t) - 2)), F.right(t, F.lit(1))))
    return F.when(name.rlike(_FLAT_BRACKETS), F.filter(plain, lambda t: F.length(t) > 2)).otherwise(_nested_tags(name))


def bare_title(name: Column) -> Column:
    """``name`` without what is in brackets, to any depth, and with single blanks."""
    flat = F.regexp_replace(name, r"\([^()]*\)|\[[^\[\]]*\]", "")
    none = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"))
    depth = lambda a, c: F.when(c.isin("(", "["), a["depth"] + 1).when(c.isin(")", "]"), F.greatest(a["depth"] - 1, F.lit(0))).otherwise(a["depth"])
    text = lambda a, c: F.when((a["depth"] == 0) & ~c.isin("(", "[", ")", "]"), F.concat(a["text"], c)).otherwise(a["text"])
    nested = F.aggregate(F.split(name, ""), none, lambda a, c: F.struct(depth(a, c).alias("depth"), text(a, c).alias("text")))["text"]
    return F.trim(F.regexp_replace(F.when(name.rlike(_FLAT_BRACKETS), flat).otherwise(nested), r"\s+", " "))


def _or_tags(name: Column, listed: Column | None) -> Column:
    """The tags at hand, else those of the name; a caller that asks several things reads them off once."""
    return tags(name) if listed is None else listed


def _tag_words(name: Column, listed: Column | None = None) -> Column:
    return F.filter(F.split(F.upper(F.array_join(_or_tags(name, listed), " ")), "[^A-Z0-9]+"), lambda w: w != "")


def _lookup(table: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*[F.lit(x) for code, words in table.items() for word in words for x in (word, code)])


def tag_region(name: Column, listed: Column | None = None) -> Column:
    """The region of the first tag word that means one, else null."""
    return F.get(F.filter(F.transform(_tag_words(name, listed), lambda w: F.try_element_at(_lookup(TAG_REGIONS), w)), lambda r: r.isNotNull()), 0)


def tag_languages(name: Column, listed: Column | None = None) -> Column:
    """Different languages of the tag words, in order."""
    found = F.transform(_tag_words(name, listed), lambda w: F.try_element_at(_lookup(TAG_LANGUAGES), w))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def tag_quality(name: Column, listed: Column | None = None) -> Column:
    """Quality tier of the tags: verified first, then bad, fixed, pending, modified; clean without any."""
    upper = F.transform(_or_tags(name, listed), F.upper)
    has = lambda p: F.exists(upper, lambda t: t.rlike(p))
    return (
        F.when(has(r"^\[\s*!\s*\]$"), "verified").when(has(r"^\[\s*B"), "bad").when(has(r"^\[\s*F"), "fixed").when(has(r"^\[\s*!P\s*\]$"), "pending")
        .when(has(r"^\[\s*[HPTOAU]|^\(.*(?:BETA|PROTO|ALPHA|SAMPLE|DEMO|TRIAL)"), "modified").otherwise("clean")
    )


def tag_revision(name: Column, listed: Column | None = None) -> Column:
    """``struct(priority, score)`` of the best revision tag, smaller is better: PRG, version, number, letter."""
    text = F.transform(_or_tags(name, listed), lambda t: F.trim(F.upper(F.regexp_replace(t, r"^[(\[]|[)\]]$", ""))))
    limit = 4294967295

    def rank(t: Column) -> Column:
        part = lambda p, i: F.coalesce(F.regexp_extract(t, p, i).try_cast("bigint"), F.lit(0))
        version = r"^V(?:ER(?:SION)?)?\.?\s*(\d+)(?:\.(\d+))?(?:\.(\d+))?$"
        return (
            F.when(t.rlike(r"^PRG\s*\d+$"), F.struct(F.lit(0).alias("priority"), (limit - part(r"^PRG\s*(\d+)$", 1)).alias("score")))
            .when(t.rlike(version), F.struct(F.lit(1).alias("priority"), (limit - (part(version, 1) * 1048576 + part(version, 2) * 1024 + part(version, 3))).alias("score")))
            .when(t.rlike(r"^REV\s*\d+$"), F.struct(F.lit(2).alias("priority"), (limit - part(r"^REV\s*(\d+)$", 1)).alias("score")))
            .when(t.rlike(r"^REV\s*[A-Z]$"), F.struct(F.lit(3).alias("priority"), (limit - (F.ascii(F.substring(t, -1, 1)) - 64)).cast("bigint").alias("score")))
            .otherwise(F.struct(F.lit(255).alias("priority"), F.lit(limit).cast("bigint").alias("score")))
        )

    none = F.array(F.struct(F.lit(255).alias("priority"), F.lit(limit).cast("bigint").alias("score")))
    return F.array_min(F.concat(none, F.transform(text, rank)))


def set_number(name: Column, listed: Column | None = None) -> Column:
    """The number behind "set" in the tags, else null."""
    return F.regexp_extract(F.upper(F.array_join(_or_tags(name, listed), " ")), r"SET[^\d)\]]*(\d+)", 1).try_cast("bigint")


def search_name(name: Column) -> Column:
    """Words to search a name by: no extension, tags, punctuation, years, revisions or noise."""
    bare = F.regexp_replace(F.regexp_replace(name, r"\.[^.]{1,8}$", ""), r"\([^)]*\)|\[[^\]]*\]", "")
    words = F.trim(F.regexp_replace(bare, r"[^A-Za-z0-9\s]|\s+", " "))
    words = F.regexp_replace(words, r"(?i)(^|\s)rev(?=\s|$)(?:\s+\d+(?=\s|$))?", " ")
    kept = F.filter(F.split(words, r"\s+"), lambda w: (w != "") & ~w.rlike(r"^\d{4}$") & ~F.lower(w).isin(*NOISE))
    return F.array_join(kept, " ")


def legal_path(path: Column) -> Column:
    """A path without characters that file systems refuse, separators as slashes."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit(":"), F.lit(";")), r"[<>:\"|?*]", "_"), r"[\\/]", "/")


def letter_of(name: Column, count: int = 1, grouped: bool = False) -> Column:
    """The first letters of a name in upper case, padded with A; other characters (digits too, unless grouped) are #."""
    first = F.upper(F.rpad(F.substring(name, 1, count), count, "A"))
    return F.regexp_replace(first, "[^A-Z0-9]" if grouped else "[^A-Z]", "#")
