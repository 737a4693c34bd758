"""Expressions over output paths: names of catalogs, segments, base names, mirrored folders, globs, dates."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartulary.functions.names import legal_path


def display_name(name: Column) -> Column:
    """A catalog's name without doubled dashes and blanks and without dashes at its ends."""
    single = F.regexp_replace(F.trim(name), r"-( +-)+", "- ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(single, r"^[ -]+", ""), r"[ -]+$", ""), "  +", " "))


def catalog_filename(name: Column, version: Column | None = None) -> Column:
    """File name of a catalog: its name, its version in brackets if it has one, legal characters."""
    trimmed = F.trim(name)
    full = trimmed if version is None else F.concat(trimmed, F.when(F.coalesce(version, F.lit("")) != "", F.concat(F.lit(" ("), version, F.lit(")"))).otherwise(""))
    return legal_path(F.trim(F.concat(full, F.lit(".dat"))))


def segment(text: Column) -> Column:
    """One segment of a path: separators as underscores, no control characters, no dots, blanks or dashes at its ends; null if nothing is left."""
    plain = F.regexp_replace(F.translate(F.trim(text), "/\\", "__"), r"\p{Cc}", "")
    bare = F.regexp_replace(F.trim(F.regexp_replace(plain, r"^\.+|\.+$", "")), r"^-+|-+$", "")
    return F.nullif(bare, F.lit(""))


def kept_extension(path: Column, own: Column) -> Column:
    """All extensions of a path's last part (``.nes.zip``), else ``own``."""
    found = F.regexp_extract(path, r"[^.]+((\.[a-zA-Z0-9]+)+)$", 1)
    return F.when(found == "", own).otherwise(found)


def kept_basename(entry: Column, path: Column, own: Column) -> Column:
    """Name of an archive that stays one: the entry's name and the archive's extensions.

    Of several extensions, those that end the entry's name already are not repeated.
    """
    extensions = kept_extension(path, own)
    inner = F.regexp_replace(extensions, r"\.[^.]*$", "")
    return F.when((inner != "") & F.endswith(entry, inner), F.concat(entry.substr(F.lit(1), F.length(entry) - F.length(inner)), extensions)).otherwise(F.concat(entry, extensions))


def entry_path(entry: Column, member: Column) -> Column:
    """Path of a member inside the entry's archive: without the folder that the archive's own path has already, at its first place."""
    folder = F.regexp_extract(F.replace(entry, F.lit("\\"), F.lit("/")), r"^(.*)/[^/]*$", 1)
    inside = F.replace(member, F.lit("\\"), F.lit("/"))
    head = F.concat(F.when(folder == "", ".").otherwise(folder), F.lit("/"))
    at = F.instr(inside, head)
    return F.when(at > 0, F.concat(inside.substr(F.lit(1), at - 1), inside.substr(at + F.length(head), F.length(inside)))).otherwise(inside)


def mirrored_folder(path: Column, roots: tuple[str, ...]) -> Column:
    """Folder of a path relative to the roots, taken off in turn; ``.`` directly below one."""
    for root in roots:
        path = F.regexp_replace(path, f"^{re.escape(root)}[\\\\/]?", "")
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(folder != "", folder).when(path.startswith("/"), "/").otherwise(".")


#: Date tokens of a report's name and their places in ``strftime``.
DATE_TOKENS = {"YYYY": "%Y", "YY": "%y", "MMMM": "%B", "MMM": "%b", "MM": "%m", "DD": "%d", "HH": "%H", "hh": "%I", "mm": "%M", "ss": "%S"}


def report_path(template: str, now: dt.datetime) -> str:
    """A report's path with its date tokens (``%YYYY``, ``%M`` ...) filled in; unknown ones stay as their letters."""

    def fill(found: re.Match) -> str:
        token = found.group()[1:]
        if token in DATE_TOKENS:
            return now.strftime(DATE_TOKENS[token])
        plain = {"M": now.month, "D": now.day, "H": now.hour, "h": now.hour % 12 or 12, "m": now.minute, "s": now.second}
        return str(plain.get(token, token))

    filled = re.sub(r"%([a-zA-Z])\1*", fill, template)
    return re.sub(r"[\\/]", "/", re.sub(r'[<>:"|?*]', "_", filled.replace(":", ";")))


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: ``*`` and ``?`` within a part, ``**`` over parts, ``{a,b}``, ``[a-z]``; a backslash takes the next sign as it is."""
    out, at, depth = [], 0, 0
    while at < len(glob):
        c = glob[at]
        if glob.startswith("**/", at):
            out.append("(?:[^/]+/)*")
            at += 3
            continue
        if glob.startswith("**", at):
            out.append(".*")
            at += 2
            continue
        if c == "\\" and at + 1 < len(glob):
            at += 1
            out.append(re.escape(glob[at]))
        elif c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in glob[at + 2 :]:
            end = glob.index("]", at + 2)
            inside = glob[at + 1 : end]
            out.append("[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", "\\\\") + "]")
            at = end
        elif c == "{" and "}" in glob[at:]:
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        at += 1
    return "^" + "".join(out) + "$"


def matches_globs(path: Column, globs: tuple[str, ...]) -> Column:
    """True if any glob fits the path; a glob that is the path itself fits, whatever signs it has."""
    hit = F.lit(False)
    for glob in globs:
        hit = hit | (path == glob) | path.rlike(glob_pattern(glob))
    return F.coalesce(hit, F.lit(False))


def multi_file_key(name: Column) -> Column:
    """What the parts of one set share: the name before "disc", else before its last bracket, else before its last dash; first letter large."""
    lower = F.lower(name)
    cut = (
        F.when(F.instr(lower, "disc") > 0, name.substr(F.lit(1), F.instr(lower, "disc") - 1))
        .when(name.contains("("), F.regexp_extract(name, r"(?s)^(.*)\(", 1)).when(name.contains("-"), F.regexp_extract(name, r"(?s)^(.*)-", 1)).otherwise(name)
    )
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.lower(F.trim(cut))), r"-+$", ""), r"_+$", ""))
    return F.concat(F.upper(bare.substr(1, 1)), bare.substr(F.lit(2), F.length(bare)))
