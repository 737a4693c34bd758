"""Sinks: CSV reports, XML catalogs, playlists, JSON plans; file actions only on request."""

from __future__ import annotations

import hashlib
import os
import shutil
import tarfile
import zipfile
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions import names as N
from cartulary.session import checkpointed

#: Columns of the report, in order.
REPORT = ("DAT Name", "Game Name", "Status", "ROM Files", "Patched", "BIOS", "Retail Release", "Unlicensed", "Debug", "Demo", "Beta", "Sample", "Prototype",
          "Program", "Aftermarket", "Homebrew", "Bad")


def report_rows(status: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Rows of the report, all text: entries with their status, then files that no entry uses (``path, usage``)."""
    name, category, maker = F.col("name"), F.col("category"), F.col("manufacturer")
    flags = [N.flag(w.lower(), name, category, maker).cast("string").alias(w) for w in REPORT[7:]]
    rows = status.select(
        F.col("dat_id").cast("string").alias("DAT Name"), name.alias("Game Name"), F.col("status").alias("Status"), F.coalesce(F.col("files"), F.lit("")).alias("ROM Files"),
        F.lit("false").alias("Patched"), N.is_bios(F.col("isbios"), name).cast("string").alias("BIOS"), N.is_retail(name, category, maker).cast("string").alias("Retail Release"), *flags)
    if files is None:
        return rows
    rest = files.where(F.col("usage") != "used").select(
        F.lit("").alias("DAT Name"), F.lit("").alias("Game Name"), F.upper("usage").alias("Status"), F.col("path").alias("ROM Files"), *[F.lit("false").alias(c) for c in REPORT[4:]])
    return rows.unionByName(rest)


def write_report(rows: DataFrame, path: str) -> None:
    """The report as CSV parts with a header."""
    rows.write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)


def catalog_xml(entries: DataFrame, members: DataFrame) -> DataFrame:
    """``dat_id, game`` structs for the XML writer; references are kept only if the catalog has the parent."""
    listed = members.groupBy(F.col("game_id").alias("m_id")).agg(F.array_sort(F.collect_list(F.struct(
        "ord", F.col("name").alias("_name"), F.col("size").alias("_size"), F.col("crc32").alias("_crc"), F.col("md5").alias("_md5"), F.col("sha1").alias("_sha1"), F.col("status").alias("_status")))).alias("roms"))
    known = entries.select(F.col("dat_id").alias("k_dat"), F.col("name").alias("k_name")).distinct()
    rows = entries.join(known, (F.col("dat_id") == F.col("k_dat")) & (F.col("cloneof") == F.col("k_name")), "left").join(listed, F.col("game_id") == F.col("m_id"), "left")
    rom = F.transform("roms", lambda r: r.dropFields("ord"))
    return rows.select("dat_id", F.col("name").alias("_name"), F.when(N.is_bios(F.col("isbios"), F.col("name")), "yes").alias("_isbios"), F.col("k_name").alias("_cloneof"), "description", "category", "manufacturer", rom.alias("rom"))


def write_xml(rows: DataFrame, path: str) -> None:
    """A catalog as XML: ``game`` elements below ``datafile``."""
    rows.drop("dat_id").write.mode("overwrite").format("xml").option("rootTag", "datafile").option("rowTag", "game").option("attributePrefix", "_").save(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def run_summary(plan: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: planned members, entries, bytes and the skip breakdown as JSON."""
    totals = plan.agg(F.count("*").alias("members"), F.count_distinct("game_id").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    reasons = skipped.agg(F.to_json(F.array_sort(F.collect_list(F.struct((-F.col("files")).alias("order"), "reason", "files")))).alias("skipped"))
    return totals.crossJoin(reasons)  # one row each


ACTIONS = ("copy", "move", "link", "extract", "zip", "test")


def safe_target(root: str, output: str) -> str | None:
    """The place of an output below the root, or None if its path leads out of it."""
    base = os.path.abspath(root)
    target = os.path.abspath(os.path.join(base, output))
    return target if output and not os.path.isabs(output) and target.startswith(base.rstrip(os.sep) + os.sep) else None


def _finish(target: str, make: Callable[[str], None]) -> str:
    """Make a file beside its place and move it there; a task that runs twice ends in the same state."""
    os.makedirs(os.path.dirname(target), exist_ok=True)
    part = f"{target}.{os.getpid()}.part"
    try:
        make(part)
        os.replace(part, target)
    finally:
        if os.path.lexists(part):
            os.unlink(part)
    return "done"


def _unpack(archive: str, inside: str, part: str) -> None:
    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as opened, opened.open(inside) as source, open(part, "wb") as out:
            shutil.copyfileobj(source, out)
        return
    with tarfile.open(archive) as opened, opened.extractfile(inside) as source, open(part, "wb") as out:
        shutil.copyfileobj(source, out)


def _zip(rows: pd.DataFrame, part: str) -> None:
    """A zip of the inputs in the order of their paths, dates fixed, so that equal contents make equal archives."""
    with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as archive:
        for row in rows.sort_values("entry_path", key=lambda c: c.str.lower()).itertuples():
            info = zipfile.ZipInfo(row.entry_path, (1996, 12, 24, 23, 32, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            with open(row.input, "rb") as source, archive.open(info, "w", force_zip64=True) as out:
                shutil.copyfileobj(source, out)


def execute_plan(plan: DataFrame, root: str, action: str = "copy", dry_run: bool = True) -> DataFrame:
    """``input, target, result``: rows ``input, output`` carried out on the executors below ``root``; by default only what would be done.

    ``copy``, ``move`` and ``link`` place one input at one output.  ``extract`` takes
    ``inside`` out of an archive.  ``zip`` puts all inputs of one output into it under
    their ``entry_path``, one task an archive.  ``test`` compares a written file with
    its expected ``sha1`` and ``size``, of which nulls never fail.  An output whose path
    leads out of the root is refused.  Results are written once, so looking at them again
    does nothing again; a row that fails says why and stops no other.
    """
    if action not in ACTIONS:
        raise ValueError(action)
    extra = {"extract": ["inside"], "zip": ["entry_path"], "test": ["sha1", "size"]}.get(action, [])

    def one(row, target: str) -> str:
        if action == "zip":
            return _finish(target, lambda part: _zip(row, part))
        if action == "test":
            digest, size = hashlib.sha1(), os.path.getsize(target)
            with open(target, "rb") as source:
                while piece := source.read(1 << 20):
                    digest.update(piece)
            right = (pd.isna(row.sha1) or row.sha1.lower() == digest.hexdigest()) and (pd.isna(row.size_) or int(row.size_) == size)
            return "passed" if right else "failed"
        if action == "extract":
            return _finish(target, lambda part: _unpack(row.input, row.inside, part))
        if action == "move" and not os.path.exists(row.input) and os.path.exists(target):
            return "done"
        result = _finish(target, lambda part: os.symlink(row.input, part) if action == "link" else shutil.copyfile(row.input, part))
        if action == "move":
            os.unlink(row.input)
        return result

    def carried(row, output: str) -> tuple[str | None, str]:
        target = safe_target(root, output or "")
        if target is None:
            return None, "refused: leads out of the root"
        if dry_run:
            return target, "planned"
        try:
            return target, one(row, target)
        except (OSError, KeyError, zipfile.BadZipFile, tarfile.TarError) as problem:
            return target, f"error: {problem}"

    def act(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            rows = [(row.input, *carried(row, row.output)) for row in batch.rename(columns={"size": "size_"}).itertuples()]
            yield pd.DataFrame(rows, columns=["input", "target", "result"])

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        target, result = carried(rows, rows["output"].iloc[0])
        return pd.DataFrame({"input": rows["input"], "target": target, "result": result})

    schema = "input string, target string, result string"
    wanted = plan.select("input", "output", *extra)
    if action == "zip":
        done = wanted.dropDuplicates(["output", "entry_path"]).groupBy("output").applyInPandas(pack, schema)
    else:
        done = wanted.dropDuplicates(["output"]).mapInPandas(act, schema)
    return done if dry_run else checkpointed(done)


def summary_lines(counts: DataFrame) -> DataFrame:
    """Readable lines of status counts."""
    share = F.when(F.col("entries") > 0, F.col("found") * 100.0 / F.col("entries")).otherwise(100.0)
    return counts.select(F.format_string("%s: %d/%d %s found (%.1f%%)", F.col("dat_id").cast("string"), "found", "entries", "kind", share).alias("line"))
