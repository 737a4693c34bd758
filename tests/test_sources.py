from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from cartulary.plans import sinks
from cartulary.sources import assets as A
from cartulary.sources import catalogs as X
from cartulary.sources import patches as Z
from cartulary.streaming import landing

XML = """<?xml version="1.0"?><datafile><header><name>Cat</name></header>
<machine name="One" cloneof="Two"><description>d</description><release name="One" region="USA"/><rom name="a.bin" size="4" crc="AB" status="good"/><rom name="b.bin"/></machine>
<machine name="12"><disk name="d" sha1="ff"/><device_ref name="dev"/></machine></datafile>"""
SOFT = """<softwarelists><softwarelist name="l"><software name="s"><part name="p"><dataarea name="x"><rom name="r" size="3"/></dataarea><diskarea name="y"><disk name="k"/></diskarea></part></software></softwarelist></softwarelists>"""
CMPRO = 'clrmamepro (\n\tname "Cat \\"x\\""\n)\n\ngame (\n\tname "One Two"\n\trom ( name "a (1).bin" size 4 crc AB )\n\trom ( size x )\n)\n'


def test_catalogs(spark, tmp_path):
    for name, text in (("a.xml", XML), ("s.xml", SOFT), ("c.dat", CMPRO), ("bad.dat", 'game (\n name "x'), ("t.tsv", f"{'a' * 64}\tdir/One.bin\t{'b' * 40}\tm\tc\t9\nx\t\ty\tz\tq\t1\n")):
        (tmp_path / name).write_text(text)
    machines = {r.name: r for r in X.read_datafile(spark, f"{tmp_path}/a.xml").collect()}
    assert set(machines) == {"One", "12"} and machines["One"].members[0].crc32 == "AB" and machines["One"].members[1]["size"] == 0
    assert machines["12"].disks[0].sha1 == "ff" and machines["12"].device_refs == ["dev"] and machines["One"].release[0].region == "USA"
    soft = X.read_softwarelist(spark, f"{tmp_path}/s.xml").first()
    assert soft.members[0].name == "r" and soft.disks[0].name == "k"
    read = X.read_cmpro(spark, [f"{tmp_path}/c.dat", f"{tmp_path}/bad.dat"]).collect()
    assert [(r.path.rsplit("/", 1)[-1], r.error) for r in read if r.error] == [("bad.dat", "unclosed quote")]
    cm = [r for r in read if not r.error]
    assert [(r.name, [(m.name, m["size"], m.crc32) for m in r.members]) for r in cm] == [("One Two", [("a (1).bin", 4, "AB"), ("", 0, None)])]
    assert [(r.entry, r["size"]) for r in X.read_smdb(spark, f"{tmp_path}/t.tsv").collect()] == [("dir/One", 9)]
    flat = X.catalog_members(X.read_datafile(spark, f"{tmp_path}/a.xml"))
    assert flat.count() == 3
    cats = spark.createDataFrame([("b", None), ("A", "old"), ("a", "x")], "name string, description string")
    assert [r.name for r in X.sort_catalogs(X.filter_catalogs(cats, exclude=("old",))).collect()] == ["a", "b"]


def test_files_and_archives(spark, tmp_path):
    data = {"one.bin": b"hello", "two.bin": b"", "n.nes": bytes.fromhex("4E45531A") + bytes(12) + b"body", "wrong.txt": b"PK\x05\x06" + bytes(18)}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / ".DS_Store").write_bytes(b"x")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/in.bin", b"inside")
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04 broken")
    (tmp_path / "g.bin.gz").write_bytes(gzip.compress(b"zipped"))
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as t:
        info = tarfile.TarInfo("t.bin")
        info.size = 3
        t.addfile(info, io.BytesIO(b"tar"))
    (tmp_path / "t.tar.gz").write_bytes(buffer.getvalue())
    assert A.list_files(spark, [str(tmp_path)]).count() == 7
    assert A.list_files(spark, [str(tmp_path)], [f"{tmp_path}/one.bin"]).count() == 6
    files = A.read_files(spark, [str(tmp_path)]).cache()
    digests = {r.path.rsplit("/", 1)[-1]: r for r in A.with_digests(files).collect()}
    assert digests["one.bin"].crc32 == f"{zlib.crc32(b'hello'):08x}" and "two.bin" not in digests
    head = {r.path.rsplit("/", 1)[-1]: r for r in A.with_headerless(files).collect()}
    assert head["n.nes"].header.name == "NES" and head["n.nes"].crc32_headerless == f"{zlib.crc32(b'body'):08x}" and head["one.bin"].header is None
    pads = {r.path.rsplit("/", 1)[-1]: r.paddings for r in A.with_paddings(files, F.lit(True)).collect()}
    assert [(p.padded_size, p.crc32) for p in pads["one.bin"]] == [(8, f"{zlib.crc32(b'hello' + bytes(3)):08x}"), (8, f"{zlib.crc32(b'hello' + b'\xff' * 3):08x}")]
    assert {r.path.rsplit("/", 1)[-1]: r.right for r in A.corrected_extensions(files).collect()} == {"wrong.txt": ".zip"}
    inside = {(r.archive, r.entry_path): (r["size"], r.crc32) for r in A.expand_archives(files).where("error is null").collect()}
    assert inside == {("zip", "d/in.bin"): (6, f"{zlib.crc32(b'inside'):08x}"), ("gz", "g.bin"): (6, f"{zlib.crc32(b'zipped'):08x}"), ("tar", "t.bin"): (3, f"{zlib.crc32(b'tar'):08x}")}
    assert A.expand_archives(files, quick=True).where("error is not null").count() == 1
    cache = A.with_digests(files.where("path like '%one.bin'")).withColumn("crc32", F.lit("cached")).drop("content")
    cached = {r.path.rsplit("/", 1)[-1]: r.crc32 for r in A.with_missing_digests(files, cache).collect()}
    assert cached["one.bin"] == "cached" and cached["n.nes"] != "cached"


def number(n):
    out = b""
    while True:
        low, n = n & 0x7F, n >> 7
        if n == 0:
            return out + bytes([low | 0x80])
        out += bytes([low])
        n -= 1


def number_big(n):
    out = bytes([n & 0x7F])
    while n := n >> 7:
        out = bytes([n & 0x7F | 0x80]) + out
    return out


def test_patches(spark):
    source = b"0123456789"
    ips = b"PATCH" + b"\0\0\2" + b"\0\3" + b"abc" + b"\0\0\x0c" + b"\0\0" + b"\0\2" + b"z" + b"EOF"
    assert Z.apply_patch(source, "x.ips", ips) == b"01abc56789\0\0zz"
    target = b"01x3456789!"
    ups = b"UPS1" + number(10) + number(11) + number(2) + bytes([ord("2") ^ ord("x"), 0]) + number(6) + bytes([ord("!"), 0]) + bytes(12)
    assert Z.apply_patch(source, "x.ups", ups) == target
    bps = b"BPS1" + number(10) + number(8) + number(0) + number((2 - 1) << 2) + number(((1 - 1) << 2) | 1) + b"Q" + number(((3 - 1) << 2) | 2) + number(5 << 1) + number(((2 - 1) << 2) | 3) + number(0) + bytes(12)
    assert Z.apply_patch(source, "x.bps", bps) == b"01Q56701"
    aps = b"APS10" + bytes(56) + (3).to_bytes(4, "little") + b"\2" + b"xy" + (0).to_bytes(4, "little") + b"\0" + b"k\2"
    assert Z.apply_patch(source, "x.aps", aps) == b"kk2xy56789"
    ppf = b"PPF30\2" + bytes(50) + bytes([0, 0, 0, 0]) + (4).to_bytes(8, "little") + b"\2" + b"PQ"
    assert Z.apply_patch(source, "x.ppf", ppf) == b"0123PQ6789"
    sections = (b"ab!", bytes([0x13 + 1, 1 + 2, 0, 3, 0x13 + 1]), bytes([5, 4]))  # copy 4, add 2, run 3, copy 4
    body = number_big(13) + b"\0" + b"".join(number_big(len(x)) for x in sections) + b"".join(sections)
    delta = b"\xd6\xc3\xc4\0\0" + b"\1" + number_big(10) + number_big(0) + number_big(len(body)) + body
    assert Z.apply_patch(source, "x.xdelta", delta) == b"5678ab!!!4567"
    assert len(Z._default_codes()) == 256
    with pytest.raises(Z.PatchError):
        Z.apply_patch(b"short", "x.ups", ups)
    with pytest.raises(Z.PatchError):
        Z.apply_patch(source, "x.bps", b"BPS1")
    meta = Z.patch_metadata("d/Fix [aabbccdd].ips", ips)
    assert meta["format"] == "ips" and meta["crc_before"] == "aabbccdd"
    pairs = spark.createDataFrame([(1, source, "x.ips", ips), (2, b"no", "x.ups", ups)], "id bigint, source binary, path string, patch binary")
    got = {r.id: (r["size"], r.error is None) for r in Z.patched_contents(pairs).collect()}
    assert got == {1: (14, True), 2: (None, False)}
    files = spark.createDataFrame([("b.ips", ips), ("a.ips", ips), ("n.txt", b"no")], "path string, content binary")
    assert [r.path for r in Z.read_patches(files).collect()] == ["a.ips"]


def test_sinks_and_actions(spark, tmp_path):
    (tmp_path / "in.bin").write_bytes(b"x")
    plan = spark.createDataFrame([(f"{tmp_path}/in.bin", "o/out.bin"), (f"{tmp_path}/none.bin", "o/none.bin")], "input string, output string")
    assert {r.result for r in sinks.execute_plan(plan, str(tmp_path)).collect()} == {"planned"}
    done = {r.target.rsplit("/", 1)[-1]: r.result[:5] for r in sinks.execute_plan(plan, str(tmp_path), dry_run=False).collect()}
    assert done == {"out.bin": "done", "none.bin": "error"} and (tmp_path / "o/out.bin").read_bytes() == b"x"


def test_stream_of_scans(spark, tmp_path):
    rows = spark.createDataFrame([(1, "s", "a.bin", 5, "ab", None, None, None)], "file_id bigint, source string, relative string, size bigint, crc32 string, md5 string, sha1 string, sha256 string")
    rows.write.parquet(f"{tmp_path}/in")
    members = spark.createDataFrame([(7, 5, "000000ab", None, None, None)], "rom_id bigint, size bigint, crc32 string, md5 string, sha1 string, sha256 string")
    got = []
    query = landing.match_stream(landing.landed_files(spark, f"{tmp_path}/in", rows.schema), members, lambda df, n: got.extend((r.rom_id, r.file_id) for r in df.collect()), f"{tmp_path}/ck")
    query.awaitTermination(120)
    assert got == [(7, 1)]
