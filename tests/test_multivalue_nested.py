from __future__ import annotations

import json

import pytest

from cartulary.operators.multivalue import LANGUAGES, TITLES, split_values
from cartulary.operators import nested
from cartulary.operators.nested import SUBTYPES, flatten_nodes, level_table, parse, subtype_table, write_subtypes


def split(spark, values, field, repeat=30):
    """Values among enough others that the marks of the source are inferred."""
    usual = {LANGUAGES: ["En,Fr", "De; Es", "It|Pt", "Ja/Ko", "Nl+Sv", "Zh & Pl", "En·Fr", "Ja、Ko", "De\tFr", "En Fr De"],
             TITLES: ["Abc Def / Ghi Jkl", "Abc Def + Ghi Jkl", "Abc Def | Ghi Jkl", "Abc Def; Ghi Jkl", "Abc Def ~ Ghi Jkl", '"Abc Def", "Ghi Jkl"']}[field]
    rows = [(1000 + i, "s", v, "x") for i, v in enumerate(usual * repeat)] + [(i, "s", v, "y") for i, v in enumerate(values)] + [(i, "s", v, "z") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id bigint, src string, v string, value string")
    out = {}
    for r in split_values(df, "id", "v", "src", field).where("row_key < 1000").orderBy("row_key", "pos").collect():
        out.setdefault(r.row_key, []).append((r.pos, r.value))
    return [[v for _, v in out.get(i, [])] for i in range(len(values))], out


def test_languages(spark):
    values = ["En", None, "", " - ", "n/a", "En,", "['Pt', \"Nl\", 'Zh-Hans']", "(En, Fr)", 'Zh; "Spanish, Latin America"', "En,,Fr,En", "De / Zh | Nl;Ja", '"English / UK"', "Pt-BR Ko", "[Zh]"]
    got, positions = split(spark, values, LANGUAGES)
    assert got == [[], [], [], [], [], [], ["Pt", "Nl", "Zh-Hans"], ["En", "Fr"], ["Zh", "Spanish, Latin America"], ["En", "Fr", "En"], ["De", "Zh", "Nl", "Ja"], [], ["Pt-BR", "Ko"], []]
    assert [p for p, _ in positions[9]] == [1, 2, 3]


def test_titles(spark):
    values = [
        "Aa Bb / Cc Dd (USA) [!]", "Aa/Bb Quest (USA)", "Aa & Bb (Japan)", "Aa Bb - Cc Dd", "Aa Bb, The (World)", '"Aa / Bb" + "Cc Dd" (Europe) (En,Fr)', '"Aa / Bb" (USA)',
        '"Aa Bb","Cc, The" (USA)', '"Aa Bb" , "Cc + Dd"', "[BIOS] Aa Bb / Cc Dd", "Aa Bb\t/ Cc Dd", 'Aa "Bb / Cc', "(USA)", None, "/ / /", "Aa Bb~ Cc Dd",
    ]
    got, _ = split(spark, values, TITLES)
    assert got == [
        ["Aa Bb", "Cc Dd"], [], [], [], [], ["Aa / Bb", "Cc Dd"], [], ["Aa Bb", "Cc, The"], ["Aa Bb", "Cc + Dd"], ["[BIOS] Aa Bb", "Cc Dd"], ["Aa Bb", "Cc Dd"],
        ['Aa "Bb', "Cc"], [], [], [], ["Aa Bb", "Cc Dd"],
    ]


def test_very_long_and_empty(spark):
    long_title = " / ".join(f"Name{i} Of" for i in range(20_000)) + "".join(f" (T{i})" for i in range(3_000))
    got, _ = split(spark, [long_title], TITLES, repeat=3)
    assert len(got[0]) == 20_000 and got[0][-1] == "Name19999 Of"
    empty = spark.createDataFrame([], "id bigint, src string, v string")
    assert split_values(empty, "id", "v", "src", TITLES).count() == 0
    nulls = spark.createDataFrame([(None, None, "Aa Bb / Cc Dd")], "id bigint, src string, v string")
    assert [(r.row_key, r.value) for r in split_values(nulls, "id", "v", "src", TITLES).orderBy("pos").collect()] == [(None, "Aa Bb"), (None, "Cc Dd")]


DOC = {
    "datafile": {"game": [{"name": "a", "rom": [{}, None, {"name": 5, "size": "0x10", "crc": "1"}]}, "text", {"name": "b", "disk": {"sha1": "x"}}], "machine": {"name": "m", "rom": {"name": "r"}}},
    "softwarelists": {"softwarelist": [None, {"software": {"part": [{}, {"dataarea": [{"size": 1}, {"rom": [{"name": "q"}]}], "diskarea": {"disk": {"name": "d"}}}]}}]},
}


KEYS = ("raw_id", "root", "list_pos", "entry_tag", "entry_pos", "part_pos", "area_pos", "kind", "member_pos")


def members_of(df):
    return level_table(flatten_nodes(df), "member")


def test_nested_positions_and_tables(spark, tmp_path):
    texts = [json.dumps(DOC), None, "", "  ", "{", '{"mame": {}} {}', "[]", '"x"', "NaN", '{"datafile": ""}', "[" * 100_000, '{"mame": {"game": {"rom": {"n": NaN}}}}']
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "raw_id bigint, raw string, root string")
    got = sorted(tuple(r) for r in members_of(df).select(*KEYS).collect())
    assert got == [
        (0, "datafile", -1, "game", 0, -1, -1, "rom", 2), (0, "datafile", -1, "game", 2, -1, -1, "disk", 0), (0, "datafile", -1, "machine", 0, -1, -1, "rom", 0),
        (0, "softwarelists", 1, "software", 0, 1, 0, "disk", 0), (0, "softwarelists", 1, "software", 0, 1, 1, "rom", 0),
    ]
    nodes = flatten_nodes(df).cache()
    summed = subtype_table(nodes, "member", "summed").collect()
    assert [(r.name, r["size"], r.crc) for r in summed] == [("5", 16, "1")]
    assert {(r.level, r.variant) for r in nodes.collect()} == {
        ("list", "stocked"), ("entry", "direct"), ("entry", "composed"), ("part", "alone"), ("part", "housed"), ("area", "vacant"), ("area", "filled"),
        ("member", "summed"), ("member", "digested"), ("member", "plain")}
    write_subtypes(nodes, str(tmp_path / "nodes"))
    kept = spark.read.parquet(str(tmp_path / "nodes"))
    for level, variant in SUBTYPES:
        assert sorted(map(str, subtype_table(kept, level, variant).collect())) == sorted(map(str, subtype_table(nodes, level, variant).collect()))
    assert members_of(df.limit(0)).count() == 0
    assert parse('{"a": 1' + "0" * 5_000 + "}") is not None


def test_deep_texts_and_lone_surrogates_lose_nothing(spark):
    deep = '{"mame": {"game": {"name": "g", "rom": {"name": "r", "extra": ' + '[{"x":' * 20_000 + "1" + "}]" * 20_000 + "}}}}"
    odd = r'{"mame": {"game": {"rom": [{"name": "\ud83d x", "\udc00": "\ud83d\ude00"}]}}}'
    df = spark.createDataFrame([(1, deep), (2, odd), (3, deep[:-1])], "raw_id bigint, raw string")
    got = members_of(df).orderBy("raw_id").collect()
    assert [(r.raw_id, r.name) for r in got] == [(1, "r"), (2, "\ufffd x")]
    fields = flatten_nodes(df).where("raw_id = 2 AND level = 'member'").first().fields
    assert fields["\ufffd"] == "\U0001f600"


def test_deep_parser_agrees_with_the_decoder():
    good = ["{}", "[]", ' {"a":[1,2.5,{"b":null,"c":"\\u00e9\\ud83d"}],"d":true} ', '"x"', "-0.5e+10", "[[],{}]", '{"a":1,"a":[2]}']
    assert [nested._parse_deep(x) for x in good] == [json.loads(x, parse_int=str, parse_float=str) for x in good]
    for bad in ("{", '{"a":1,}', "[1,]", "[01]", '{"a" 1}', '"\\x"', "nul", "[1 2]", '{"a":1}}', "[+1]", "[1.]", "[.5]", '["\t"]', "", "{1:2}"):
        with pytest.raises(ValueError):
            nested._parse_deep(bad)


def test_automaton_is_its_tables():
    """Every symbol that a route leads to is passed through or has transitions, every state has its table."""
    reached = {under for keys in nested.ROUTES.values() for under in keys.values()}
    assert reached - set(nested.TRANSITIONS) == {"lists"}
    assert {(nested.LEVEL_OF[s], state) for s, rules in nested.TRANSITIONS.items() for _, state in rules} == set(SUBTYPES)


def test_batches_are_cut_inside_a_text(spark, monkeypatch):
    text = json.dumps({"mame": {"game": [{"rom": [{"name": str(i)} for i in range(20_000)]}]}})
    assert members_of(spark.createDataFrame([(1, text)], "raw_id bigint, raw string")).count() == 20_000
