"""Deeply nested records to related typed tables, routed by a tree automaton over object shapes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Below which symbol which keys lead to which symbol.  A text's value is the ``document``.
ROUTES = {
    "document": {"datafile": "flat", "mame": "flat", "softwarelist": "parted", "softwarelists": "lists"},
    "lists": {"softwarelist": "parted"},
    "flat": {"game": "entry", "machine": "entry"},
    "parted": {"software": "set"},
    "entry": {"rom": "member", "disk": "member"},
    "set": {"part": "part"},
    "part": {"dataarea": "area", "diskarea": "area"},
    "area": {"rom": "member", "disk": "member"},
}
#: Symbols whose key holds one object; below all others a list of objects or a lone one may stand.
SINGLE = ("document",)

#: The transitions: a node under a symbol takes the first state of which one of the states named occurs
#: below it, or one of the fields named is given; ``()`` asks for nothing.  A node without a state is
#: none, and nothing below it is.  A symbol without transitions is passed through and makes no row.
TRANSITIONS = {
    "member": ((("md5", "sha1", "sha256"), "digested"), (("crc",), "summed"), (("*",), "plain")),
    "area": ((("digested", "summed", "plain"), "filled"), ((), "vacant")),
    "part": ((("filled",), "housed"), (("vacant",), "hollow"), ((), "alone")),
    "entry": ((("digested", "summed", "plain"), "direct"), ((), "empty")),
    "set": ((("housed",), "composed"), (("hollow", "alone"), "outlined"), ((), "empty")),
    "flat": ((("direct",), "stocked"), (("empty",), "listed"), ((), "blank")),
    "parted": ((("composed",), "stocked"), (("outlined", "empty"), "listed"), ((), "blank")),
}
#: Levels of the common supertype by symbol; their order is that of the parent links.
LEVEL_OF = {"flat": "list", "parted": "list", "entry": "entry", "set": "entry", "part": "part", "area": "area", "member": "member"}
LEVELS = ("list", "entry", "part", "area", "member")

KEY_COLUMNS = ("raw_id", "root", "list_pos", "entry_tag", "entry_pos", "part_pos", "area_tag", "area_pos", "kind", "member_pos")
NODE_SCHEMA = (
    "raw_id bigint, root string, list_pos bigint, entry_tag string, entry_pos bigint, part_pos bigint, "
    "area_tag string, area_pos bigint, kind string, member_pos bigint, level string, variant string, fields map<string,string>"
)

_HEAD = {"name": "string", "description": "string"}
_ENTRY = {**_HEAD, "cloneof": "string", "romof": "string"}
_MEMBER = {"name": "string", "size": "bigint", "status": "string", "merge": "string"}
#: Typed fields of each structural variant.
SUBTYPES = {
    **{("list", v): _HEAD for v in ("stocked", "listed", "blank")},
    **{("entry", v): _ENTRY for v in ("direct", "empty", "composed", "outlined")},
    **{("part", v): {"name": "string", "interface": "string"} for v in ("housed", "hollow", "alone")},
    **{("area", v): {"name": "string", "size": "bigint"} for v in ("filled", "vacant")},
    ("member", "digested"): {**_MEMBER, "crc": "string", "md5": "string", "sha1": "string", "sha256": "string"},
    ("member", "summed"): {**_MEMBER, "crc": "string"},
    ("member", "plain"): _MEMBER,
}


# -- parsing --------------------------------------------------------------------


def _reject(name: str) -> Any:
    raise ValueError(name)


_SPACE = re.compile(r"[ \t\n\r]*+")
_SCALAR = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][-+]?[0-9]++)?+|true|false|null')
_WORDS = {"true": True, "false": False, "null": None}


def _parse_deep(text: str) -> Any:
    """One JSON value with an explicit stack, for texts nested deeper than the decoder can recurse; ValueError if it is none."""
    end, at = len(text), _SPACE.match(text).end()
    stack: list[tuple[Any, str | None]] = []
    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            at = _SPACE.match(text, at + 1).end()
            value: Any = {} if c == "{" else []
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                name = None
                if c == "{":
                    name, at = _name(text, at)
                stack.append((value, name))
                continue
            at += 1
        else:
            found = _SCALAR.match(text, at)
            if not found:
                raise ValueError(at)
            at, token = found.end(), found.group()
            value = json.loads(token) if token[0] == '"' else _WORDS.get(token, token)
        while True:  # the value is whole: hand it to what holds it
            at = _SPACE.match(text, at).end()
            if not stack:
                if at != end:
                    raise ValueError(at)
                return value
            holder, name = stack.pop()
            if isinstance(holder, dict):
                holder[name] = value
            else:
                holder.append(value)
            c = text[at : at + 1]
            if c == ",":
                at = _SPACE.match(text, at + 1).end()
                if isinstance(holder, dict):
                    name, at = _name(text, at)
                stack.append((holder, name))
                break
            if c != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError(at)
            value, at = holder, at + 1


def _name(text: str, at: int) -> tuple[str, int]:
    found = _SCALAR.match(text, at)
    if not found or text[at] != '"':
        raise ValueError(at)
    at = _SPACE.match(text, found.end()).end()
    if text[at : at + 1] != ":":
        raise ValueError(at)
    return json.loads(found.group()), _SPACE.match(text, at + 1).end()


def parse(text: str | None) -> Any:
    """The one JSON value that ``text`` is, or None; numbers keep their spelling; any depth."""
    if not text or text.isspace():
        return None
    try:
        return json.loads(text, parse_int=str, parse_float=str, parse_constant=_reject)
    except RecursionError:
        pass
    except ValueError:
        return None
    try:
        return _parse_deep(text)
    except ValueError:
        return None


# -- the automaton ----------------------------------------------------------------


def _given(node: dict, name: str) -> bool:
    return bool(node) if name == "*" else node.get(name) not in (None, "")


def _children(value: Any, single: bool) -> list[tuple[int, dict]]:
    """Objects of a value with their places: the lone object at 0, or those of an array."""
    if isinstance(value, dict):
        return [(0, value)]
    if isinstance(value, list) and not single:
        return [(i, x) for i, x in enumerate(value) if isinstance(x, dict)]
    return []


class ShapeAutomaton:
    """The bottom-up tree automaton of ``ROUTES`` and ``TRANSITIONS``.

    A run classifies the nodes below a node before the node itself: their states and
    the node's own fields decide its state.  Nodes are yielded children first, with
    the places on the way from the root.
    """

    def __init__(self, routes: dict = ROUTES, transitions: dict = TRANSITIONS) -> None:
        self.routes, self.transitions = routes, transitions

    def state(self, symbol: str, node: dict, below: set[str]) -> str | None:
        """The state of a node under a symbol, from the states below it and its fields; None if no transition fits."""
        for asked, state in self.transitions[symbol]:
            if not asked or not below.isdisjoint(asked) or any(_given(node, name) for name in asked):
                return state
        return None

    def run(self, document: Any) -> Iterator[tuple[tuple, str, str, dict]]:
        """``(way, level, state, node)`` of every accepted node; ``way`` is the ``(key, place)`` of each level, outermost first."""
        if isinstance(document, dict):
            yield from self._below("document", document, (), set())

    def _below(self, symbol: str, node: dict, way: tuple, states: set[str]) -> Iterator[tuple]:
        """Accepted nodes under ``node``; ``states`` takes those of its children."""
        for key, under in self.routes.get(symbol, {}).items():
            for place, child in _children(node.get(key), symbol in SINGLE):
                here = (*way, (key, place))
                found: set[str] = set()
                yield from self._below(under, child, here, found)
                if under in self.transitions:
                    state = self.state(under, child, found)
                    if state is not None:
                        states.add(state)
                        yield here, LEVEL_OF[under], state, child


def _keys(way: tuple) -> tuple:
    """The key columns behind ``raw_id`` of a way; -1 for levels that the root lacks, null for tags not reached."""
    root = way[0][0]
    lists = root == "softwarelists"
    rest = way[2:] if lists else way[1:]
    at = way[1][1] if lists and len(way) > 1 else -1
    tag, place = rest[0] if rest else (None, -1)
    if root in ("datafile", "mame"):
        part, area, member = -1, (None, -1), rest[1] if len(rest) > 1 else (None, -1)
    else:
        part = rest[1][1] if len(rest) > 1 else -1
        area = rest[2] if len(rest) > 2 else (None, -1)
        member = rest[3] if len(rest) > 3 else (None, -1)
    return (root, at, tag, place, part, *area, *member)


def _scalars(node: dict) -> list[tuple[str, str | None]]:
    return [(k, v if v is None or isinstance(v, str) else json.dumps(v)) for k, v in node.items() if not isinstance(v, (dict, list))]


def _sound(text: str | None) -> str | None:
    """``text`` with paired surrogates joined and lone ones replaced, as UTF-8 has no place for them."""
    return text and text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


_ARROW = pa.schema(
    [(c, pa.string() if c in ("root", "entry_tag", "area_tag", "kind") else pa.int64()) for c in KEY_COLUMNS]
    + [("level", pa.string()), ("variant", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))]
)
#: Nodes of one Arrow batch, and texts read at once.
ROWS, TEXTS = 8_192, 64


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    try:
        fields = pa.array(columns[-1], _ARROW.field("fields").type)
    except UnicodeEncodeError:
        fields = pa.array([[(_sound(k), _sound(v)) for k, v in pairs] for pairs in columns[-1]], _ARROW.field("fields").type)
    return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns[:-1], _ARROW)), fields], schema=_ARROW)


def _route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every accepted node as a row of keys, level, variant and fields; batches are cut by rows, inside a text too."""
    automaton = ShapeAutomaton()
    rows: list[tuple] = []
    for batch in batches:
        for lo in range(0, batch.num_rows, TEXTS):
            part = batch.slice(lo, TEXTS)
            for raw_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                for way, level, state, node in automaton.run(parse(text)):
                    rows.append((raw_id, *_keys(way), level, state, _scalars(node)))
                    if len(rows) >= ROWS:
                        yield _batch(rows)
                        rows = []
    if rows:
        yield _batch(rows)


def flatten_nodes(df: DataFrame, key: str = "raw_id", text: str = "raw") -> DataFrame:
    """The common supertype table: keys, level, structural variant and scalar fields of every accepted node.

    Null, empty and invalid texts, texts with more than one value, and objects
    without a known root give nothing; null, empty and scalar members are no
    members but keep their place; a lone object is at place 0; a level that the
    root lacks is -1.  Texts may be nested to any depth.  Escaped surrogates without
    a partner become the replacement character.  Of a key that an object repeats the
    last one counts.  No shuffle; a text is parsed once, and the only Python in the
    plan is this one Arrow map, as a run of the automaton recurses over unbounded shapes.
    """
    return df.select(F.col(key).cast("bigint").alias("raw_id"), F.col(text).alias("raw")).where(F.length("raw") > 0).mapInArrow(_route, NODE_SCHEMA)


def _typed(name: str, kind: str) -> Column:
    raw = F.try_element_at(F.col("fields"), F.lit(name))
    if kind != "bigint":
        return raw.alias(name)
    plain = F.lower(F.trim(raw))
    hexed = F.when(plain.rlike("^0x[0-9a-f]{1,15}$"), F.conv(F.substring(plain, 3, 15), 16, 10).try_cast("bigint"))
    return F.when(plain.startswith("0x"), hexed).otherwise(plain.try_cast("bigint")).alias(name)


def subtype_table(nodes: DataFrame, level: str, variant: str) -> DataFrame:
    """The typed table of one structural variant, with the keys that tie it to its parents.

    A size is a decimal or (with 0x, up to 15 digits) hexadecimal number, else null.
    """
    fields = SUBTYPES[(level, variant)]
    return nodes.where((F.col("level") == level) & (F.col("variant") == variant)).select(*KEY_COLUMNS, *[_typed(n, k) for n, k in fields.items()])


def level_table(nodes: DataFrame, level: str) -> DataFrame:
    """All subtype tables of a level as one: keys, ``variant``, and the typed fields of any of them, null where a variant has none.

    Each node is routed by its variant to the fields of its own table; it is one
    pass over ``nodes``, where a union of the tables would read them once for each.
    """
    own = {v: f for (l, v), f in SUBTYPES.items() if l == level}
    names = {n: k for f in own.values() for n, k in f.items()}
    typed = [
        reduce(lambda c, v: c.when(F.col("variant") == v, _typed(n, k)), [v for v, f in own.items() if n in f], F.when(F.lit(False), F.lit(None).cast(k))).alias(n)
        for n, k in names.items()
    ]
    return nodes.where((F.col("level") == level) & F.col("variant").isin(*own)).select(*KEY_COLUMNS, "variant", *typed)


def write_subtypes(nodes: DataFrame, folder: str) -> None:
    """The nodes as Parquet, a folder for each level and variant, so that ``subtype_table`` over it reads its own rows alone."""
    nodes.write.mode("overwrite").partitionBy("level", "variant").parquet(folder)
