"""Guides with faults against a plain walk of the schema, and web app manifests."""

import json
import re

import pytest

from sitelens.operators import schema as S

SHAPE = {
    "type": "object",
    "required": ["version", "colours"],
    "properties": {
        "version": {"type": "string", "pattern": r"^\d+$"},
        "kind": {"enum": ["url", "name", None]},
        "by": {"const": "scan"},
        "colours": {
            "type": "array",
            "minItems": 1,
            "items": {"type": "object", "required": ["hex"], "properties": {"hex": {"type": "string", "pattern": "^#[0-9a-f]{6}$"}, "share": {"type": "number", "minimum": 0, "maximum": 1}}},
        },
        "logo": {"type": ["object", "null"], "required": ["url"], "properties": {"url": {"type": "string"}}},
        "roles": {"type": "object", "properties": {"fixed": {"type": "boolean"}}, "additionalProperties": {"type": ["string", "null"]}},
        "pages": {"type": "integer", "minimum": 4, "maximum": 24},
    },
}

GUIDES = [
    '{"version": "1", "colours": [{"hex": "#00ff00"}]}',
    '{"version": 1, "colours": []}',
    '{"version": "x1", "kind": "other", "by": "hand", "colours": [{"hex": "red", "share": 1.5}, 7, {"share": -1}, {"hex": null}], "pages": 3, "extra": {"a": [1]}}',
    '{"version": "1", "kind": null, "by": "scan", "colours": {"0": 1}, "logo": null, "pages": 24.5}',
    '{"version": "1", "colours": [{"hex": "#00ff00"}], "logo": {"link": 1}, "roles": {"fixed": "no", "a": "x", "b": null, "c": 4, "d": ["x"]}, "pages": "many"}',
    '{"colours": [{"hex": "#00ff00", "share": 0}, {"hex": "#00ff00", "share": 1}], "logo": [], "roles": null}',
    "[]",
    "null",
    '"text"',
    "{broken",
    None,
    "",
]


def plain(value, s, path="$"):
    kind = {dict: "object", list: "array", str: "string", int: "number", float: "number", bool: "boolean", type(None): "null"}[type(value)]
    js = lambda x: json.dumps(x, separators=(",", ":"))
    wants = s.get("type")
    if wants and not any(w == kind or w == "integer" for w in ([wants] if isinstance(wants, str) else wants)):
        return [(path, f"{path}: expected {wants if isinstance(wants, str) else ','.join(wants)}, got {kind}")]
    out = []
    if "enum" in s and value not in s["enum"]:
        out.append(f"{path}: {js(value)} is not one of {js(s['enum'])}")
    if "const" in s and value != s["const"]:
        out.append(f"{path}: expected {js(s['const'])}, got {js(value)}")
    if kind == "string" and "pattern" in s and not re.search(s["pattern"], value):
        out.append(f'{path}: "{value}" does not match {s["pattern"]}')
    if kind == "number":
        out += [f"{path}: {js(value)} < minimum {s['minimum']}"] * (value < s.get("minimum", value)) + [f"{path}: {js(value)} > maximum {s['maximum']}"] * (value > s.get("maximum", value))
    if kind == "array":
        out += [f"{path}: needs at least {s.get('minItems')} item(s)"] * (len(value) < s.get("minItems", 0))
    out = [(path, x) for x in out]
    if kind == "object":
        out += [(path, f"{path}.{k}: required property is missing") for k in s.get("required", []) if k not in value]
        for k, v in value.items():
            sub = s.get("properties", {}).get(k) or s.get("additionalProperties")
            out += plain(v, sub, f"{path}.{k}") if sub else []
    if kind == "array" and "items" in s:
        for i, v in enumerate(value):
            out += plain(v, s["items"], f"{path}[{i}]")
    return out


def test_faults_have_paths(spark):
    df = spark.createDataFrame([(i, g, "x", 0) for i, g in enumerate(GUIDES)], "id bigint, guide string, path string, node int")
    got = sorted(tuple(r) for r in S.faults_of(df, SHAPE).collect())
    want = []
    for i, g in enumerate(GUIDES):
        try:
            want += [(i, *x) for x in plain(json.loads(g or ""), SHAPE)]
        except ValueError:
            want.append((i, "$", "$: not JSON"))
    assert got == sorted(want)
    assert not [r for r in got if r[0] == 0] and (2, "$.colours[0].hex", '$.colours[0].hex: "red" does not match ^#[0-9a-f]{6}$') in got
    assert S.faults_of(df.filter("false"), SHAPE).count() == 0
    assert S.faults_of(df.unionByName(df), SHAPE).count() == 2 * len(got)


@pytest.mark.parametrize("levels, shape", [(1, {"type": "string"}), (2, {"type": "array", "items": {"enum": [1]}}), (4, SHAPE | {"properties": {"a": {"properties": {"b": {"properties": {"c": {}}}}}}})])
def test_a_schema_has_as_many_levels_as_it_nests(levels, shape):
    assert S.flattened(shape)[2] == levels


def test_manifests(spark):
    text = '{"short_name": "Lumo", "name": "", "theme_color": "#102030", "display": "standalone", "icons": [{"src": "i/a.png", "sizes": "48x48"}, {"src": ""}, {"src": "/b.svg", "purpose": "any maskable", "type": "image/svg+xml"}]}'
    rows = [("https://lumo.example/app/site.webmanifest", text), ("https://a.example/m", "[1]"), ("https://b.example/m", "{"), ("https://c.example/m", None), ("https://d.example/m", "{}")]
    got = {r.url: r for r in S.manifests_of(spark.createDataFrame(rows, "url string, text string")).collect()}
    assert set(got) == {rows[0][0], "https://d.example/m"}
    m = got[rows[0][0]]
    assert (m.name, m.short_name, m.theme_color, m.display, m.description) == ("Lumo", "Lumo", "#102030", "standalone", None)
    assert [tuple(i) for i in m.icons] == [("https://lumo.example/app/i/a.png", "48x48", None, None), ("https://lumo.example/b.svg", None, "image/svg+xml", "any maskable")]
    assert m.maskable.url == "https://lumo.example/b.svg" and got["https://d.example/m"].icons == [] and got["https://d.example/m"].maskable is None
