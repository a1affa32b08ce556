"""The shredder on documents of any size and depth; one never stops the others."""

import json

import pytest
from plumbline.operators import shred


def deep(levels):
    text = []  # json.dumps would recurse
    for i in range(levels):
        text.append(f'{{"type":"library","name":"n{i}","components":[')
    return '{"components":[' + "".join(text) + '{"type":"library","name":"leaf"}' + "]}" * levels + "]}"


def rows(df):
    return sorted((r["source"], r["index"], json.loads(r["node"])["name"]) for r in df.selectExpr("source", "index", "to_json(node) AS node").collect())


def walk(doc):
    """The walk, by hand."""
    stack, out = list(doc["components"]) if isinstance(doc.get("components"), list) else [], []
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            out.append(node.get("name"))
            if isinstance(node.get("components"), list):
                stack += node["components"]
    return out


def test_nested_and_hostile_documents(spark):
    docs = {
        "flat": {"components": [{"name": "a"}, 1, None, {"name": "b"}, "x", {"name": "c", "components": "no list"}]},
        "nested": {"components": [{"name": "a", "components": [{"name": "b"}, {"name": "c", "components": [{"name": "d"}, 7]}]}, {"name": "e"}, {"name": "f", "components": []}]},
        "none": {"components": []}, "absent": {"x": 1}, "null": {"components": None}, "text": {"components": "a"}, "object": {"components": {"name": "a"}},
    }
    raw = [(k, json.dumps(v)) for k, v in docs.items()] + [("cut", json.dumps(docs["nested"])[:-2]), ("huge", '{"components":[{"name":"a","evidence":{"occurrences":[{"line":1e999}]},"components":[{"name":"b"}]}]}')]
    got = rows(shred.components(shred.parse(spark.createDataFrame(raw, "source string, raw string"))))
    assert got == sorted((k, i, n) for k, v in [*docs.items(), ("huge", {"components": [{"name": "a", "components": [{"name": "b"}]}]})] for i, n in enumerate(walk(v)) if n)


def test_more_than_a_million_components(spark):
    flat = spark.range(0, 700, 1, 4).selectExpr("concat('d', id) AS source", """concat('{"components":[', array_join(transform(sequence(1, 1500), i -> concat('{"type":"library","name":"n', i, '"}')), ','), ']}') AS raw""")
    one = spark.createDataFrame([("tree", '{"components":[' + ",".join('{"name":"p","components":[{"name":"k"},{"name":"l"}]}' for _ in range(20_000)) + "]}")], "source string, raw string")
    found = shred.components(shred.parse(flat.unionByName(one)))
    n, last, distinct = found.selectExpr("count(*)", "max(index)", "count(DISTINCT source, index)").first()
    assert n == distinct == 700 * 1500 + 60_000 and last == 59_999


def test_deep_documents_stop_no_other(spark):
    """Spark's parser takes 1,000 levels of JSON, two a component; what is deeper is no valid document, and the others go on."""
    raw = [("good", '{"components":[{"name":"a"}]}'), ("d210", deep(210)), ("d490", deep(490)), ("d1000", deep(1000)), ("d100000", deep(100_000))]
    parsed = shred.parse(spark.createDataFrame(raw, "source string, raw string"))
    counts = {r["source"]: r["count"] for r in shred.components(parsed).groupBy("source").count().collect()}
    assert counts == {"good": 1, "d210": 211, "d490": 491}
    assert {r.source: r.parse_error for r in parsed.collect() if r.parse_error} == {"d1000": "invalid JSON", "d100000": "invalid JSON"}


WHOLE = {
    "flat": '{"components":[{"name":"a"}, 1, null, {"name":"b","version":"x,]}"},"x",{"name":"c","components":"no list"}] , "specVersion":"1.6"}',
    "nested": '{"components":[{"name":"a","components":[{"name":"b"},{"name":"c","components":[{"name":"d"},7]}]},{"name":"e"},{"name":"f","components":[]}]}',
    "wrapped": ' [ {"components":[{"name":"no"}],"bom":{"components":[{"name":"y"},{"name":"z"}]}} , {"components":[{"name":"w"}]}]\n',
    "bom no object": '{"bom":[{"components":[{"name":"no"}]}],"components":[{"name":"yes"}]}',
    "deep bom": '{"bom":' * 9 + '{"components":[{"name":"no"}]}' + "}" * 9, "eight": '{"bom":' * 8 + '{"components":[{"name":"yes"}]}' + "}" * 8,
    "none": '{"components":[]}', "absent": '{"x":1}', "null": '{"components":null}', "object": '{"components":{"name":"a"}}', "number": "12", "empty list": "[]", "empty": "{}", "nothing": "", "long": '{"components":[' + ",".join(f'{{"name":"n{i}"}}' for i in range(5000)) + "]}",
    "cut": '{"components":[{"name":"a"},{"name":"b"}', "after": '{"components":[{"name":"a"}]} x', "comma": '{"components":[{"name":"a"},]}', "nan": '{"components":[{"name":"a"},{"line":NaN}]}', "bare nan": '{"components":[{"name":"a"},NaN]}',
    "twice": '{"components":[{"name":"a","name":"b"}]}', "twice below": '{"components":[{"name":"a","components":[{"name":"b","x":1,"x":2}]}]}', "two lists": '{"components":[{"name":"a"}],"components":[{"name":"b"}]}', "huge": '{"components":[{"name":"a","line":1e999,"components":[{"name":"b"}]}]}',
}


def test_documents_in_pieces_are_as_whole_ones(spark):
    whole = spark.createDataFrame(list(WHOLE.items()), "source string, raw string")
    parsed = shred.parse(whole)
    for size in (1, 7, 100_000):
        pieces = [(k, i, v[i : i + size]) for k, v in WHOLE.items() if k != "long" or size > 1 for i in range(0, max(1, len(v)), size)]
        heads, nodes = shred.shred_pieces(spark.createDataFrame(pieces[::-1], "source string, piece long, raw string"))
        some = {p[0] for p in pieces}
        assert {r.source: r.parse_error for r in heads.collect()} == {r.source: r.parse_error for r in parsed.collect() if r.source in some}
        both = [sorted((r["source"], r["index"], r["name"]) for r in df.selectExpr("source", "index", "try_variant_get(node, '$.name', 'string') AS name").collect()) for df in (nodes, shred.components(parsed))]
        assert both[0] == [x for x in both[1] if x[0] in some] and len(both[0]) > 10


def test_a_document_is_never_held():
    """A document of 60 MB in pieces: what is held at a time is two reads at most."""
    from plumbline.operators.split import AHEAD, Split

    part = json.dumps({"type": "library", "name": "n" * 200})
    doc = Split(['{"components":[', *[part + ","] * 250_000, part, "]}"])
    most = n = 0
    for _ in doc.elements():
        n, most = n + 1, max(most, len(doc.text))
    assert n == 250_001 and most < 3 * AHEAD and json.loads(doc.shell) == {"components": [0]}


def test_broken_text_is_not_read_to_its_end():
    from plumbline.operators.split import Split

    read = []
    doc = Split(read.append(i) or x for i, x in enumerate(['{"components":[{"name":tru}', *['{"name":"a"},'] * 100_000]))
    with pytest.raises(ValueError):
        list(doc.elements())
    assert len(read) < 20_000
