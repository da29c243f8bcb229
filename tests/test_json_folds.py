"""JSON and Microdata of any depth against plain recursion."""

import json
import random

import pytest
from pyspark.sql import functions as F

from crawlsift.extract.json_folds import entities_of, leaves_of, parsed
from crawlsift.extract.markup import parse_pages
from crawlsift.extract.structured import extract_jsonld, extract_microdata, flatten_jsonld, microdata_entities
from crawlsift.operators.events import annotate_entries, filter_entries, flatten_json
from crawlsift.operators.schema import audit_schema, flatten_entities, structured_pages, summarize_pages, validate_entities
from crawlsift.sinks import schema_documents, schema_json

VALUES = ["x", "", " ", 'q"\\/\n', "é😀", 0, -1, 2.5, 1e3, True, False, None, [], {}, "@type"]


def value(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice(VALUES)
    if rng.random() < 0.5:
        return [value(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice(["a", "b.c", "@type", "@graph", "", "@id", "é"]): value(rng, depth - 1) for _ in range(rng.randint(0, 4))}


def brute_leaves(node, path=""):
    if isinstance(node, (list, dict)) and node:
        for k, v in enumerate(node) if isinstance(node, list) else node.items():
            step = (f"{path}[{k}]" if path else str(k)) if isinstance(node, list) else (f"{path}.{k}" if path else k)
            yield from brute_leaves(v, step)
    else:
        yield path, node


def brute_entities(node, path="", level=0):
    if isinstance(node, list):
        for i, v in enumerate(node):
            yield from brute_entities(v, f"{path}[{i}]", level + 1)
    elif isinstance(node, dict) and isinstance(node.get("@graph"), list):
        for i, v in enumerate(node["@graph"]):
            yield from brute_entities(v, f"{path}@graph[{i}]", level + 1)
    elif isinstance(node, dict):
        kind = node.get("@type")
        types = [t for t in (kind if isinstance(kind, list) else [kind]) if t is not None and not isinstance(t, (list, dict))]
        if types:
            yield level, path, len(types), [k for k, v in node.items() if not (v is None or v in ([], {}) and v is not False and v != 0 or isinstance(v, str) and not v.strip())]
        for k, v in node.items():
            if not k.startswith("@"):
                yield from brute_entities(v, f"{path}.{k}", level + 1)


def test_random_values_are_walked_like_recursion():
    rng = random.Random(8)
    for _ in range(600):
        node = value(rng, 6)
        text = json.dumps(node, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        leaves = list(leaves_of(text))
        want = list(brute_leaves(node))
        assert [p for _, p, _ in leaves] == [p for p, _ in want]
        assert [o for o, _, _ in sorted(leaves)] == [o for o, _, _ in leaves]  # order keys sort as the text runs
        for (_, _, got), (_, v) in zip(leaves, want):
            assert got == (v if isinstance(v, str) else json.dumps(v).removesuffix(".0"))
        found = list(entities_of(text))
        assert [(level, path, len(types), filled) for level, path, _, types, filled, _ in found] == list(brute_entities(node))
        for _, path, _, _, _, raw in found:
            assert isinstance(json.loads(raw), dict)


def test_repeated_keys_and_broken_texts():
    assert [x[1:] for x in leaves_of('{"a":1,"b":2,"a":{"c":3}}')] == [("a.c", "3"), ("b", "2")]
    assert [x[1:] for x in leaves_of(' "t" ')] == [("", "t")] and [x[1:] for x in leaves_of("[]")] == [("", "[]")]
    for broken in ("", "{", "]", "[1]]", "{}{}", "[1}", '{"a"', "{1:2}", "1 2", "[,]"):
        assert parsed(broken) is None and not list(leaves_of(broken)) and not list(entities_of(broken)), broken


def test_depth_limits_are_opt_in(spark):
    deep = json.dumps({"event": "e"} | {"n": eval("[" * 60 + "'needle'" + "]" * 60)})
    df = spark.createDataFrame([(1, deep)], "id long, raw string")
    assert [r.value for r in flatten_json(df, "raw", ["id"]).collect()] == ["e", "needle"]
    cut = flatten_json(df, "raw", ["id"], max_depth=12).where("path <> 'event'").first()
    assert (cut.value, cut.path) == ("[Depth limit]", "n" + "[0]" * 12)


def test_order_keys_hold_beyond_seven_digits():
    from crawlsift.extract.json_folds import below

    keys = [below("", i) for i in (0, 9, 10, 99, 100, 9_999_999, 10_000_000, 123_456_789)]
    assert keys == sorted(keys)


def test_forty_levels_of_everything(spark, page):
    deep = '{"@type":"T","x":[' * 40 + '{"@type":"Person"}' + "]}" * 40
    p = parse_pages(page(f'<script type="application/ld+json">{deep}</script>'))
    found = flatten_jsonld(extract_jsonld(p), raw=False).orderBy("ord").collect()
    assert len(found) == 41 and (found[-1].type, found[-1].path) == ("Person", "block0" + ".x[0]" * 40)
    entries = spark.createDataFrame([(1, "l", 0, deep), (1, "l", 1, '{"event":"T2"}')], "page_id long, layer string, index int, raw string").selectExpr("*", "try_parse_json(raw) AS value")
    hits = filter_entries(annotate_entries(entries), "person")
    assert [r["index"] for r in hits.collect()] == [0] and hits.columns == annotate_entries(entries).columns
    text = hits._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Join" not in text and text.count("Scan") == 1


def nested(depth):
    return "".join(f"<div itemprop=in itemscope itemtype=L{i}><b itemprop=n>{i}</b>" for i in range(depth)) + "</div>" * depth


def test_microdata_scopes_of_any_depth(page):
    p = parse_pages(page(f"<div itemscope itemtype=Top>{nested(40)}<i itemprop=n>a</i><i itemprop=n>b</i></div>"))
    rows = extract_microdata(p).orderBy("scope", "pos").collect()
    assert {(r.type, r.prop, r.value) for r in rows if r.type == "L39"} == {("L39", "n", "39")}
    assert [r.value for r in rows if r.type == "Top" and r.prop == "n"] == ["a", "b"] and all(r.item == 0 for r in rows)
    by_scope = {r.scope: r.parent_scope for r in rows}
    deepest, steps = max(by_scope), 0
    while by_scope[deepest] is not None:
        deepest, steps = by_scope[deepest], steps + 1
    assert steps == 40
    item = microdata_entities(extract_microdata(p)).first()
    assert item.filled == ["in", "n"]
    inner = json.loads(item.raw)
    assert inner["n"] == ["a", "b"]
    for i in range(40):
        inner = inner["in"]
        assert inner["type"] == f"L{i}" and inner["id"] is None and inner["properties"]["n"] == str(i)
        inner = inner["properties"]


def test_microdata_values_and_items(page):
    p = parse_pages(page(
        '<div itemscope itemtype="http://s/Product" itemid=" urn:1 "><meta itemprop=sku content=" 7 "><a itemprop="url same" href=/u>x</a><img itemprop=image src=i.png>'
        '<time itemprop=d datetime=2020>then</time><time itemprop=e>now</time><data itemprop=v value=3>three</data><object itemprop=o data=/o></object><p itemprop=p>a <b>&amp;</b>'
        '<p itemprop=blank> </div><span itemscope><i itemprop=gone>1</i></span><div itemscope itemtype=Empty></div><i itemprop=stray>no</i>'))
    got = {(r.item, r.prop): r.value for r in extract_microdata(p).collect()}
    assert got == {(0, "sku"): "7", (0, "url"): "https://example.com/u", (0, "same"): "https://example.com/u", (0, "image"): "https://example.com/a/i.png", (0, "d"): "2020",
                   (0, "e"): "now", (0, "v"): "3", (0, "o"): "https://example.com/o", (0, "p"): "a &", (0, "blank"): "", (1, None): None}
    assert extract_microdata(p, cap=1).where("item > 0").count() == 0
    entities = {r.type: r for r in microdata_entities(extract_microdata(p)).collect()}
    assert "blank" not in entities["Product"].filled and json.loads(entities["Product"].raw)["blank"] == "" and entities["Empty"].raw == "{}"


@pytest.fixture(scope="module")
def mixed(spark):
    html = ['<script type="application/ld+json">[{"@type":"Person","name":"n"},{"@type":["X","Offer"],"price":0}]</script><script type="application/ld+json">{</script>',
            f"<div itemscope itemtype=Product>{nested(3)}</div>", "<p>nothing</p>", '<script type="application/ld+json">{"@type":"Person"}</script><div itemscope itemtype="//s/Person"><b itemprop=name>m</b></div>']
    return spark.createDataFrame([(i + 1, f"https://e.com/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")


def test_pages_in_one_row_give_what_rows_of_entities_give(mixed):
    p = parse_pages(mixed)
    blocks = extract_jsonld(p)
    entities, findings, summary = audit_schema(blocks, extract_microdata(p), mixed)
    one = summarize_pages(p)
    text = one._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and text.count("Scan") == 1
    show = lambda df: sorted(json.dumps(r.asDict(recursive=True), sort_keys=True) for r in df.collect())
    assert show(one) == show(summary.select(*one.columns))
    docs = {r.page_id: json.loads(r.json) for r in schema_documents(structured_pages(p, raw=True)).collect()}
    rows = {r.page_id: json.loads(r.json) for r in schema_json(entities, findings, blocks, summary, mixed).collect()}
    for page_id, doc in docs.items():
        doc.pop("inspectedAt"), rows[page_id].pop("inspectedAt")
        assert doc == rows[page_id], page_id
    assert docs[2]["entities"][0]["properties"]["in"]["properties"]["in"]["properties"]["n"] == "1"
    assert [e["source"] for e in docs[4]["entities"]] == ["json-ld", "microdata"]


def test_findings_of_both_sources(mixed):
    p = parse_pages(mixed)
    found = validate_entities(flatten_entities(extract_jsonld(p), extract_microdata(p))).where("page_id = 4").groupBy("source", "status").agg(F.sort_array(F.collect_list("label")).alias("l"))
    assert {(r.source, r.status): r.l for r in found.collect()} == {
        ("json-ld", "error"): ["name"], ("json-ld", "warning"): ["jobTitle", "url"], ("microdata", "ok"): ["name"], ("microdata", "warning"): ["jobTitle", "url"]}
