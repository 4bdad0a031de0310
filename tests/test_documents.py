"""XML nodes and JSON leaves at any depth."""

import json
import random

from plumbline.operators import documents
from plumbline.plans import history


def test_nodes_of_any_depth(spark):
    rows = [(1, "<a>" * 60 + "x" + "</a>" * 60), (2, None), (3, "<a>"), (4, ""), (5, '<!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>'), (6, '<p:a xmlns:p="u" k="&lt;1">  <![CDATA[<b>]]> t<!-- no --><b/>\n<b> y </b></p:a>')]
    df = spark.createDataFrame([(i, d, "z") for i, d in rows], "id int, doc string, node string")
    got = {}
    for r in documents.xml_shred(df, "id", "doc").collect():
        got.setdefault(r["id"], []).append(tuple(r)[1:])
    assert sorted(got) == [1, 3, 4, 5, 6]
    assert len(got[1]) == 61 and got[1][-1][4] == "/a" * 60 and got[1][-1][6] == "x"
    assert all([n[2] for n in got[i]] == ["fault"] for i in (3, 4, 5))
    assert got[6] == [(0, None, "element", "p:a", "/p:a", 1, "<b> t"), (1, 0, "attribute", "xmlns:p", "/p:a/@xmlns:p", 1, "u"), (2, 0, "attribute", "k", "/p:a/@k", 1, "<1"), (3, 0, "text", None, "/p:a", 1, "<b> t"),
                      (4, 0, "element", "b", "/p:a/b", 1, None), (5, 0, "element", "b", "/p:a/b", 2, "y"), (6, 5, "text", None, "/p:a/b", 1, "y")]


def test_parents_and_ordinals_by_another_parser(spark):
    """Random trees against a tree parser's own walk."""
    from xml.etree import ElementTree

    rng = random.Random(3)

    def tree(depth):
        inside = "".join(rng.choice(["t%d " % rng.randrange(9), tree(depth - 1)]) for _ in range(rng.randrange(4))) if depth else ""
        name = rng.choice("abc")
        return f'<{name} k="{rng.randrange(5)}">{inside}</{name}>'

    docs = [(i, tree(6)) for i in range(40)]
    got = {}
    for r in documents.xml_shred(spark.createDataFrame(docs, "id int, doc string"), "id", "doc").where("kind = 'element'").collect():
        got.setdefault(r["id"], []).append((r["path"], r["ordinal"]))

    def walk(e, path, ordinal):
        yield path, ordinal
        seen = {}
        for c in e:
            seen[c.tag] = seen.get(c.tag, 0) + 1
            yield from walk(c, f"{path}/{c.tag}", seen[c.tag])

    assert got == {i: list(walk(e, f"/{e.tag}", 1)) for i, d in docs for e in [ElementTree.fromstring(d)]}


def test_leaves_of_any_depth(spark, tmp_path):
    rng = random.Random(5)

    def value(depth):
        kind = rng.randrange(6) if depth else rng.randrange(3)
        if kind > 3:
            return [value(depth - 1) for _ in range(rng.randrange(3))]
        return {rng.choice("abc") + str(i): value(depth - 1) for i in range(rng.randrange(1, 4))} if kind == 3 else [rng.randrange(9), "s", None][kind]

    def leaves(v, path=""):
        for k, x in v.items() if isinstance(v, dict) else enumerate(v):
            at = f"{path}.{k}" if path else str(k)
            if isinstance(x, (dict, list)):
                yield from leaves(x, at)
            elif x is not None:
                yield at, str(x)

    docs = [(i, {"r": value(12)}) for i in range(60)]
    rows = [(i, json.dumps(d)) for i, d in docs] + [(100, None), (101, "no json"), (102, "{}"), (103, "5")]
    out = documents.json_flatten(spark.createDataFrame(rows, "id int, doc string"), "id", "doc", str(tmp_path))
    assert sorted((r["id"], r["path"], r["value"]) for r in out.collect()) == sorted((i, p, v) for i, d in docs for p, v in leaves(d))
    assert max(r["path"].count(".") for r in out.collect()) > 5


def test_many_documents_share_batches(spark):
    """Faults and nulls between documents, equal keys, more nodes than a batch holds."""
    rows = [(i // 2, None if i % 7 == 0 else f"<a><b>{i}</b><b/><c" if i % 5 == 0 else f'<a k="{i}"><b>{i}</b><b/>' + "<c/>" * 20 + "</a>") for i in range(3000)]
    want = []
    for k, doc in rows:
        if doc and not doc.endswith("<c"):
            i = doc.split('"')[1]
            want += [(k, 0, None, "element", "/a", 1, None), (k, 1, 0, "attribute", "/a/@k", 1, i), (k, 2, 0, "element", "/a/b", 1, i), (k, 3, 2, "text", "/a/b", 1, i), (k, 4, 0, "element", "/a/b", 2, None)]
            want += [(k, 5 + n, 0, "element", "/a/c", 1 + n, None) for n in range(20)]
        elif doc:
            want.append((k, 0, None, "fault", None, None, None))
    assert len(want) > 2 * documents.BATCH_NODES
    out = documents.xml_shred(spark.createDataFrame(rows, "id int, doc string").coalesce(1), "id", "doc")
    got = [(*r[:4], *r[5:7], None if r["kind"] == "fault" else r["value"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_lookup_parses_documents_once(spark, sf, monkeypatch):
    """A layout reads its rows twice, so they are written before."""
    plans, store = [], history.layouts.store
    monkeypatch.setattr(history.layouts, "store", lambda df, *a, **k: (plans.append(df._jdf.queryExecution().executedPlan().toString()), store(df, *a, **k)))
    assert history.xml_lookup(spark, sf).count()
    assert len(plans) == 2 and not any("MapInArrow" in p for p in plans)
