"""Deletes over graphs of references, against a walk row by row."""

import random

import pytest

from plumbline.operators import actions
from plumbline.operators.actions import Reference as R
from plumbline.operators.checks import GateClosed


def ids_of(df):
    return {r["id"] for r in df.collect()}


def test_a_thousand_levels_take_ten_doublings(spark, tmp_path):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(1000)] + [(2000, 2001), (2001, 2002), (2002, 2000), (3000, 777), (4000, 9999)], "id int, boss int")
    out = actions.delete({"t": chain}, {"t": "id"}, [R("f", "t", "boss", "t", "id", "CASCADE")], {"t": chain.where("id = 5")}, str(tmp_path))
    assert ids_of(out.deleted["t"]) == {*range(5, 1000), 3000}
    assert out.rounds == 1 and out.doublings <= 11
    ring = actions.delete({"t": chain}, {"t": "id"}, [R("f", "t", "boss", "t", "id", "CASCADE")], {"t": chain.where("id = 2001")}, str(tmp_path / "ring"))
    assert ids_of(ring.deleted["t"]) == {2000, 2001, 2002}


def test_two_tables_in_a_cycle(spark, tmp_path):
    a = spark.createDataFrame([(1, 12), (2, 11), (3, None), (4, 13)], "id int, b int")
    b = spark.createDataFrame([(11, 1), (12, 2), (13, 3)], "id int, a int")
    graph = [R("ab", "a", "b", "b", "id", "CASCADE"), R("ba", "b", "a", "a", "id", "CASCADE")]
    out = actions.delete({"a": a, "b": b}, {"a": "id", "b": "id"}, graph, {"a": a.where("id = 1")}, str(tmp_path))
    assert ids_of(out.deleted["a"]) == {1, 2} and ids_of(out.deleted["b"]) == {11, 12}
    left = actions.apply({"a": a, "b": b}, {"a": "id", "b": "id"}, out)
    assert ids_of(left["a"]) == {3, 4} and ids_of(left["b"]) == {13}


def test_blockers_stop_all(spark, tmp_path):
    """What another path deletes does not block; what stays does; defaults must exist."""
    p = spark.createDataFrame([(1,), (2,), (9,)], "id int")
    c = spark.createDataFrame([(10, 1), (11, 2)], "id int, p int")
    g = spark.createDataFrame([(100, 10, 1), (101, 11, 2), (102, 11, 1)], "id int, c int, p int")
    graph = [R("cp", "c", "p", "p", "id", "CASCADE"), R("gc", "g", "c", "c", "id", "CASCADE"), R("gp", "g", "p", "p", "id")]
    tables, ids = {"p": p, "c": c, "g": g}, {"p": "id", "c": "id", "g": "id"}
    one = actions.delete(tables, ids, graph, {"p": p.where("id = 1")}, str(tmp_path / "1"))
    assert [tuple(r) for r in one.blockers.collect()] == [("gp", "102", "is referred to")]
    with pytest.raises(GateClosed):
        actions.apply(tables, ids, one)
    both = actions.delete(tables, ids, graph, {"p": p.where("id < 3")}, str(tmp_path / "2"))
    assert both.blockers.isEmpty() and actions.apply(tables, ids, both)["g"].isEmpty()
    for default, nullable, want in (("9", True, []), ("7", True, ["default is no parent"]), ("1", True, ["default is no parent"]), ("null", False, ["takes no null"]), ("null", True, [])):
        graph = [R("cp", "c", "p", "p", "id", "SET DEFAULT", default, nullable)]
        out = actions.delete(tables, ids, graph, {"p": p.where("id = 1")}, str(tmp_path / f"d{default}{nullable}"))
        assert [r["reason"] for r in out.blockers.collect()] == want
        if not want:
            got = {r["id"]: r["p"] for r in actions.apply(tables, ids, out)["c"].collect()}
            assert got == {10: None if default == "null" else 9, 11: 2}


def test_random_graphs(spark, tmp_path):
    """Three tables, seven references of all actions, keys that are not ids."""
    rng = random.Random(11)
    for trial in range(3):
        data = {t: [(i, 1000 + i, *(rng.choice([None, *range(14)]) for _ in range(3))) for i in range(14)] for t in "abc"}
        schema = "id int, code int, x int, y int, z int"
        tables = {t: spark.createDataFrame([(i, k, *(None if v is None else v + (1000 if n == 2 else 0) for n, v in enumerate(vs))) for i, k, *vs in rows], schema) for t, rows in data.items()}
        kinds = ["CASCADE", "SET NULL", "SET DEFAULT", "NO ACTION"]
        graph = [R(f"{c}{col}", c, col, rng.choice("abc"), "code" if col == "z" else "id", "CASCADE" if rng.random() < 0.4 else rng.choice(kinds), "1003" if col == "z" else "3") for c in "abc" for col in "xyz"][:7]
        start = {"a": {1}, "b": {2, 5}}
        gone = {t: set(start.get(t, ())) for t in "abc"}
        column = {"x": 2, "y": 3, "z": 4}
        refers = lambda row, r: row[column[r.column]] is not None and row[column[r.column]] in gone[r.parent]
        while True:
            more = {(r.child, row[0]) for r in graph if r.action == "CASCADE" for row in data[r.child] if row[0] not in gone[r.child] and refers(row, r)}
            if not more:
                break
            for t, i in more:
                gone[t].add(i)
        changed, blocked = {}, set()
        for r in graph:
            for row in data[r.child]:
                if r.action != "CASCADE" and row[0] not in gone[r.child] and refers(row, r):
                    if r.action == "NO ACTION" or (r.action == "SET DEFAULT" and 3 in gone[r.parent]):
                        blocked.add((r.name, str(row[0])))
                    if r.action != "NO ACTION":
                        changed[r.name, row[0]] = None if r.action == "SET NULL" else int(r.default)
        out = actions.delete(tables, {t: "id" for t in "abc"}, graph, {t: tables[t].where(f"id in ({', '.join(map(str, i))})") for t, i in start.items()}, str(tmp_path / str(trial)))
        assert {t: ids_of(df) for t, df in out.deleted.items()} == {t: i for t, i in gone.items() if i}
        assert {(r.name, row["id"]): row["value"] for r, df in out.changed.items() for row in df.collect()} == changed
        assert {(r["reference"], r["id"]) for r in out.blockers.collect()} == blocked
