import json

from vantage.functions.json_paths import json_keypaths

DOCS = [
    {"a": {"b": 1, "c": {"b": "x"}}, "l": [{"b": 2}, {"b": [3, 4]}, 5]},
    {"b": None, "xab": 7, "ab": {"q": True}},
    {"newline": {"b": 8}, "k": "v"},
    [{"b": 9}],
]


def brute(doc, target, match, ignore=()):
    """Plain Python walk: object entries by dotted path, arrays add no part."""
    out = []

    def ok(p):
        if match == "exact":
            return p == target
        if match == "suffix":
            return p == target or p.endswith("." + target)
        return p.endswith(target)

    def walk(v, p):
        if isinstance(v, dict):
            for k, x in v.items():
                q = p if k in ignore else (k if p is None else f"{p}.{k}")
                if q is not None and ok(q):
                    out.append((q, x))
                walk(x, q)
        elif isinstance(v, list):
            for x in v:
                walk(x, p)
    walk(doc, None)
    return out


def text(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (dict, list)):
        return json.dumps(v, separators=(",", ":"), sort_keys=True)
    return str(v)


def test_matches_brute_force(spark):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DOCS)], "id long, j string")
    for target, match, ignore in [("b", "suffix", ()), ("a.b", "exact", ()),
                                  ("ab", "string_suffix", ()), ("ab", "suffix", ()),
                                  ("b", "exact", ("newline",)), ("l.b", "exact", ())]:
        got = sorted((r.id, r.path, r.value) for r in
                     json_keypaths(df, "j", target, match=match, ignore_keys=ignore).collect())
        want = sorted((i, p, text(v)) for i, d in enumerate(DOCS)
                      for p, v in brute(d, target, match, ignore))
        assert got == want, (target, match)


def test_every_depth_is_walked(spark):
    docs = []
    for n in (7, 8, 9, 12, 40):
        d = {"k": 1}
        for i in range(n - 1):
            d = {"k": d} if i % 3 else {"k": [d, "[{\\"]}
        docs.append((n, json.dumps(d)))
    df = spark.createDataFrame(docs, "id long, j string")
    got = json_keypaths(df, "j", "k", match="suffix").groupBy("id").count().collect()
    assert {r.id: r["count"] for r in got} == {n: n for n, _ in docs}


def test_long_strings_do_not_exhaust_the_matcher(spark):
    df = spark.createDataFrame([(1, json.dumps({"s": {"t": "x\\\"" * 50_000}}))], "id long, j string")
    assert json_keypaths(df, "j", "s", combine=True).first().combined == "x\\\"" * 50_000


def test_bad_json_and_a_stated_depth(spark):
    df = spark.createDataFrame([(1, "not json"), (2, '{"a":{"b":{"c":1}}}')], "id long, j string")
    assert json_keypaths(df, "j", "a.b.c").count() == 1
    assert json_keypaths(df, "j", "a.b.c", depth=2).count() == 0


def leaves(v):
    if isinstance(v, dict):
        for k in sorted(v):
            yield from leaves(v[k])
    elif isinstance(v, list):
        for x in v:
            yield from leaves(x)
    elif v is None:
        return
    elif isinstance(v, bool):
        yield "true" if v else "false"
    else:
        yield str(v)


def test_combined_leaf_text(spark):
    docs = [{"s": {"b": "x:y", "a": ["p", {"q": "\"r\""}], "n": 12, "t": True, "z": None}},
            {"s": "plain"}, {"s": {"k1": "é\n", "k2": [1.5, "2"]}}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id long, j string")
    got = {r.id: r.combined for r in json_keypaths(df, "j", "s", combine=True).collect()}
    assert got == {i: "".join(leaves(d["s"])) for i, d in enumerate(docs)}


def test_value_kinds(spark):
    doc = {"o": {"x": 1}, "a": [1], "s": "t", "n": 2.5, "b": False, "z": None}
    df = spark.createDataFrame([(1, json.dumps({"w": doc}))], "id long, j string")
    got = {r.path: (r.value_type, r.value) for r in
           json_keypaths(df, "j", "w", match="suffix").collect()}
    assert got == {"w": ("object", json.dumps(doc, separators=(",", ":"), sort_keys=True))}
    got = {r.path: (r.value_type, r.value) for r in
           json_keypaths(df, "j", ["w", "o"], match="exact").collect()}
    assert got == {"w.o": ("object", '{"x":1}')}
    kinds = {r.path: (r.value_type, r.value) for r in json_keypaths(
        spark.createDataFrame([(1, json.dumps(doc))], "id long, j string"), "j", "o.x").collect()}
    assert kinds == {"o.x": ("number", "1")}
    for key, want in {"a": ("array", "[1]"), "s": ("string", "t"), "n": ("number", "2.5"),
                      "b": ("boolean", "false"), "z": ("null", None)}.items():
        df1 = spark.createDataFrame([(1, json.dumps(doc))], "id long, j string")
        rows = json_keypaths(df1, "j", key).collect()
        assert [(r.value_type, r.value) for r in rows] == [want], key


def test_repeated_keys_keep_last(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "a": 2, "b": {"c": 3, "c": 4}}')],
                               "id long, j string")
    got = sorted((r.path, r.value) for r in json_keypaths(df, "j", "c", match="suffix").collect())
    assert got == [("b.c", "4")]
    assert [r.value for r in json_keypaths(df, "j", "a").collect()] == ["2"]
    assert json_keypaths(df, "j", "a", duplicate_keys="reject").count() == 0
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys", "false") == "false"
