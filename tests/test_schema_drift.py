import json
import random

from lodeworks.operators import schema_drift as S

SCHEMA = "pack_row bigint, feed string, file_no int, section string, canonical_id string, properties string, field string"


def kind(v):
    return "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def brute(rows):
    files = {}
    for _, feed, no, section, cid, bag, _ in rows:
        kinds, values = files.setdefault((feed, section, no), ({}, {}))
        try:
            top = json.loads(bag) if bag else None
        except ValueError:
            top = None
        for k, v in (top if isinstance(top, dict) else {}).items():
            if v is not None:
                kinds.setdefault(k, set()).add(kind(v))
                if cid is not None:
                    values.setdefault(k, {}).setdefault(cid, set()).add(json.dumps(v, sort_keys=True))
    out = set()
    for (feed, section, no), (k1, v1) in files.items():
        if (feed, section, no - 1) not in files:
            continue
        k0, v0 = files[(feed, section, no - 1)]
        gone, come = set(), set()
        for a in sorted(set(k0) - set(k1)):
            for b in sorted(set(k1) - set(k0)):
                both = set(v0.get(a, ())) & set(v1.get(b, ()))
                if both and all(v0[a][c] == v1[b][c] for c in both):
                    out.add((feed, no, section, b, "renamed", a))
                    gone.add(a)
                    come.add(b)
        out |= {(feed, no, section, f, "added", "") for f in set(k1) - set(k0) - come}
        out |= {(feed, no, section, f, "removed", "") for f in set(k0) - set(k1) - gone}
        out |= {(feed, no, section, f, "retyped", "") for f in set(k0) & set(k1) if k0[f] != k1[f]}
    return out


def drifting(seed):
    rnd = random.Random(seed)
    rows, key = [], 0
    for feed in ("a", "b", "c"):
        names = {f: f for f in ("density", "family", "use", "forms", "grade")}
        text = False
        for no in range(1, 7):
            if no > 1:
                f = rnd.choice(list(names))
                names[f] = names[f] + "_x"
                names.pop(rnd.choice([n for n in names if n != f]), None) if len(names) > 2 and rnd.random() < 0.5 else names.setdefault(f"new{no}", f"new{no}")
                text = text or rnd.random() < 0.3
            for e in range(12):
                bag = {n: (f"{f}-{e}" if f != "density" else str(1000 + e) if text else 1000 + e) for f, n in names.items() if rnd.random() < 0.8}
                if "forms" in names:
                    bag[names["forms"]] = [f"f{e}", {"z": 1, "a": e}] if rnd.random() < 0.9 else None
                rows.append((key, feed, no, "materials", None if e == 11 else f"id{e}", json.dumps(bag) if e != 10 else rnd.choice([None, "", "[1]", "{bad"]), "clash"))
                key += 1
                if e == 3:
                    rows.append((key, *rows[-1][1:]))
                    key += 1
    return rows


def test_changes_against_brute_force(spark):
    for seed in (1, 2):
        rows = drifting(seed)
        df = spark.createDataFrame(rows, SCHEMA)
        got = [(r.feed, r.file_no, r.section, r.field, r.change, r.old_field) for r in S.changes(S.pack_bags(df)).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_unified_names_follow_renames(spark):
    rows = [(1, "f", 1, "m", "i", '{"a": 1, "old": "v"}', ""), (2, "f", 2, "m", "i", '{"a": 1, "mid": "v"}', ""), (3, "f", 3, "m", "i", '{"a": "1", "new": "v"}', ""), (4, "f", 3, "m", None, None, "")]
    got = {r.entry: r.properties for r in S.unified_rows(S.pack_bags(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert [set(got[k]) for k in (1, 2, 3, 4)] == [{"a", "new"}] * 3 + [set()]
    assert all(got[k]["new"] == "v" for k in (1, 2, 3))


def test_empty_and_single_files(spark):
    df = spark.createDataFrame([(1, "f", 1, "m", "i", '{"a": 1}', "")], SCHEMA)
    assert S.changes(S.pack_bags(df)).count() == 0 and S.changes(S.pack_bags(df.limit(0))).count() == 0
    lost = spark.createDataFrame([(1, "f", 1, "m", "i", '{"a": 1}', ""), (2, "f", 2, "m", "i", "{}", "")], SCHEMA)
    assert [(r.field, r.change) for r in S.changes(S.pack_bags(lost)).collect()] == [("a", "removed")]


def test_flooding_prefers_the_better_neighbourhood():
    f = frozenset
    old = {"density_kg": (f({"number"}), f()), "process_family": (f({"string"}), f()), "kept": (f({"string"}), f())}
    new = {"rho_kg": (f({"number"}), f()), "process_group": (f({"string"}), f()), "kept": (f({"string"}), f())}
    assert {(o, n) for o, n, _ in S.correspondences(old, new, {})} == {("density_kg", "rho_kg"), ("process_family", "process_group")}
    # values that contradict rule a pair out, agreeing ones decide
    assert [(o, n) for o, n, _ in S.correspondences(old, new, {("density_kg", "rho_kg"): (5, 4), ("process_family", "process_group"): (3, 3), ("density_kg", "process_group"): (2, 0), ("process_family", "rho_kg"): (2, 0)})] == [("process_family", "process_group")]


def test_feeds_share_one_name_and_type(spark):
    rows = []
    for e in range(30):
        rho, flag, soft = 1000 + 7 * e, e % 2 == 0, f"v{e}"
        bags = {
            ("f", 1): {"density": rho, "ok": flag, "sw": soft}, ("f", 2): {"dens": rho, "ok": flag, "sw": soft},
            ("g", 1): {"rho": f"{rho} kg/m3" if e % 3 else str(rho), "okay": int(flag), "software": {"value": soft}},
            ("h", 1): {"dens": {"value": rho}, "software": [soft], "forms": "bar, tube" if e else ["bar", "tube"], "share": 1 + e % 2},
        }
        rows += [(len(rows) + k, feed, no, "m", f"id{e}", json.dumps(bag), "") for k, ((feed, no), bag) in enumerate(bags.items())]
    got = S.unified_rows(S.pack_bags(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == len(rows)
    for r in got:
        e = int(r.canonical_id[2:])
        assert r.properties["dens"] == str(1000 + 7 * e) and r.properties["software"] == f"v{e}"
        assert r.remarks == ({"dens": "kg/m3"} if r.feed == "g" and e % 3 else {})
        assert r.feed != "h" or r.properties["forms"] == '["bar","tube"]'


def test_names_side_by_side_stay_apart():
    names = {"a": (False, 3), "b": (False, 2), "c": (True, 1)}
    agree = {("a", "b"): (50, 50, 0.1), ("b", "c"): (50, 40, 0.1), ("a", "c"): (50, 6, 0.1)}
    assert S.one_name(names, agree, set(), {("a", "b")}) == {"a": "a", "b": "c", "c": "c"}
    assert S.one_name(names, {}, {("a", "b"), ("b", "c")}, set()) == {"a": "c", "b": "c", "c": "c"}


def test_flooding_decides_between_fields_that_agree_equally(monkeypatch):
    f = frozenset
    text, number, bag = (f({"string"}), f()), (f({"number"}), f()), (f({"object"}), f({"low", "high"}))
    old = {"density_kg": number, "limits": bag, "kept": text}
    new = {"density_kg_m3": number, "a_copy": number, "span": bag, "b_copy": (f({"object"}), f({"zz", "y"})), "kept": text}
    both = {("density_kg", "density_kg_m3"): (4, 4), ("density_kg", "a_copy"): (4, 4), ("limits", "span"): (3, 3), ("limits", "b_copy"): (3, 3)}
    got = S.pair_changes(old, new, both)
    assert [(n, c, o) for n, c, o, _ in got] == [("a_copy", "added", ""), ("b_copy", "added", ""), ("density_kg_m3", "renamed", "density_kg"), ("span", "renamed", "limits")]
    # a name alike without shared values never outdoes agreeing values
    decoy = {"density_kg_": number, "rho": number, "kept": text}
    assert ("rho", "renamed", "density_kg") in [c[:3] for c in S.pair_changes({"density_kg": number, "kept": text}, decoy, {("density_kg", "rho"): (1, 1)})]
    monkeypatch.setattr(S, "flood", lambda o, n, e: {(a, b): 0.0 for a in o for b in n})
    assert not [c for c in S.pair_changes(old, new, both) if c[1] == "renamed"]


def test_flooding_settles_on_large_schemas():
    f = frozenset
    wide = lambda tag: {f"{tag}_part_{i}": (f({"object"} if i % 3 else {"number", "string"}), f({f"k{j}" for j in range(i % 5)})) for i in range(60)}
    got = S.flood(wide("old"), wide("new"), {("old_part_7", "new_part_9"): 1.0})
    assert max(got, key=got.get) == ("old_part_7", "new_part_9") and 0 < min(got.values()) and max(got.values()) < 2
    assert S.flood({}, wide("x"), {}) == {}
