import random

import pytest

from lodeworks.functions.packed import Grammar
from lodeworks.functions.units import UnitList
from lodeworks.operators import nested, packed_values, units

OBS = "array<struct<property_name:string,value:double,unit:string,fragment:string>>"
EXP = f"exp_row bigint, observations {OBS}, findings array<struct<finding_id:bigint,summary:string,observation_indices:array<int>>>, text_units array<struct<content:string>>, record string"


def test_nested_against_a_plain_walk(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(200):
        obs = None if i % 17 == 0 else [None if rnd.random() < 0.1 else (rnd.choice(["p", " ", None, "q"]), 1.0, None, None) for _ in range(rnd.randint(0, 5))]
        found = None if i % 13 == 0 else [None if rnd.random() < 0.1 else (1, "s", None if rnd.random() < 0.2 else [rnd.choice([None, *range(-7, 7)]) for _ in range(4)]) for _ in range(rnd.randint(0, 3))]
        text = [None if rnd.random() < 0.2 else (rnd.choice(["t", "", None]),) for _ in range(rnd.randint(0, 3))]
        rows.append((i, obs, found, text, "clash"))
    want = set()
    for i, obs, found, text, _ in rows:
        o = obs or []
        ok = [x is not None and x[0] is not None and x[0].strip() != "" for x in o]
        want |= {("observation", i, k, -1) for k, good in enumerate(ok) if good}
        want |= {("text_unit", i, k, -1) for k, t in enumerate(text) if t and t[0] and t[0].strip()}
        for k, f in enumerate(found or []):
            for x in (f and f[2]) or []:
                y = None if x is None else x + len(o) if x < 0 else x
                if y is not None and 0 <= y < len(o) and ok[y]:
                    want.add(("finding_observation", i, k, y))
    df = spark.createDataFrame(rows, EXP)
    got = [tuple(r) for r in nested.tagged_children(df).select("record", "exp_row", "child_no", "linked_no").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert nested.tagged_children(df.limit(0)).count() == 0
    assert set(nested.flat_tables(df)) == {"observation", "text_unit", "finding_observation"}


UNITS = [("MPa", "stress", 1, 0), ("N/mm2", "stress", 1, 0), ("GPa", "stress", 1000, 0), ("ksi", "stress", 6.894757, 0), ("kgf/mm2", "stress", 9.80665, 0), ("um", "length", 1, 0), ("mil", "length", 25.4, 0), ("K", "temperature", 1, 0), ("degC", "temperature", 1, 273.15), ("degF", "temperature", 0.555556, 255.372222), ("h", "duration", 1, 0), ("min", "duration", 1 / 60, 0), ("%", "ratio", 1, 0), ("ppm", "ratio", 1e-4, 0), ("kg/m3", "density", 1, 0), ("lb/in3", "density", 27679.905, 0), ("J", "energy", 1, 0), ("ft-lbf", "energy", 1.355818, 0)]


@pytest.mark.parametrize("text,code", [
    ("MPA", "MPa"), ("mpa", "MPa"), ("M Pa", "MPa"), ("[MPa]", "MPa"), ("megapascal", "MPa"), ("10^3 MPa", "GPa"), ("N mm-2", "N/mm2"), ("N/mm²", "N/mm2"), ("newton per square mm", "N/mm2"),
    ("kips/in2", "ksi"), ("10^3 psi", "ksi"), ("kg/mm^2", "kgf/mm2"), ("кгс/мм²", "kgf/mm2"), ("µm", "um"), ("мкм", "um"), ("0.001 in", "mil"), ("°F", "degF"), ("celsius", "degC"), ("deg K", "K"),
    ("hrs", "h"), ("minutes", "min"), ("parts per million", "ppm"), ("per cent", "%"), ("kg m-3", "kg/m3"), ("lb per cubic inch", "lb/in3"), ("ft.lbf", "ft-lbf"), ("foot-pounds", "ft-lbf"), ("furlong", None), ("", None), (None, None),
])
def test_unit_expressions(text, code):
    assert UnitList(UNITS).code_of(text) == code


def test_units_named_in_texts():
    u = UnitList(UNITS)
    assert u.named_in("Proof Stress is listed in ksi, within 3 h", "stress") == "ksi"
    assert u.named_in("At 640 °C the dial gave 369.4 kg/mm^2", "stress") == "kgf/mm2"
    assert u.named_in("369 MPa or 53 ksi", "stress") is None
    assert u.named_in("nothing in here", "length") is None and u.named_in(None, "stress") is None
    assert u.convert(212, "degF", "K") == pytest.approx(373.15, abs=1e-3)


def test_with_units_over_a_table(spark):
    entries = spark.createDataFrame([("properties", "Proof Stress", ["Rp"], '{"unit": "MPa"}'), ("properties", "Odd", None, None), ("materials", "x", None, None)], "section string, name string, aliases array<string>, properties string")
    unit_df = spark.createDataFrame([(a, b, float(c), float(d)) for a, b, c, d in UNITS], "unit_code string, quantity string, factor double, shift double")
    rows = [("t", 1, -1, "rp", 10.0, "ksi", None), ("t", 2, -1, "Proof Stress", 5.0, "MPa", None), ("t", 3, -1, "RP", 5.0, "", "read as 5 GPa"), ("t", 4, -1, "Rp", None, "ksi", None), ("t", 5, -1, "other", 1.0, "ksi", None), ("t", 6, -1, None, 1.0, "ksi", None), ("t", 7, -1, "Rp", 1.0, None, None), ("t", 8, -1, "Rp", float("nan"), "ksi", None), ("t", 9, -1, "Rp", 2.0, "um", None)]
    values = spark.createDataFrame(rows, "origin string, row_id bigint, obs_no int, property string, value double, unit string, text string")
    got = {r.row_id: (r.unit_code, None if r.converted is None else round(r.converted, 4)) for r in units.with_units(values, entries, unit_df).collect()}
    assert got == {1: ("ksi", 68.9476), 2: ("MPa", 5.0), 3: ("GPa", 5000.0), 7: (None, None), 9: ("um", None)}
    assert sorted(r.row_id for r in units.in_other_units(units.with_units(values, entries, unit_df)).collect()) == [1, 3, 9]
    assert units.with_units(values.limit(0), entries, unit_df).count() == 0
    assert units.with_units(values, entries.limit(0), unit_df.limit(0)).count() == 0


NAMES = ["Polmar & Vale 7", "Dorsk 7, mk 2", "Dorsk 7", "Kestrom press and anvil 12", "Vello Kiln 7 / wide", "HALR110", "Brubin F/S 60"]


@pytest.mark.parametrize("text,items", [
    ("Polmar & Vale 7 & HALR110", ["Polmar & Vale 7", "HALR110"]), ("dorsk 7, mk 2, Dorsk 7", ["dorsk 7, mk 2", "Dorsk 7"]), ("Dorsk 7,HALR110", ["Dorsk 7", "HALR110"]),
    ("Kestrom press and anvil 12 and halr110;", ["Kestrom press and anvil 12", "halr110"]), ("“Dorsk 7, mk 2”\n«HALR110»;; 'Brubin F/S 60'", ["Dorsk 7, mk 2", "HALR110", "Brubin F/S 60"]),
    ('["Vello Kiln 7 / wide", "HALR110"]', ["Vello Kiln 7 / wide", "HALR110"]), ("[HALR110; Dorsk 7]", ["HALR110", "Dorsk 7"]), ('"HALR110; Dorsk 7', ["HALR110", "Dorsk 7"]),
    ("HALR110 / Vello Kiln 7 / wide / Brubin F/S 60", ["HALR110", "Vello Kiln 7 / wide", "Brubin F/S 60"]), ("", []), (" ;, | ", []), (None, []), ('""', []),
])
def test_grammar_of_packed_values(text, items):
    assert [p.item for p in Grammar(NAMES).parse(text) if p.listed] == items


def test_unknown_and_broken_pieces():
    pieces = Grammar(NAMES).parse('"HALR110; odd thing, Dorsk 7')
    assert [(p.item, p.listed, p.broken) for p in pieces] == [("HALR110", True, True), ("odd thing", False, False), ("Dorsk 7", True, False)]


def test_split_fields_numbers_over_the_whole_field(spark):
    rows = [("t", 1, ["HALR110", None, "", "Dorsk 7; Brubin F/S 60"]), ("t", 2, None), ("t", 3, ["HALR110"]), ("t", 4, []), ("t", 5, ["x;" * 3000])]
    df = spark.createDataFrame(rows, "origin string, row_id bigint, texts array<string>")
    got = [(r.row_id, r.item_no, r.text_no, r.item) for r in packed_values.split_fields(df, NAMES).filter("listed").orderBy("row_id", "item_no").collect()]
    assert got == [(1, 1, 0, "HALR110"), (1, 2, 3, "Dorsk 7"), (1, 3, 3, "Brubin F/S 60"), (3, 1, 0, "HALR110")]
    assert {r.row_id for r in packed_values.split_fields(df, NAMES, True).collect()} == {1}
    assert packed_values.split_fields(df.limit(0), NAMES).count() == 0


def test_flat_tables_keep_whole_records(spark, tmp_path):
    schema = (
        "exp_row bigint, observations array<struct<property_name:string,value:double,unit:string,confidence:double,metadata:map<string,string>>>,"
        "findings array<struct<finding_id:bigint,summary:string,decision:string,observation_indices:array<int>,metadata:map<string,string>>>,"
        "text_units array<struct<content:string,metadata:map<string,string>>>"
    )
    rows = [
        (1, [("p", 1.0, "MPa", 0.5, {"a": "1"}), None, (" ", 2.0, "K", None, None)], [(7, "s", "keep", [0, -1, 1, 9], {"b": "2"}), None, (8, None, None, None, None)], [("t", {"c": "3"}), ("", {"d": "4"}), None]),
        (2, None, [(9, "no links", None, [0], None)], None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {k: sorted((tuple(r) for r in t.collect()), key=lambda r: r[:3]) for k, t in nested.write_flat_tables(df, str(tmp_path / "flat")).items()}
    assert got == {
        "observation": [(1, 0, True, "p", 1.0, "MPa", 0.5, {"a": "1"}), (1, 2, False, " ", 2.0, "K", None, None)],
        "finding": [(1, 0, 7, "s", "keep", [0, -1, 1, 9], {"b": "2"}), (1, 2, 8, None, None, None, None), (2, 0, 9, "no links", None, [0], None)],
        "text_unit": [(1, 0, True, "t", {"c": "3"}), (1, 1, False, "", {"d": "4"})],
        "finding_observation": [(1, 0, 0, True), (1, 0, 2, False)],
    }
    assert all(t.count() == 0 for t in nested.write_flat_tables(df.limit(0), str(tmp_path / "none")).values())


@pytest.mark.parametrize("text,items", [
    ("(HALR110), (Dorsk 7)", ["HALR110", "Dorsk 7"]), ("{HALR110; Dorsk 7}", ["HALR110", "Dorsk 7"]), ("[(HALR110 / Dorsk 7), {Polmar & Vale 7}] and Brubin F/S 60", ["HALR110", "Dorsk 7", "Polmar & Vale 7", "Brubin F/S 60"]),
    ("(HALR110, Dorsk 7", ["HALR110", "Dorsk 7"]), ("HALR110), Dorsk 7", ["HALR110", "Dorsk 7"]), ("[HALR110; (Dorsk 7]", ["HALR110", "Dorsk 7"]), ("(a (b) c), HALR110", ["a (b) c", "HALR110"]), ("rig (old); HALR110", ["rig (old)", "HALR110"]),
    ("HALR110 und Dorsk 7", ["HALR110", "Dorsk 7"]), ("HALR110 et Dorsk 7 и Brubin F/S 60", ["HALR110", "Dorsk 7", "Brubin F/S 60"]), ("((()))", []), ("([{" * 50 + "HALR110" + ")]}" * 3, ["HALR110"]), ("'(HALR110)', Dorsk 7", ["(HALR110)", "Dorsk 7"]),
])
def test_brackets_and_words_between_items(text, items):
    got = Grammar(NAMES).parse(text)
    assert [p.item for p in got] == items


def test_deep_and_long_marks_end():
    g = Grammar(NAMES)
    assert [p.item for p in g.parse("(" * 5000 + "HALR110" + ")" * 5000 + ", Dorsk 7")] == ["HALR110", "Dorsk 7"]
    assert [p.item for p in g.parse("(" * 20000 + "HALR110" + "}" * 20000)] == ["HALR110"]
    assert [p.item for p in g.parse("({[" * 3000 + "x")] == ["x"]


def test_broken_marks_are_flagged():
    got = Grammar(NAMES).parse("(HALR110, Dorsk 7; x")
    assert [(p.item, p.listed, p.broken) for p in got] == [("HALR110", True, True), ("Dorsk 7", True, False), ("x", False, False)]


def test_long_unit_expressions_and_texts():
    u = UnitList(UNITS)
    # more than five words, more than forty characters, and products with many readings
    assert u.mentions("given in newton per square millimetre metre per metre metre per metre") == ["N/mm2"]
    assert u.named_in("density, kilogram    per    cubic      metre                       only", "density") == "kg/m3"
    assert u.code_of("m / m * " * 30 + "MPa") == "MPa"
    long = "no unit 1 2 3 4 5 of the run " * 3000 + "53 ksi"
    assert u.mentions(long) == ["ksi"]
