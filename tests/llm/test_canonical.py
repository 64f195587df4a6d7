from lodeworks.llm import canonical as C

ENTRIES = [
    ("Pleldeskal 357", "a"), ("PRB-357", "a"), ("NRG P00357", "a"), ("Pleldeskal alloy grade 357", "a"), ("Pleldeskal 234", "b"), ("PRB-234", "b"),
    ("Skuzmaipran 528", "c"), ("Скузмаипран 528", "c"), ("Skuzmaipran 83", "d"), ("Skuzmaipran/SSB 83", "d"), ("Kerkentex 928", "e"), ("Kerkentex 928, cast", "e"), ("Vosteston 842", "f"), ("Gildimbor 357", "g"),
]


def test_what_is_meant():
    m = C.Matcher(ENTRIES)
    cases = {
        "PLELDESKAL 357 ": "a", "357 pleldeskal": "a", "Pleldesakl-357": "a", "Plledeskal 357": "a", "prb 357": "a", "PRB357": "a", "nrg p00357": "a", "recycled Pleldeskal 357": "a",
        "Pleldeskal 357 (bar stock)": "a", "Pleldesk. 357": "a", "Pleldeskаl 234": "b", "Pleldéskal 234": "b", "Плелдескал 234": "b", "скузмаипран 528": "c", "Skuzmaiprn 83": "d",
        "Kerkentex 928 ,cast": "e", "Voste. 842": "f", "Gildimbr 357": "g", "approx. PRB-234 ?": "b",
    }
    assert {t: m.match(t)[0] for t in cases} == cases


def test_what_is_not():
    m = C.Matcher(ENTRIES)
    for t in ("Pleldeskal 358", "Pleldeskal", "dummy coupon", "357", "alloy 357", "Lombumskal 357", "???", " ", "PRC-357", "unknown"):
        assert m.match(t) == (C.UNMATCHED, 0.0), t
    assert C.Matcher([]).match("anything 1") == (C.UNMATCHED, 0.0)


def test_edits_against_a_plain_recursion():
    from functools import lru_cache

    def slow(a, b):
        @lru_cache(None)
        def d(i, j):
            if not i or not j:
                return i + j
            best = min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, d(i - 2, j - 2) + 1)
            return best

        return d(len(a), len(b))

    words = ["kerkentex", "krekentex", "kerkntx", "gildimbor", "gidlimbor", "", "a", "pleldeskal"]
    for a in words:
        for b in words:
            want = slow(a, b)
            assert C.edits(a, b, 3) == (want if want <= 3 else 4)


def test_over_tables_with_hot_text_and_nulls(spark):
    names = spark.createDataFrame(ENTRIES, "name string, canonical_id string")
    rows = [("r", i, "Pleldesakl 357") for i in range(300)] + [("r", 900, None), ("r", 901, ""), ("e", 902, " "), ("e", 903, "Pleldeskal 357"), ("e", 904, "z" * 50_000)]
    values = spark.createDataFrame(rows, "origin string, row_id bigint, text string").repartition(3)
    got = {(r.origin, r.row_id): r.canonical_id for r in C.mapped(C.not_listed(values, names), names).collect()}
    assert got == {**{("r", i): "a" for i in range(300)}, ("e", 902): C.UNMATCHED, ("e", 904): C.UNMATCHED}
    assert C.mapped(values.limit(0), names).count() == 0
    assert {r.canonical_id for r in C.mapped(values, names.limit(0)).collect()} == {C.UNMATCHED}


def test_long_words_are_repaired_too():
    long = "Poly" + "methyl" * 12 + "acrylat"
    m = C.Matcher([*ENTRIES, (f"{long} 12", "z"), ("Tetrahydrofurfurylmethacrylatdimethylsiloxan 9", "y")])
    assert m.match(f"{long[:30]}{long[31:]} 12")[0] == "z" and m.match(f"{long}e 12")[0] == "z"
    assert m.match("Tetrahydrofurfurylmethacrylatdimethylsiloxn 9")[0] == "y"
    assert m.match("x" * 5000 + " 12")[0] == C.UNMATCHED
