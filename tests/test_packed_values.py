from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitelens.operators.packed_values import KINDS, Model, atoms_of, best_cuts, edges_of, expect, lattice_report, learn, one_path, split_cell, split_packed

M = {f: Model() for f in KINDS}


@pytest.mark.parametrize(
    "field, cell, want",
    [
        ("redirect_chain", '["https:\\/\\/a.b\\/c","http://x/go/2;s=1"]', ["https://a.b/c", "http://x/go/2;s=1"]),
        ("redirect_chain", "https://x/go;s=1;https://y?f=a,b;;", ["https://x/go;s=1", "https://y?f=a,b"]),
        ("redirect_chain", "https://x > http://y?tags=x|y", ["https://x", "http://y?tags=x|y"]),
        ("redirect_chain", "(https://x)", ["https://x"]),
        ("resource_paths", "/css/menu, new.mjs|/build/a(1).mjs", ["/css/menu, new.mjs", "/build/a(1).mjs"]),
        ("resource_paths", "/combo?/a/b.js,/css/base.css|/x.js", ["/combo?/a/b.js,/css/base.css", "/x.js"]),
        ("resource_paths", '"/b.js?q=""dark""",/c', ['/b.js?q="dark"', "/c"]),
        ("resource_paths", "'/a,b.js' | '/c'", ["/a,b.js", "/c"]),
        ("hreflang", "it/es-MX / de-AT", ["it", "es-MX", "de-AT"]),
        ("hreflang", ",de, ,de,,", ["de", "de"]),
        ("ld_types", "https://schema.org/Product,https://schema.org/Product;;schema:Store\tHowTo", ["https://schema.org/Product"] * 2 + ["schema:Store", "HowTo"]),
        *[("ld_types", x, []) for x in (None, "", "  ", "[]", "-", "none", "NULL", "{}", ";;|")],
    ],
)
def test_cells(field, cell, want):
    assert split_cell(cell, field, M[field]) == want


@given(st.lists(st.from_regex(r"/[a-z]{1,8}(/[a-z]{1,5}){0,2}\.(css|js)", fullmatch=True), min_size=1, max_size=9), st.sampled_from(["|", ", ", ";", " | ", "\r\n", "\t", ",,"]), st.booleans())
@settings(max_examples=150, deadline=None)
def test_round_trip(paths, sep, quoted):
    cell = sep.join(f'"{p}"' if quoted else p for p in paths)
    assert split_cell(cell, "resource_paths", M["resource_paths"]) == paths


def test_em_moves_to_values_seen_whole():
    cells = [("/combo?/a.js,/b.js", 10), ('"/combo?/c.js,/d.js"', 30), ("/e.js|/f.js", 50)]
    field, model = "resource_paths", Model()
    for _ in range(4):
        counts = Counter()
        for cell, n in cells:
            expect(atoms_of(cell, field), n, field, model, counts)
        values = sum(v for k, v in counts.items() if k[0] == "V")
        assert values == pytest.approx(40 + 100 + counts["E,?"]) and values == pytest.approx(sum(v for k, v in counts.items() if k[0] == "S"))
        model = Model(dict(counts))
    assert split_cell("/combo?/a.js,/b.js", field, model) == ["/combo?/a.js,/b.js"] and counts["E,?"] < 0.1


def test_em_learns_that_a_list_ends():
    """Where the column has the second path alone again and again, and never the list as a whole, the list is cut."""
    field, model = "resource_paths", Model()
    for _ in range(6):
        counts = Counter()
        for cell, n in [("/x?/a.js,/b.js", 5), ("/b.js", 4000), ("/x?/a.js", 4000), ("/x?/a.js|/b.js", 4000)]:
            expect(atoms_of(cell, field), n, field, model, counts)
        model = Model(dict(counts))
    assert split_cell("/x?/a.js,/b.js", field, model) == ["/x?/a.js", "/b.js"]


@pytest.mark.parametrize("n", [2, 3, 7, 200, 2000])
def test_lists_of_any_length(spark, n):
    combo = "/combo?" + ",".join(f"/x{i}/y.js" for i in range(n))
    cells = {f"/a.css|{combo}|/z.js": ["/a.css", combo, "/z.js"], f'"{combo}", /z.js': [combo, "/z.js"], f"{combo};/combo?/q.js,/r.js": [combo, "/combo?/q.js,/r.js"]}
    for cell, want in cells.items():
        assert split_cell(cell, "resource_paths", M["resource_paths"]) == want
    if n == 7:
        df = spark.createDataFrame([(c,) for c in cells] * 3, "resource_paths string")
        model = learn(df, ["resource_paths"])["resource_paths"]
        assert all(split_cell(c, "resource_paths", model) == want for c, want in cells.items())
        (r,) = lattice_report(df, ["resource_paths"]).collect()
        assert (r.cells, r["values"], r.decided) == (9, 21, 6)


def test_marks_inside_values_are_lattice_choices():
    for cell, field, want in [("https://x/?f=a,b|https://y/?tags=x|y", "redirect_chain", 2), ("/css/menu, new.mjs|/b.js", "resource_paths", 2)]:
        atoms = atoms_of(cell, field)
        assert not one_path(atoms) and any(len(own) > 1 for own in edges_of(atoms)) and len(split_cell(cell, field, M[field])) == want
    long = "https://x/?f=" + ",".join("ab" for _ in range(3000))
    assert split_cell(long, "redirect_chain", M["redirect_chain"]) == [long]


def test_table(spark):
    rows = [(1, "https://a|https://b", "x"), (2, None, "x"), (3, "https://a|https://a", "x"), (3, "https://a|https://a", "x"), (4, "|".join(["https://h/p?f=a,b"] * 3000), "x")]
    df = spark.createDataFrame(rows, "row_no bigint, redirect_chain string, item string")  # a clashing extra column
    got = split_packed(df, "row_no", ["redirect_chain"]).collect()
    assert sorted((r.row_no, r.ord, r.item) for r in got if r.row_no < 3) == [(1, 1, "https://a"), (1, 2, "https://b")]
    assert sum(r.row_no == 3 for r in got) == 4 and sum(r.row_no == 4 for r in got) == 3000
    assert split_packed(df.where("false"), "row_no", ["redirect_chain"]).count() == 0
