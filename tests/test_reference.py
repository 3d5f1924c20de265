from sitelens.operators import linkgraph, packed_values, relations, rules, sites
from sitelens.queries import reference
from tests.test_rules import CELLS, _columns


def test_sitemap_lists_every_page(spark, tmp_path):
    n = reference.CHILD_LOCS * 2 + 7
    pages = {("a.example", f"https://a.example/{i}?x=1&y=2") for i in range(n)} | {("b.example", "https://b.example/")}
    # rows of one site lie far apart, so its row numbers span more than 50 times the size of a child
    rows = [(host, 60 * i, url) for i, (host, url) in enumerate(sorted(pages))] + [("b.example", 60 * n + 61, "https://b.example/")]
    spark.createDataFrame(rows, "host string, row_no bigint, url string").write.parquet(f"{tmp_path}/crawl.parquet")
    got = [(r.site, r.loc) for r in reference.sitemap_expanded(spark, str(tmp_path)).collect()]
    assert len(got) == len(pages) and set(got) == pages


def test_html_pages_carry_their_true_counts(spark, tmp_path):
    cells = {"url": "https://a.example/", "title": "T", "meta_desc": "", "h1": "H", "robots_meta": "", "html_lang": "de", "viewport_content": "", "canonical": "", "img_jpg": "41", "img_webp": "55", "outlinks_internal": "196"}
    spark.createDataFrame([(1, *cells.values())], "row_no bigint, " + ", ".join(f"{c} string" for c in cells)).write.parquet(f"{tmp_path}/crawl.parquet")
    (r,) = reference.html_features_q(spark, str(tmp_path)).collect()
    assert (r.img_jpg, r.img_webp, r.img_total, r.outlinks_internal) == ("41", "55", "96", "196")


def _crawl(spark, path, rows):
    cols = sorted({"host", "url", "heading_outline", "hreflang", "hreflang_links", "resource_paths", "has_org", "has_microdata", "has_rdfa", *_columns(), *relations._FIELDS, *CELLS, "error_code", "ld_types", "robots_meta", "viewport_content"})
    made = [(i, *[({c: "" for c in cols} | CELLS | r)[c] for c in cols]) for i, r in enumerate(rows)]
    spark.createDataFrame(made, "row_no bigint, " + ", ".join(f"{c} string" for c in cols)).write.parquet(f"{path}/crawl.parquet")
    return str(path)


def test_audit_covers_the_whole_catalogue(spark, tmp_path):
    host = "abcd.example.x"  # 14 letters: its robots.txt closes the whole site
    pages = [{"host": host, "url": f"https://{host}/{i}", "title": f"A fine title that is long enough {i // 2}", "hreflang": "zz" if i == 1 else ""} for i in range(6)]
    at = _crawl(spark, tmp_path, pages)
    status = {r.rule_id: r.status for r in reference.audit_status(spark, at).collect()}
    assert set(status) == set(rules.CATALOGUE) and set(status.values()) == {"finding", "positive", "skipped"}
    assert status["onpage:title-dup"] == status["tech:robots-site-blocked"] == status["i18n:hreflang-invalid-code"] == "finding" and status["tech:safe-browsing-flagged"] == "skipped"
    found = {r.rule_id: (r.hits, r.pct_of_pages) for r in reference.audit_findings(spark, at).collect()}
    assert set(found) == {r for r, s in status.items() if s == "finding"}
    assert found["onpage:title-dup"] == (6, 100.0) and found["i18n:hreflang-invalid-code"] == (1, 16.7) and found["tech:robots-site-blocked"] == (1, None)
    assert {r.row_no for r in reference.audit_hits(spark, at).collect() if r.rule_id == "onpage:title-dup"} == set(range(6))
    named = {r for r in found if r not in sites.CONDITIONS}
    assert {r.rule_id for r in reference.audit_samples(spark, at).collect()} == {r.rule_id for r in reference.audit_clusters(spark, at).collect()} == named


def test_depth_has_no_bound(spark):
    n = 70
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(n)], "src string, dst string").coalesce(1)
    roots = spark.createDataFrame([("0",)], "url string").coalesce(1)
    assert {r.url: r.depth for r in linkgraph.click_depth(edges, roots).collect()} == {str(i): i for i in range(n + 1)}
    assert linkgraph.click_depth(edges, roots, max_depth=2).count() == 3


def test_frontier_goes_on_to_the_profile_limit(spark, tmp_path):
    rows = [(i, "a.example", f"https://a.example/{i}", f"https://a.example/{i}", "page") for i in range(100)]
    spark.createDataFrame(rows, "row_no bigint, host string, url string, canonical string, page_type string").write.parquet(f"{tmp_path}/crawl.parquet")
    assert sorted(r.no for r in reference.crawl_frontier(spark, str(tmp_path)).collect()) == list(range(1, 101))


def test_value_of_any_number_of_paths():
    cell = "/combo?" + ",".join(f"/p{i}" for i in range(150))
    atoms, model = packed_values.atoms_of(cell, "resource_paths"), packed_values.Model({"I,?": 1e6})
    assert packed_values.edges_of(atoms)[0][-1].end == 150
    assert packed_values.best_cuts(atoms, model) == [150]
