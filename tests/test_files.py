import datetime as dt
import json

from sitelens.operators import contracts, evaluation, html_features, knowledge
from sitelens.operators.rules import CATALOGUE
from sitelens.plans import files
from sitelens.sources import artifacts, registry, search_console
from tests.test_rules import CELLS

H = "https://demo.example"


def _rules(path):
    path.mkdir()
    rule = lambda i, **p: {"id": i, "kategorie": "x", "scope": "agnostic", "severity": "mittel", "title": "t", "params": p}
    (path / "a.json").write_text(json.dumps([rule("onpage:title-long", maxTitle=20), rule("no:detector")]))
    (path / "b.json").write_text(json.dumps([rule("links:deep", maxDepth=1), rule("geo:no-faq-howto"), rule("tech:sitemap-quality"), rule("perf:cwv-field-fail")]))
    return str(path)


def test_rule_files(spark, tmp_path):
    rules = registry.load_rules(spark, _rules(tmp_path / "rules"))
    known = registry.catalogue_of(rules)
    assert list(known) == [r for r in CATALOGUE if r in known] and len(known) == 5
    assert known["onpage:title-long"].params == {"maxTitle": 20} and known["onpage:title-long"].severity == "mittel"
    found = {(r.rule_id, r.problem) for r in registry.parity(rules).collect()}
    assert ("no:detector", "no detector") in found and sum(p == "no rule" for _, p in found) == len(CATALOGUE) - 5


def test_analysis_from_files(spark, tmp_path):
    cells = {c: "" for c in artifacts.CRAWL_COLUMNS} | CELLS
    pages = [cells | {"url": f"{H}/"}, cells | {"url": f"{H}/a", "title": 'quoted "long" title, with a\nbreak'}, cells | {"url": f"{H}/b", "status": "404"}, cells | {"url": f"{H}/c", "title_len": "10"}]
    rows = spark.createDataFrame([tuple(p[c] for c in artifacts.CRAWL_COLUMNS) for p in pages], artifacts.CRAWL_COLUMNS).coalesce(1)
    artifacts.write_csv(rows, f"{tmp_path}/crawl.csv")
    signals = {
        "robots": {"exists": True, "raw": "User-agent: *\nDisallow: /b\n"}, "llms": {"exists": False}, "sitemapUrls": [f"{H}/a", f"{H}/b", f"{H}/b"], "httpProbe": {"reachable": True, "redirectsToHttps": True},
        "linkGraph": {"edges": [{"url": f"{H}/", "internalLinks": [f"{H}/a"]}, {"url": f"{H}/a", "internalLinks": [f"{H}/b", f"{H}/kontakt"]}]}, "crawlMeta": {"fetched": 4, "discovered": 5},
    }
    (tmp_path / "signals.json").write_text(json.dumps(signals))
    (tmp_path / "runtime.json").write_text(json.dumps({"available": True, "crux": {"lcp": {"category": "poor"}}, "tls": {"available": False}}))
    got = files.analyze(spark, f"{tmp_path}/crawl.csv", f"{tmp_path}/signals.json", runtime_json=f"{tmp_path}/runtime.json")
    status = {r.rule_id: r.status for r in got.status.collect()}
    assert set(status) == set(CATALOGUE)
    for rule_id, want in {
        "links:internal-broken": "finding", "tech:robots-sitemap-conflict": "finding", "tech:sitemap-quality": "finding", "geo:llms-txt-malformed": "finding", "perf:cwv-field-fail": "finding", "tech:tls-cert-expiring": "skipped",
        "trust:contact-pages-missing": "positive", "tech:http-not-redirected": "positive", "crawl:orphan-page": "finding", "links:deep": "positive", "tech:robots-site-blocked": "positive",
    }.items():
        assert status[rule_id] == want, rule_id
    urls = {(r.rule_id, r.url) for r in got.hits.collect()}
    assert ("crawl:orphan-page", f"{H}/c") in urls and ("links:internal-broken", f"{H}/a") in urls and ("tech:sitemap-quality", f"{H}/b") in urls
    (meta,) = got.meta.collect()
    assert (meta.pages, meta.origin, meta.coverage_pct) == (4, H, 100)
    files.write(got, f"{tmp_path}/out")
    assert {(r.rule_id, r.url) for r in artifacts.read_affected(spark, f"{tmp_path}/out/affected-urls").collect()} == urls
    few = files.analyze(spark, f"{tmp_path}/crawl.csv", f"{tmp_path}/signals.json", rules_dir=_rules(tmp_path / "rules"))
    assert {r.rule_id for r in few.status.collect()} == {"onpage:title-long", "links:deep", "geo:no-faq-howto", "tech:sitemap-quality", "perf:cwv-field-fail"}
    assert {(r.rule_id, r.url) for r in few.hits.collect()} == {("onpage:title-long", f"{H}/"), ("onpage:title-long", f"{H}/a"), ("onpage:title-long", f"{H}/b"), ("links:deep", f"{H}/b"), ("tech:sitemap-quality", f"{H}/b")}


def test_contracts(spark):
    docs = {
        "ok": {"fixture": "a", "mustContain": [{"ruleId": "x", "note": "n"}], "mustNotContain": []}, "list": [], "bad": {"mustContain": [1, {"ruleId": 3}, {"note": 4}], "mustNotContain": {}},
    }
    df = spark.createDataFrame([(k, json.dumps(v), "x") for k, v in docs.items()] + [("broken", "{", "x"), ("none", None, "x")], "k string, t string, problem string")
    got = {(r.k, r.problem) for r in contracts.expected_errors(df, "k", "t").collect()}
    assert got == {
        ("list", "no JSON object"), ("broken", "no JSON object"), ("none", "no JSON object"), ("bad", "fixture: missing"), ("bad", "mustNotContain: must be array"), ("bad", "mustContain[0]: must be object"),
        ("bad", "mustContain[1].ruleId: must be string"), ("bad", "mustContain[2].ruleId: missing"), ("bad", "mustContain[2].note: must be string"),
    }
    finding = {k: "x" for k in "id title category severity prov befund beleg auswirkung empfehlung".split()} | {"ice": {}, "kbSources": []}
    good = {
        "meta": {"url": "u", "crawledAt": None, "modelId": "m", "rulesetVersion": "1", "sampleSize": 4, "coveragePct": None, "siteType": "s"}, "execSummary": {"metrics": [], "patterns": ["x"], "quickWins": []},
        "sections": [{"id": "s", "num": 1, "title": "t", "findings": [finding]}], "positives": ["a"], "strategy": {"levers": [], "todos": []}, "confidence": {"sampleSize": 4, "minNMet": False, "caveats": []},
    }
    bad = json.loads(json.dumps(good)) | {"positives": [1]}
    bad["confidence"] |= {"sampleSize": 5}
    bad["sections"][0]["findings"].append(finding | {"prov": None, "ruleIds": [1]})
    del bad["meta"]["url"]
    df = spark.createDataFrame([("good", json.dumps(good)), ("bad", json.dumps(bad))], "k string, t string")
    assert {(r.k, r.problem) for r in contracts.findings_errors(df, "k", "t").collect()} == {
        ("bad", "positives: must hold strings"), ("bad", "confidence.minNMet: must tell whether sampleSize is 5 or more"), ("bad", "meta.sampleSize: must equal confidence.sampleSize"), ("bad", "meta.url: missing"),
        ("bad", "sections[0].findings[1].prov: must be string"), ("bad", "sections[0].findings[1].ruleIds: must hold strings"),
    }


def test_search_console(spark, tmp_path):
    assert search_console.window(dt.date(2026, 3, 31)) == ("2026-02-28", "2026-03-28")
    rows = [{"keys": ["q", "/a"], "clicks": 2, "impressions": 10, "ctr": 0.2, "position": 3.0}, {"keys": ["r", "/a"], "clicks": 0, "impressions": 30, "ctr": 0, "position": 7.0}]
    (tmp_path / "a.json").write_text(json.dumps({"available": True, "property": "p", "rows": rows}))
    (tmp_path / "b.json").write_text(json.dumps({"available": False, "reason": "no key"}))
    got = search_console.read_exports(spark, str(tmp_path))
    assert got.count() == 2 and [tuple(r) for r in search_console.per_page(got).collect()] == [("p", "/a", 2, 40, 0.05, 6.0)]


def test_frontier_links(spark):
    page = '<a class=x href="/a/">1</a><a href=\'b/index.html#f\'>2</a><a href="https://other.example/">3</a><a href="/a/">4</a><a href="mailto:x@y">5</a><a href="?q=1&amp;r=2">6</a>'
    df = spark.createDataFrame([(f"{H}/d/x", page), ("nonsense", page), (f"{H}/", None)], "url string, html string")
    assert [(r.ord, r.link) for r in html_features.frontier_links(df, "url", "html").orderBy("ord").collect()] == [(0, f"{H}/a/"), (1, f"{H}/d/b/index.html"), (2, f"{H}/d/x?q=1&r=2")]
    seeds = spark.createDataFrame([(f"{H}/p?x=1#f",), (H,), ("HTTPS://o.example?z",), ("no",)], "u string").selectExpr("u", "'http://127.0.0.1:1' AS o")
    assert [r.x for r in seeds.select(artifacts.to_origin("u", "o").alias("x")).collect()] == ["http://127.0.0.1:1/p?x=1", "http://127.0.0.1:1/", "http://127.0.0.1:1/?z", None]


def test_ingest(spark):
    rows = [("a.md", "---\nsource: https://s\ndatum: 2026-01\n---\n# One\n\n## Two\nbody two\n```\n# no\n```\n"), ("b.md", "plain text"), ("c.md", "")]
    df = spark.createDataFrame(rows, "file string, text string")
    got = {r.id: r for r in knowledge.ingest(df).collect()}
    assert set(got) == {"a.md#0", "a.md#1", "b.md#0"} and got["a.md#0"].text == "One" and got["a.md#1"].date == "2026-01" and got["b.md#0"].source == "b.md" and got["a.md#1"].heading == "Two"
    assert {r.source for r in knowledge.citation_allowlist(df).collect()} == {"https://s", "a.md"}


def test_vectors_of_other_lengths(spark):
    e = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None), (4, [None, 1.0])], "id bigint, vec array<double>")
    assert [(r.id, r.score) for r in knowledge.top_k(e, e.where("id = 0"), k=5).orderBy("rank").collect()] == [(0, 1.0), (1, 1.0), (2, 0.0), (3, 0.0), (4, 0.0)]


def test_handoff(spark):
    ice = "struct<i:int,c:int,e:int,score:int>"
    schema = f"run_key bigint, fixture string, run_no int, produced_at int, sections array<struct<id:string,num:int,title:string,findings:array<struct<id:string,severity:string,beleg:string,rule_ids:array<string>,ice:{ice}>>>>"
    runs = [(1, "f", 1, 1, [("b", 2, "B", [("x", "hoch", "", ["r1", "r9"], None)]), ("a", 1, None, [])]), (2, "f", 2, 1, None)]
    df, rules = spark.createDataFrame(runs, schema), spark.createDataFrame([("r1",), ("r2",)], "rule_id string")
    got = {r.run_key: (r.sections, r.interpreted, r.remaining) for r in evaluation.handoff(df, rules).collect()}
    assert got == {1: (["1 a (untitled)", "2 b B"], ["r1", "r9"], ["r2"]), 2: ([], [], ["r1", "r2"])}
    own = spark.createDataFrame([(1, "r2")], "run_key bigint, rule_id string")
    assert [tuple(r) for r in evaluation.ledger(df, own).collect()] == [(1, "r2", "remaining")]
    assert {(r.run_key, r.hoch, r.hoch_end) for r in evaluation.severity_histogram(df).collect()} == {(1, 1, 100), (2, 0, 0)}
