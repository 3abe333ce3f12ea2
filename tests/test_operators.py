"""Hand-computed cases and properties of the library's operators."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferrule import fixed
from ferrule.functions import versions
from ferrule.functions.text import entropy, first_line, required_text, word_boundary
from ferrule.operators import detect, enrich, graph, learn, plugins, relate, report, risk, windows
from ferrule.sinks import reports
from ferrule.sources import files, rules
from ferrule.streaming.state import limit_decisions


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("a, b, sign", [("1.2.3", "1.2.3", 0), ("1.10", "1.9", 1), ("1", "1.0.0", 0), ("1-beta", "0.1", -1), ("2.0", "10.0", -1)])
def test_compare_versions(spark, a, b, sign):
    assert spark.range(1).select(versions.compare(F.lit(a), F.lit(b))).first()[0] == sign


@pytest.mark.parametrize("version, wanted, inside", [("1.5.0", ">=1.0.0 <2.0.0", True), ("2.0.0", ">=1.0.0 <2.0.0", False), ("9", "*", True), ("1.0.0", "< 2.0.0", False)])
def test_ranges(spark, version, wanted, inside):
    assert spark.range(1).select(versions.in_range(F.lit(version), F.lit(wanted))).first()[0] is inside


def test_entropy_and_lines(spark):
    found = spark.createDataFrame([("aabb",), ("",), ("aaaa",)], "t string").select(F.round(entropy("t"), 6)).collect()
    assert [r[0] for r in found] == [1.0, 0.0, 0.0]
    assert spark.createDataFrame([("x\ny1\nz2",)], "t string").select(first_line("t", "[0-9]")).first()[0] == 2
    assert spark.range(1).select(F.regexp_count(F.lit("rce source é rce"), F.lit(word_boundary(r"\brce\b")))).first()[0] == 2


def test_rule_hits(spark):
    source = spark.createDataFrame([(1, "eval(x); eval(y)"), (2, None), (3, "")], "id long, content string")
    found = detect.rule_hits(source, {"r": ("HIGH", "", 0.8, [r"eval\s*\(", "nothing"])})
    assert [(r["id"], r["matches"], round(r["confidence"], 6)) for r in found.collect()] == [(1, 2, 0.95)]


def test_risk_is_capped_and_monotonic(spark):
    def overall(threats):
        frame = spark.createDataFrame([("k", t, s, c) for t, s, c in threats], "key string, type string, severity string, confidence double")
        return risk.composite_risk(frame, ["key"]).first()["overall"]

    assert overall([("DATA_EXFILTRATION", "CRITICAL", 1.0)]) == 0.7
    assert overall([("X", "LOW", 1.0)]) < overall([("X", "HIGH", 1.0)]) <= overall([("X", "HIGH", 1.0)] * 9) <= 1.0


def test_propagation_and_trust(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "parent string, child string")
    nodes = spark.createDataFrame([("a", 0.9), ("b", 0.0), ("c", 0.8), ("d", 0.1)], "node string, base double")
    assert {r["node"]: round(r["risk"], 6) for r in graph.propagate_risk(nodes, edges).collect()} == {"a": 0.9, "b": 0.765, "c": 0.8, "d": 0.1}
    direct = spark.createDataFrame([("a", None), ("b", None), ("c", 0.8), ("d", None)], "node string, direct double")
    assert {r["node"]: round(r["trust"], 6) for r in graph.transitive_trust(direct, edges).collect()} == {"a": 0.072, "b": 0.24, "c": 0.8, "d": 0.0}


def test_merge_raises_the_first_dependency(spark):
    kind = "package string, type string, severity string, confidence double, vulnerability string, ord long"
    existing = spark.createDataFrame([("p", "SUSPICIOUS_DEPENDENCY", "LOW", 0.5, "V1", 1), ("p", "SUSPICIOUS_DEPENDENCY", "LOW", 0.4, "V2", 2)], kind)
    found = spark.createDataFrame([("p", "VULNERABLE_PACKAGE", "HIGH", 0.9, "V3", 3), ("p", "VULNERABLE_PACKAGE", "MEDIUM", 1.0, "V4", 4), ("q", "VULNERABLE_PACKAGE", "LOW", 0.3, "V5", 5), ("q", "VULNERABLE_PACKAGE", "LOW", 0.2, "V5", 6), ("p", "VULNERABLE_PACKAGE", "CRITICAL", 1.0, "V1", 7)], kind)
    assert rows(relate.merge_advisories(existing, found)) == [("p", "SUSPICIOUS_DEPENDENCY", "HIGH", 0.9, "V1", 1), ("p", "SUSPICIOUS_DEPENDENCY", "LOW", 0.4, "V2", 2), ("q", "VULNERABLE_PACKAGE", "LOW", 0.3, "V5", 5)]


@given(st.lists(st.floats(0, 1000, allow_nan=False), max_size=40), st.integers(1, 5))
def test_limiter_never_exceeds(times, most):
    times = sorted(times)
    allowed, _, _ = limit_decisions([], times, 0.0, 60.0, most)
    passed = [t for t, ok in zip(times, allowed, strict=True) if ok]
    assert all(sum(t - 60 < x <= t for x in passed) <= most for t in passed)


def test_auc_and_ks(spark):
    frame = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.5), (0, 0.5)], "y int, p double")
    assert learn.roc_auc(frame, "y", "p").first()["auc"] == 0.875
    ks = learn.ks_statistic(spark.createDataFrame([(1.0, False), (2.0, False), (3.0, True), (4.0, True)], "v double, c boolean"), "v", "c").first()
    assert (ks["ks"], ks["drifted"]) == (1.0, True)


def test_similarity_and_names(spark):
    frame = enrich.name_analysis(spark.createDataFrame([("lodas",), ("@a/b",), ("my-malware",)], "name string"))
    assert [(r["risk_level"], r["scope_type"]) for r in frame.collect()] == [("MEDIUM", "PUBLIC"), ("LOW", "PRIVATE"), ("HIGH", "PUBLIC")]


def test_many_names_are_substrings_too(spark):
    texts = spark.createDataFrame([(1, "Eurasia and New Zealand"), (2, "caf\u00e9 au lait"), (3, None), (4, "asia, asia")], "id int, text string")
    names = spark.createDataFrame([("ASIA",), ("new zealand",), ("\u00c9 au",), ("asia",), (None,), ("eu",), ("absent",)], "name string")
    few = rows(relate.mentions(texts, F.col("text"), names, "name").select("id", "name"))
    assert few == [(1, "ASIA"), (1, "asia"), (1, "eu"), (1, "new zealand"), (2, "\u00c9 au"), (4, "ASIA"), (4, "asia")]
    for limit in (1, 2, 3):
        assert rows(relate.mentions(texts, F.col("text"), names, "name", limit).select("id", "name")) == few


def test_content_id(spark):
    # The identifier of the raw bytes "hello", a public example.
    assert spark.range(1).select(report.content_id(F.lit("hello"))).first()[0] == "bafkreibm6jg3ux5qumhcn2b3flc3tyu6dmlb4xa7u5bf44yegnrjhc4yeq"


def test_sarif_and_reports(spark):
    threats = spark.createDataFrame([("s", "A|B", "HIGH", "<p>", 0.9)], "scan string, type string, severity string, package string, confidence double")
    document = json.loads(report.sarif(threats, "scan").first()["sarif"])
    assert document["version"] == "2.1.0" and document["runs"][0]["results"][0]["level"] == "error"
    assert "&lt;p&gt;" in reports.html_report(threats, "T") and "A\\|B" in reports.markdown_report(threats, "T")
    assert reports.signature(b"x", b"k").startswith("sha256=")


def test_files_and_manifests(spark, tmp_path):
    (tmp_path / "a" / "node_modules").mkdir(parents=True)
    (tmp_path / "a" / "x.js").write_text("eval(1)")
    (tmp_path / "a" / "node_modules" / "y.js").write_text("no")
    (tmp_path / "a" / "z.txt").write_text("no")
    (tmp_path / "a" / "package.json").write_text('{"dependencies": {"x": "1", "y": "2"}, "devDependencies": {"y": "3"}}')
    assert [r["file_path"] for r in files.source_files(spark, str(tmp_path)).collect()] == ["a/x.js"]
    assert rows(files.dependencies(files.manifests(spark, str(tmp_path)))) == [("a", "x", "1"), ("a", "y", "3")]


def test_rules(spark):
    parsed = rules.parse("detection_rules:\n  r:\n    patterns: ['eval(', 'ok']\n")
    assert parsed == {"r": ("MEDIUM", "", 0.5, ["eval(", "ok"])}
    assert rules.problems(spark, parsed) == ["r: pattern eval("]
    assert rules.valid(spark, parsed)["r"][3] == ["ok"]
    assert not rules.problems(spark, fixed.RULES)


def test_plugin_errors_become_rows(spark):
    def plugin(content, file_id):
        if file_id == 2:
            raise ValueError
        return [{"type": "T", "severity": "LOW"}]

    source = spark.createDataFrame([(1, "a"), (2, "b")], "file_id long, content string")
    assert rows(plugins.run_plugin(source, plugin)) == [(1, "T", "LOW", 0.5), (2, "ANALYSIS_ERROR", "LOW", 0.0)]


def test_windows(spark):
    events = spark.createDataFrame([("u", f"2024-01-01 00:00:{s:02d}", i) for i, s in enumerate((0, 1, 2, 30, 31))], "u string, t string, i long").withColumn("t", F.col("t").cast("timestamp"))
    assert [r["n"] for r in windows.gap_batches(events, ["u"], "t", 10_000, 2, "i").orderBy("first_ts").collect()] == [2, 1, 2]
    assert [r["in_window"] for r in windows.trailing_count(events, ["u"], "t", 5).orderBy("i").collect()] == [1, 2, 3, 1, 2]


def test_plugin_messages(spark):
    def plugin(content, file_id):
        raise ValueError("no such thing")

    source = spark.createDataFrame([(1, "a")], "file_id long, content string")
    assert rows(plugins.run_plugin(source, plugin, messages=True)) == [(1, "ANALYSIS_ERROR", "LOW", 0.0, "ValueError: no such thing")]


def test_deep_chains_and_cycles(spark):
    n = 30
    nodes = spark.createDataFrame([(str(i), 1.0 if i == 0 else 0.0) for i in range(n)] + [("x", 0.5), ("y", 0.1)], "node string, base double")
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(n - 1)] + [("x", "y"), ("y", "x")], "parent string, child string")
    found = {r["node"]: r["risk"] for r in graph.propagate_risk(nodes, edges).collect()}
    assert all(found[str(i)] == pytest.approx(0.85**i) for i in range(n))
    assert found["x"] == 0.5 and found["y"] == pytest.approx(0.425)
    assert graph.highest_risk(graph.propagate_risk(nodes, edges)).first()["risk"] == 1.0
    direct = spark.createDataFrame([(str(i), 1.0 if i == n - 1 else None) for i in range(n)] + [("x", None), ("y", None)], "node string, direct double")
    trust = {r["node"]: r["trust"] for r in graph.transitive_trust(direct, edges).collect()}
    assert all(trust[str(i)] == pytest.approx(0.3 ** (n - 1 - i)) for i in range(n)) and trust["x"] == trust["y"] == 0.0


def test_lone_packages_are_held_against_typical_ones(spark):
    made = spark.createDataFrame([("a", "g", 4.0, 600.0, 19 / 3, 0.3), ("b", "h", 40.0, 6e7, 60.0, 1.0), ("c", "i", 1e8, 1e8, 1e8, 1.0), ("d", "i", 1e8 + 1, 1e8, 1e8, 1.0), ("e", "i", 1e8 + 3, 1e8, 1e8, 1.0)], "p string, g string, script_count double, script_length double, dependency_count double, entropy_score double")
    found = {r["p"]: r["cross_package_anomaly"] for r in enrich.cross_package_anomaly(made, "g").collect()}
    assert found["a"] == 0.0 and found["b"] == 1.0
    assert found["c"] == pytest.approx(2.0 / 4 / 3, abs=1e-5)  # mean 2 above, deviation 1: no digits lost


@pytest.mark.parametrize("version, wanted, loose, strict", [
    ("1.2.3", "^1.0.0", True, True), ("2.0.0", "^1.0.0", True, False), ("0.3.0", "^0.2.1", True, False), ("0.2.9", "^0.2.1", True, True), ("1.2.9", "~1.2.3", True, True), ("1.3.0", "~1.2.3", True, False),
    ("1.2.3", "1.2.4", True, False), ("9.9.9", "<0.0.0", False, False), ("1.0.0", ">=1.0.0 <2.0.0", True, True), ("2.0.0", ">=1.0.0 <2.0.0", False, False), ("1.0.0", "*", True, True),
])
def test_range_dialects(spark, version, wanted, loose, strict):
    one = spark.range(1)
    assert one.select(versions.in_range(F.lit(version), F.lit(wanted)), versions.in_range(F.lit(version), F.lit(wanted), semver=True)).first() == (loose, strict)


def test_levels_of_folders(spark, tmp_path):
    for k in range(4):
        (tmp_path / "/".join("abc"[:k])).mkdir(parents=True, exist_ok=True)
        (tmp_path / "/".join([*"abc"[:k], f"f{k}.js"])).write_text("x")
    found = sorted(r["file_path"] for r in files.source_files(spark, str(tmp_path), depth=2).collect())
    assert found == ["a/f1.js", "f0.js"]


def test_updates_of_several_batches(spark, tmp_path):
    from ferrule.plans import streams
    from ferrule.streaming import state

    table = tmp_path / "events.parquet"
    for k, ids in enumerate([[1, 2], [2, 3], [4]]):
        spark.createDataFrame([(10 * k + i, u, "ok") for i, u in enumerate(ids)], "event_id long, user_id long, kind string").coalesce(1).write.mode("append").parquet(str(table))
    stream = streams.stream_of(spark, str(tmp_path), "user_id", "kind", "event_id", files_per_batch=1)
    found = streams.written(spark, state.trust_updates(stream, "user_id", "kind", "event_id"), "update", "user_id")
    assert {r["user_id"]: r["trust"] for r in found.collect()} == {1: 0.8, 2: 0.9, 3: 0.8, 4: 0.8}


def test_advisory_json(spark):
    from ferrule.operators import advisories

    record = {"id": "CVE-1", "descriptions": [{"lang": "en", "value": "A flaw in axios before 1.0.0"}], "metrics": {"cvssMetricV30": [{"cvssData": {"baseScore": 7.5, "baseSeverity": "high"}}], "cvssMetricV2": [{"cvssData": {"baseScore": 1.0, "baseSeverity": "LOW"}}]}}
    found = advisories.cves(spark.createDataFrame([(json.dumps(record),), ("{broken",), (json.dumps({"id": "CVE-2"}),)], "value string")).orderBy("id").collect()
    assert [(r["id"], r["severity"], r["cvss_version"], r["base_score"]) for r in found] == [("CVE-1", "HIGH", "3.0", 7.5), ("CVE-2", "MEDIUM", None, None)]
    about = lambda text, name: spark.range(1).select(advisories.about_package(F.lit(text), F.array().cast(f"array<{advisories.MATCH}>"), F.lit(name))).first()[0]
    assert about("A flaw in axios", "axios") and not about("nothing of it", "axios")
    assert not about("uses glob to list", "glob") and about("the glob package is open", "glob")
    assert not about("Midnight Commander up to; npm commander", "commander") and not about("of package shiba with js-yaml", "js-yaml")


def test_required_text_is_in_every_match():
    import re

    for pattern, plain in {"idiot": "idiot", r"[a-z]+@[a-z.]+": "@", r"ab*c": "a", r"(?:x|y)eval\s*\(": "eval", r"a|b": "", r"\+[0-9]+ \(": " (", r"x{2}yz": "yz", r"ab+?c": "ab", r"\x41b": ""}.items():
        assert required_text(pattern) == plain
    every = [p for _, _, _, ps in fixed.RULES.values() for p in ps] + fixed.UTILITY + fixed.SERVER + fixed.TESTING + fixed.BLOCKCHAIN + fixed.SHADER + fixed.REACT
    samples = " ".join(every).replace("\\s*", "").replace("\\s+", " ").replace("\\", "")
    for pattern in every:
        for m in re.finditer(pattern, samples):
            assert required_text(pattern) in m[0]


def test_stores_keep_the_latest_values(spark):
    from ferrule.operators import store

    changes = spark.createDataFrame([("a", 1, "pending", None), ("a", 2, "running", "t"), ("a", 3, None, "u"), ("b", 1, None, None), (None, 4, "x", "y"), ("a", None, "z", "z"), ("a", 3, None, "t")], "k string, n int, status string, note string")
    assert sorted(map(tuple, store.current(changes, "k", "n", ["status", "note"]).collect())) == [("a", "running", "u"), ("b", None, None)]
    assert store.current(changes.limit(0), "k", "n", ["status"]).count() == 0


def test_scan_states_end_once(spark):
    from ferrule.operators import store

    rows = spark.createDataFrame([("a", "pending", 1), ("a", "running", 2), ("a", "failed", 3), ("a", "completed", 4), ("b", "pending", 5), ("c", "running", 6)], "k string, event string, n int").selectExpr("*", "timestamp_seconds(n) AS ts")
    assert {r.k: (r.status, r.completed_at is None) for r in store.scan_states(rows, "k", "event", "n", "ts").collect()} == {"a": ("failed", False), "b": ("pending", True), "c": ("running", True)}
    assert sorted((r.k, r.action) for r in store.scan_audit(rows, "k", "event", "n", "ts").collect()) == [("a", "scan.triggered"), ("c", "scan.triggered")]


def test_feedback_and_training_rows(spark):
    from ferrule.operators import store

    feedback = spark.createDataFrame([("a", "1"), ("", "0"), (None, "1"), ("b", "2"), ("b", None), ("c", "0")], "package string, label string")
    registry = spark.createDataFrame([("a", 5)], "package string, versions int")
    assert sorted(map(tuple, store.feedback_rows(feedback, registry).collect()), key=str) == [("a", 1, 5), ("c", 0, None)]
    rows = spark.createDataFrame([(1.0, None, 1), (1.0, None, 1), (2.0, None, 1), (None, 1.0, 1)], "x double, y double, label int")
    assert sorted(map(tuple, store.new_training_rows(rows.where("x = 2"), rows, ["x", "y"]).collect()), key=str) == [(1.0, None, 1), (None, 1.0, 1)]


def test_provider_blocks_hold_from_the_last_refusal(spark):
    from ferrule.operators import store

    calls = [("p", 0, "status 403"), ("p", 3599, "timeout"), ("p", 3600, None), ("p", 3700, "429"), ("p", 3705, "403 and 429"), ("p", 3710, "Too Many Requests"), ("p", 3717, None), ("q", 1, None)]
    rows = spark.createDataFrame([(p, i, t, e) for i, (p, t, e) in enumerate(calls)], "provider string, n int, t long, error string").selectExpr("*", "timestamp_seconds(t) AS ts")
    assert [r.blocked for r in store.provider_blocks(rows, "provider", "ts", "n", "error").orderBy("n").collect()] == [False, True, False, False, True, True, False, False]


def test_drift_of_scores_by_kind(spark):
    from ferrule.operators import store

    now = spark.createDataFrame([("a", 0.9)] * 3 + [("b", 0.5)], "kind string, score double")
    old = spark.createDataFrame([("a", 0.1), ("a", 0.9), ("c", 0.2)], "kind string, score double")
    assert {r.kind: (r.recent_count, r.train_count, r.ks, r.drifted) for r in store.score_drift(now, old, "kind", "score").collect()} == {"a": (3, 2, 0.5, True), "b": (1, 0, 0.0, False), "c": (0, 1, 0.0, False)}


def test_targets_and_options(spark):
    from ferrule.operators import validate

    targets = [None, "", ".", "a/b", "..", "../scans", "../scans2", "/srv/scans/../scans/x", "/etc", "a\0b", "../../../../srv/scans"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(targets)], "i int, t string")
    assert [r.x for r in rows.select("i", validate.inside_root(F.col("t"), "/srv/scans").alias("x")).orderBy("i").collect()] == [True, True, True, True, False, True, False, True, False, False, True]
    options = spark.createDataFrame([(None, None, None), (0.0, 1, "json"), (10.5, 17, "xml"), (-1.0, 0, "table")], "max_depth double, workers int, output string")
    assert [r.errors for r in validate.option_errors(options).collect()] == [[], [], ["max_depth", "workers", "output"], ["max_depth", "workers"]]


def test_cache_steps_hold_the_latest_keys():
    from ferrule.streaming.state import cache_steps

    held = {}
    assert cache_steps(held, [(0, "a"), (1, "b"), (2, "a"), (3, "c"), (4, "b"), (5, "c"), (20, "c"), (21, "c")], 10, 2) == [False, False, True, False, False, True, False, True]
    assert list(held) == ["b", "c"] and held["c"] == 20


def test_streamed_cache_is_a_plain_replay(spark):
    import pandas as pd

    from ferrule import catalog
    from ferrule.streaming.state import cache_steps

    data = "/root/testdata/sf0.001"
    found = {r.event_id: r.hit for r in catalog.queries()["stream_cache_hits"](spark, data).collect()}
    events = pd.read_parquet(f"{data}/events.parquet").sort_values(["ts", "event_id"])
    wanted = {}
    for _, part in events.groupby("event_type"):
        seconds = part.ts.astype("datetime64[us]").astype("int64") / 1e6
        wanted.update(zip(part.event_id, cache_steps({}, list(zip(seconds, part.user_id, strict=True)), 86_400.0, 20), strict=True))
    assert found == wanted and 0 < sum(wanted.values()) < len(wanted)


def test_trees_with_weights_calibration_and_reasons(spark):
    from ferrule.operators import learn

    rows = spark.range(400).selectExpr("id", "double(id % 10) AS a", "double(id % 7) AS b", "double(id % 10 >= 8 AND id % 7 > 0) AS label")
    weighted = learn.class_weights(rows, "label")
    sums = weighted.groupBy("label").sum("weight").collect()
    assert abs(sums[0][1] - sums[1][1]) < 1e-6 and weighted.columns == [*rows.columns, "weight"]
    model = learn.train_trees(weighted.where("id < 300"), ["a", "b"], "label", trees=3, depth=3, weight="weight")
    kept = model.transform(weighted.where("id >= 300"))
    sigmoid = learn.train_calibration(kept, "label")
    found = sigmoid.transform(learn.with_margin(kept)).selectExpr("label", "calibrated_prediction_ AS p").collect()
    assert sum(r.label == r.p for r in found) >= 95
    drive = learn.importances(model, ["a", "b"])
    assert abs(sum(drive.values()) - 1) < 1e-6
    said = rows.select(learn.reasons(drive, {"a": "large"}).alias("r")).first().r
    assert any(x == "a=0.00: large" for x in said)
    best = learn.search_trees(rows, ["a", "b"], "label", [1, 3], [2], folds=2)
    assert max(best.avgMetrics) >= 0.9


def test_gates_skip_without_positives(spark):
    from ferrule.operators import learn

    rows = spark.createDataFrame([(0, 0.0, None), (3, 0.2, 0.4), (3, 0.9, 0.9)], "positives int, precision double, auc double")
    found = learn.gates(rows, {"precision": 0.5, "auc": 0.6}).collect()
    assert [(r.failed, r.skipped) for r in found] == [([], ["precision"]), (["auc", "precision"], []), ([], [])]
