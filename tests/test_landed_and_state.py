"""Landed feeds, logs and archives, state with timers, webhooks, settings and constraints."""

import hashlib
import hmac
import io
import json
import shutil
import tarfile
from pathlib import Path

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from ferrule import settings
from ferrule.operators import advisories, learn, relate, samples, validate, windows
from ferrule.sinks import webhooks
from ferrule.sources import archives, community, landed
from ferrule.sources.files import commit_log
from ferrule.streaming import processors


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


# ---- landed feeds ----

def land(root: Path, provider: str, *lines: str, column: str = "provider") -> None:
    folder = root / f"{column}={provider}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{len(list(folder.iterdir()))}.json").write_text("\n".join(lines))


@pytest.mark.parametrize("text", ["a\nbb\n\nccc", "a\n", "\n\n\n", "", "one line without an end", "é\nü\n" * 50])
def test_every_line_is_in_one_stretch(tmp_path, text):
    (tmp_path / "f").write_bytes(text.encode())
    size = len(text.encode())
    for step in (1, 2, 3, 7, 1000):
        found = []
        for at in range(0, size, step):
            found += list(landed.lines_of(landed.Stretch("x", str(tmp_path / "f"), at, min(at + step, size)), fs.LocalFileSystem()))
        whole = text.encode().split(b"\n")
        assert found == (whole[:-1] if whole[-1] == b"" else whole)


def test_filters_choose_folders_and_lines(tmp_path):
    for provider in ("snyk", "npm", "other"):
        land(tmp_path, provider, "{}")
    reader = landed.LandedReader({"path": str(tmp_path)}, landed.ADVISORY, "provider", {"snyk": landed.snyk_rows, "npm": landed.npm_rows})
    assert {p.folder for p in reader.partitions()} == {"snyk", "npm", "other"}
    left = list(reader.pushFilters([In(("provider",), ("snyk", "npm")), EqualTo(("provider",), "npm"), GreaterThan(("score",), 1.0), EqualTo(("package",), "p")]))
    assert left == [GreaterThan(("score",), 1.0)]
    assert {p.folder for p in reader.partitions()} == {"npm"} and reader.packages == {"p"}


def test_both_feeds_in_one_table(spark, tmp_path):
    land(
        tmp_path, "snyk", json.dumps({"vulnerabilities": [{"id": "S1", "packageName": "p", "severity": "critical", "cveIds": [], "identifiers": {"CVE": ["CVE-9"]}, "semver": {"vulnerable": [">=2.0.0", "1.0.0 - 1.2.0"]}, "cvssScore": 0}]}),
        json.dumps({"issues": [{"id": "S2", "packageName": "q", "severity": "moderate", "identifiers": {"CVE": ["CVE-1", "CVE-2"]}, "semver": {"vulnerable": []}, "patched": ["3.0.0"], "cvssScore": 7.5}]}), "{broken", "[1]", "", json.dumps({"vulnerabilities": [None]}),
    )
    land(tmp_path, "npm", json.dumps({"results": [{"id": 7, "module_name": "p", "severity": "moderate", "vulnerable_versions": ">=1.0.0 <2.0.0", "patched_versions": "2.0.0, ,2.1.0", "overview": "", "recommendation": "r", "url": "u", "references": "a,\n b"}]}))
    found = {r["vulnerability"]: r for r in landed.landed(spark, landed.AdvisoryFeeds, str(tmp_path), split=50).collect()}
    assert set(found) == {"S1", "CVE-1", "npm-7"}
    assert (found["S1"]["severity"], found["S1"]["affected"], found["S1"]["score"], found["S1"]["provider"]) == ("CRITICAL", ">=2.0.0, 1.0.0 - 1.2.0", None, "snyk")
    assert (found["CVE-1"]["severity"], found["CVE-1"]["affected"], found["CVE-1"]["ranges"], found["CVE-1"]["score"], len(found["CVE-1"]["references"])) == ("MEDIUM", "unknown", [], 7.5, 3)
    assert (found["npm-7"]["severity"], found["npm-7"]["patched"], found["npm-7"]["references"], found["npm-7"]["description"]) == ("MEDIUM", ["2.0.0", "2.1.0"], ["u", "a", "b"], "r")
    feeds = landed.landed(spark, landed.AdvisoryFeeds, str(tmp_path))
    assert [r["vulnerability"] for r in feeds.where("package = 'q'").collect()] == ["CVE-1"] and feeds.where("provider = 'none'").count() == 0
    asked = spark.createDataFrame([(1, "p", "1.1.0"), (2, "p", "1.5.0"), (3, "p", "2.5.0"), (4, "q", "1.0.0"), (5, "p", None), (6, None, "1.0.0")], "ord long, name string, version string")
    hits = advisories.feed_matches(asked, feeds)
    assert rows(hits.select("ord", "vulnerability")) == [(1, "S1"), (1, "npm-7"), (2, "npm-7"), (3, "S1"), (5, "S1"), (5, "npm-7")]
    merged = relate.merge_advisories(advisories.feed_threats(hits).limit(0), advisories.feed_threats(hits))
    assert merged.count() == 2


def test_registries_in_order(spark, tmp_path):
    say = lambda name, created: json.dumps({"name": name, "time": {"created": created}, "versions": {"1.0.0": {}, "1.1.0": {}}, "dist-tags": {"latest": "1.1.0"}})
    land(tmp_path, "npm", say("a", None), say("b", "2021-01-02T00:00:00.000Z"), column="registry")
    land(tmp_path, "yarn", say("a", "2020-05-05T00:00:00.000Z"), say("b", "2019-01-01T00:00:00.000Z"), column="registry")
    land(tmp_path, "github", say("c", "2018-01-01T00:00:00.000Z"), say("@s/c", "2018-01-01T00:00:00.000Z"), column="registry")
    found = landed.landed(spark, landed.RegistryMetadata, str(tmp_path))
    assert {(r["registry"], r["package"]) for r in found.collect()} == {("npm", "a"), ("npm", "b"), ("yarn", "a"), ("yarn", "b"), ("github", "@s/c")}
    first = advisories.first_created(found, ["npm", "yarn", "github"])
    assert [(p, str(c)[:10], r) for p, c, r in rows(first)] == [("@s/c", "2018-01-01", "github"), ("a", "2020-05-05", "yarn"), ("b", "2021-01-02", "npm")]


def test_commits_span_lines(spark, tmp_path):
    one = "\x1erepo\x1fabc\x1fAnn\x1f2024-01-02T03:04:05+00:00\x1ffirst\n\nsecond line\n\x1f\n 3 files changed, 10 insertions(+), 1 deletion(-)\n"
    two = "\x1erepo\x1fdef\x1fBob\x1f2024-01-03T03:04:05+02:00\x1f\n\x1f\n5\t2\ta.js\n-\t-\tb.png\n1\t0\tc d.js\n"
    (tmp_path / "log").write_text((one + two) * 200 + "\x1ebroken\x1frecord")
    found = commit_log(spark, str(tmp_path))
    assert found.count() == 400
    assert rows(found.distinct().select("sha", "author", "message", "additions", "deletions")) == [("abc", "Ann", "first\n\nsecond line", 10, 1), ("def", "Bob", "", 6, 2)]


def test_package_documents(spark):
    lines = [
        {"name": "a", "readme": 7, "versions": {"1.0.0": {"description": "one"}, "2.0.0": {"description": "two", "repository": {"type": "git", "url": "git+https://github.com/o/r.git"}}}, "dist-tags": {"latest": "2.0.0"}},
        {"name": "b", "readme": "hello", "versions": {"1.0.0": {"repository": "https://github.com/o/s"}, "0.9.0": {"description": "last listed"}}, "repository": "o/top"},
        {"name": "c", "versions": {}}, {"name": "d"}, {"versions": {"1.0.0": {}}}, [1], "text",
    ]
    found = community.package_docs(spark.createDataFrame([(json.dumps(x),) for x in lines] + [("{broken",), (None,)], "value string"))
    assert rows(found) == [("a", "7", "two", "https://github.com/o/r"), ("b", "hello", "last listed", "o/top")]


def test_issues_downloads_and_stars(spark):
    items = [{"title": "Security hole", "labels": [{"name": "Security"}, {}]}, {"body": "b", "state": "closed"}, {"title": "third"}]
    lines = spark.createDataFrame([(json.dumps({"repository": "o/r", "issues": items}),), ("{",), (json.dumps({"repository": "o/none", "issues": []}),)], "value string")
    assert [tuple(r) for r in community.issues(lines, most=2).orderBy("place").collect()] == [("o/r", 0, "Security hole", None, "open", ["Security", ""]), ("o/r", 1, "", "b", "closed", [])]
    assert community.issue_evidence(community.issues(lines)).select("issues", "security_labels").collect()[0][:] == (3, 1)
    docs = spark.createDataFrame([("p", "x", "y", "https://github.com/o/r"), ("q", "", "", None), ("z", "", "", "https://github.com/o/other")], "package string, readme string, description string, repository_url string")
    number = lambda key, field, *pairs: community.number_of(spark.createDataFrame([(json.dumps({key: k, field: n}),) for k, n in pairs], "value string"), key, field)
    found = community.community(docs, number("package", "downloads", ("p", 999_999), ("q", "many")), number("full_name", "stargazers_count", ("o/r", 5000), ("o/other", None)))
    assert [(p, d, s, round(x, 6)) for p, _, d, s, x in rows(found)] == [("p", 999_999, 5000, 0.75), ("q", 0, None, 0.25), ("z", 0, None, 0.25)]
    merged = community.package_evidence(docs, community.issue_evidence(community.issues(lines)))
    assert {r["package"] for r in merged.collect()} == {"p", "q", "z"}


# ---- archives ----

def packed(*entries, link: bool = False) -> bytes:
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz") as archive:
        for name, content in entries:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            archive.addfile(info, io.BytesIO(content))
        if link:
            info = tarfile.TarInfo("package/link")
            info.type, info.linkname = tarfile.SYMTYPE, "/etc/passwd"
            archive.addfile(info)
    return raw.getvalue()


def test_archives_entry_by_entry(spark, tmp_path):
    good = packed(("package/a.js", b"eval(1)"), ("package/dir/b.js", b"y" * 100), ("/abs", b"x"), ("package/../../up", b"x"), ("package/big", b"z" * 5000), link=True)
    (tmp_path / "good.tgz").write_bytes(good)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "cut.tgz").write_bytes(good[: len(good) // 3])
    (tmp_path / "stored.tgz").write_bytes(np.random.default_rng(1).bytes(9000))
    found = archives.package_archives(spark, str(tmp_path), largest=1000, stored=8000)
    by_name = {r["entry"]: r for r in found.where("archive LIKE '%good%'").collect()}
    assert {k: r["problem"] for k, r in by_name.items()} == {"package/a.js": None, "package/dir/b.js": None, "/abs": "unsafe path", "package/../../up": "unsafe path", "package/big": "too large", "package/link": "link"}
    assert by_name["package/a.js"]["content"] == b"eval(1)" and by_name["package/big"]["size"] == 5000 and by_name["package/big"]["content"] is None
    others = {r["archive"].rsplit("/", 1)[1]: r["problem"] for r in found.where("archive NOT LIKE '%good%' AND problem IS NOT NULL").collect()}
    assert others["cut.tgz"].startswith("broken archive") and others["stored.tgz"] == "archive too large"
    assert rows(archives.archive_entries(spark.createDataFrame([("x", b""), ("y", None)], "path string, content binary")).select("archive", "problem")) == [("x", "broken archive: EOFError")]
    files = archives.package_files(found)
    assert [(p, c) for _, p, c in rows(files.where("file_path NOT LIKE '%b.js'"))] == [("a.js", "eval(1)")]
    assert {p for p, in rows(archives.archive_entries(spark.createDataFrame([("x", packed(("p/a", b"1" * 600), ("p/b", b"2" * 600)))], "path string, content binary"), total=1000).select("problem"))} == {None, "archive too large"}


def test_samples_by_position(spark):
    cases = {
        "return x; const ab = C1, cd = D2; and then a long tail that goes on and on and on until it is cut": "... const ab = C1, cd = D2; and then a long tail that goes on an...",
        "const ab = C1, cd = D2": "const ab = C1, cd = D2",
        "  \t[0x1, 0x2, 0x3, 4]": "... [0x1, 0x2, 0x3, 4]...",
        "module.exports = a; const b3=I": "module.exports = a; const b3=I",
        "nothing here": None,
    }
    files = spark.createDataFrame(list(enumerate(cases)) + [(9, None)], "id long, content string")
    found = {r["id"]: (r["sample_line"], r["sample_code"]) for r in samples.sampled(files).collect()}
    assert {i: found[i][1] for i in range(len(cases))} == dict(enumerate(cases.values())) and found[9] == (None, None) and found[0][0] == 1


# ---- state ----

def run(stream, path, mode, checkpoint):
    def step(batch, n):
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    query = stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def test_rings_over_batches(spark, tmp_path):
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    kind = "k string, place long, value string"
    for part in ([("a", i, f"v{i}") for i in range(10)] + [("b", 1, "x")], [("a", 9, "again"), ("a", 10, "v10"), ("a", 2, "old"), (None, 1, "x")]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(kind).parquet(source)
        with processors.with_rocksdb(spark):
            run(processors.ring(stream, "k", "place", "value", 3), out, "update", check)
    last = spark.read.parquet(out).groupBy("key").agg(F.max_by(F.struct("kept", "oldest", "newest", "last_value"), "batch").alias("r")).select("key", "r.*")
    assert rows(last) == [("a", 3, 8, 10, "v10"), ("b", 1, 1, 1, "x")]


def test_schedules_survive_a_restart(spark, tmp_path):
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    kind = "k string, at timestamp, place long, every long, on boolean"
    read = lambda: spark.readStream.schema(kind).parquet(source)
    parts = [[("a", 1000, 1, 600, True), ("b", 1060, 2, 3600, True), ("tick", 3000, 3, 0, False)], [("a", 3400, 4, 0, False), ("tick", 10_000, 5, 0, False)]]
    for part in parts:
        frame = spark.createDataFrame([(k, int(t), p, e, o) for k, t, p, e, o in part], "k string, t long, place long, every long, on boolean")
        frame.select("k", F.timestamp_seconds("t").alias("at"), "place", "every", "on").coalesce(1).write.mode("append").parquet(source)
        with processors.with_rocksdb(spark):
            run(processors.due_schedules(read(), "k", "at", "place", "every", "on"), out, "append", check)
    found = spark.read.parquet(out).select("key", F.unix_seconds("due").alias("due"))
    assert rows(found) == [("a", 1600), ("a", 2200), ("a", 2800), ("b", 4660), ("b", 8260)]


# ---- webhooks ----

def test_hmac_by_built_ins(spark):
    cases = [("", ""), ("key", "The quick brown fox"), ("s" * 64, "x"), ("long" * 40, "é\n{}")]
    found = spark.createDataFrame(cases, "k string, m string").select(webhooks.hmac_sha256(F.col("m"), F.col("k"))).collect()
    assert [r[0] for r in found] == [hmac.new(k.encode(), m.encode(), hashlib.sha256).hexdigest() for k, m in cases]


def test_a_repeated_batch_is_sent_once(spark, tmp_path):
    source, ledger, check, outbox = (str(tmp_path / x) for x in ("in", "ledger", "check", "outbox"))
    Path(outbox).mkdir()
    kind = "event_id long, org long, event string, payload string, at timestamp"
    hooks = spark.createDataFrame([(1, 1, "u1", "s", ["scan", "scan"], True), (2, 1, "u2", "s", ["scan"], False), (3, 2, "u3", "s", ["scan"], True)], "hook_id long, org long, url string, secret string, events array<string>, enabled boolean")
    spark.createDataFrame([(7, 1, "scan", '{"a": 1}'), (8, 1, "other", "{}"), (9, None, "scan", "{}")], "event_id long, org long, event string, payload string").withColumn("at", F.timestamp_seconds(F.lit(0))).write.parquet(source)

    def send(messages):
        for m in messages:
            with open(f"{outbox}/{m['delivery_id']}", "a") as file:
                file.write(m["body"] + "\n" + m["signature"] + "\n")

    def start():
        webhooks.deliver(spark.readStream.schema(kind).parquet(source), hooks, send, ledger, check).awaitTermination()

    start()
    shutil.rmtree(f"{check}/commits")  # the batch ran, but the stream never learned of it
    start()
    sent = [p.read_text().splitlines() for p in Path(outbox).iterdir()]
    body = '{"event":"scan","payload":{"a": 1},"timestamp":"1970-01-01T00:00:00.000Z"}'
    assert sent == [[body, hmac.new(b"s", body.encode(), hashlib.sha256).hexdigest()]] and json.loads(body)["payload"] == {"a": 1}


# ---- settings ----

def test_overlays_and_environment():
    base = {"cache": {"ttl": 300, "layers": {"l2": {"enabled": False}}}, "order": ["a"], "flat": 1}
    merged = settings.overlaid(base, {"cache": {"layers": {"l2": {"enabled": True}}}, "order": ["b"], "flat": {"x": 1}}, None, {"new": None})
    assert merged == {"cache": {"ttl": 300, "layers": {"l2": {"enabled": True}}}, "order": ["b"], "flat": {"x": 1}, "new": None} and base["cache"]["layers"]["l2"]["enabled"] is False
    known = {"TTL": (("cache", "ttl"), settings.whole_number(1)), "WORKERS": (("workers",), settings.whole_number(1, 32)), "L2": (("cache", "layers", "l2", "enabled"), settings.flag)}
    read = settings.from_environment(base, {"TTL": "60s", "WORKERS": "33", "L2": "TRUE", "OTHER": "1"}, known)
    assert read == {"cache": {"ttl": 60, "layers": {"l2": {"enabled": True}}}, "order": ["a"], "flat": 1}
    assert settings.from_environment(base, {"TTL": "x", "WORKERS": "-4", "L2": ""}, known) == base
    assert settings.registry_order(["npm", "yarn"], [{"name": "own"}, {"name": "npm"}, {"url": "x"}]) == ["npm", "yarn", "own"]


def test_rule_sets_are_values(spark):
    first = settings.RuleSet.parsed('{"r": {"severity": "HIGH", "patterns": ["evil"]}, "s": {"patterns": ["("]}}')
    second = first.with_rule("t", "LOW", "", 0.5, ["x+"]).without("s")
    assert first.names == ["r", "s"] and second.names == ["r", "t"] and second.get("s") is None
    assert first.problems(spark) == ["s: pattern ("] and second.problems(spark) == []
    with pytest.raises(TypeError):
        first.rules["u"] = None
    files = spark.createDataFrame([(1, "evil xx")], "file_id long, content string")
    assert {r["rule"] for r in second.merged(settings.RuleSet.of({"t": ("HIGH", "", 0.5, ["no"])})).apply(files).collect()} == {"r"}


def test_providers_are_functions(spark):
    one = settings.Provider("one", lambda s, own: s.createDataFrame([("p", own["level"])], "package string, severity string"), {"level": "LOW"})
    two = settings.Provider("two", lambda s, own: s.createDataFrame([("q",)], "package string"))
    both = settings.Providers().with_provider(one).with_provider(two).with_provider(one)
    assert both.names == ["two", "one"]
    assert rows(both.advisories(spark, {"one": {"level": "HIGH"}}).select("package", "severity", "provider")) == [("p", "HIGH", "one"), ("q", None, "two")]
    assert both.advisories(spark, {"two": {"enabled": False}}).count() == 1
    with pytest.raises(ValueError):
        settings.Providers().advisories(spark)


# ---- constraints, splits, scores ----

def test_constraints_from_a_table(spark):
    table = spark.createDataFrame([("name", True, "string", 2, None, "^a", None), ("kind", False, None, None, 3, None, ["x", "y"]), ("gone", True, None, None, None, None, None)], "field string, required boolean, type string, min_length int, max_length int, pattern string, allowed array<string>")
    given = spark.createDataFrame([(1, "ab", "x"), (2, "", None), (3, "b", "long"), (4, None, "z"), (5, "bb", "y")], "id long, name string, kind string")
    found = {r["id"]: [e.split("'")[1] + e.split("'")[2] for e in r["errors"]] for r in validate.validated(given, validate.constraints_from(table)).collect()}
    assert found == {
        1: ["gone is required"], 2: ["name is required", "gone is required"], 3: ["name must be at least 2 characters long", "kind must be no more than 3 characters long", "gone is required"],
        4: ["name is required", "kind must be one of: x, y", "gone is required"], 5: ["name does not match required pattern", "gone is required"],
    }
    with pytest.raises(ValueError):
        validate.constraints_from(table, most=2)
    assert validate.validated(given, []).where("size(errors) > 0").count() == 0


def test_name_readings(spark):
    names = ["ok-name", "a", "@s/n", "@scope/name", "@scope/", "../x", "a;b", "a..b", None, "x" * 215, "my/path", "virus-kit"]
    found = spark.createDataFrame([(n,) for n in names], "n string").select(validate.registry_name_error(F.col("n")), validate.safe_package_name(F.col("n")), validate.input_name_error(F.col("n"))).collect()
    assert [r[0] for r in found] == [None, "characters", "characters", "characters", "characters", "characters", "characters", "dots", "empty", "too long", "characters", None]
    assert [r[1] for r in found] == [True, False, False, True, False, False, False, True, False, True, False, True]
    assert [r[2] for r in found] == [None, None, "format", "format", "format", None, "format", None, "empty", None, None, "suspicious"]


@pytest.mark.parametrize("counts", [(7, 3), (3, 7), (5, 5), (1, 100)])
def test_oversampling_reaches_parity(spark, counts):
    given = spark.createDataFrame([(f"{y}-{i}", y) for y, n in enumerate(counts) for i in range(n)], "k string, y int")
    found = learn.oversample(given, "y", "k")
    per = {r["k"]: r["count"] for r in found.groupBy("k").count().collect()}
    assert sorted(r["count"] for r in found.groupBy("y").count().collect()) == [max(counts)] * 2
    assert len(per) == sum(counts) and max(per.values()) - min(v for k, v in per.items() if k[0] == str(int(counts[1] < counts[0]))) <= 1 + max(counts) // min(counts)


def test_running_sums_and_stepped_distance(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 40, 300) / 10, rng.integers(5, 60, 200) / 10
    per = spark.createDataFrame([(float(v), int(c)) for v, c in zip(*np.unique(a, return_counts=True), strict=True)], "v double, c long")
    found = {r["v"]: r["c_before_"] for r in windows.running_sums(per, "v", ["c"], buckets=8).collect()}
    assert found == {float(v): int((a < v).sum()) for v in np.unique(a)}
    i = j = 0
    far, x, y = 0.0, sorted(a), sorted(b)
    while i < len(x) and j < len(y):
        if x[i] <= y[j]:
            i += 1
        else:
            j += 1
        far = max(far, abs(i / len(x) - j / len(y)))
    both = spark.createDataFrame([(float(v), False) for v in a] + [(float(v), True) for v in b] + [(None, True)], "v double, now boolean")
    assert learn.ks_statistic(both, "v", "now", stepped=True).first()["ks"] == round(far, 6)


def test_newest_falls_back_to_strata(spark):
    given = spark.createDataFrame([(i, i, int(i < 10)) for i in range(40)], "k long, t long, y int").withColumn("ts", F.timestamp_seconds("t"))
    split = learn.newest_or_stratified(given, "ts", "y", "k", 0.25)
    assert rows(split.where("validation").groupBy("y").count()) == [(0, 7), (1, 2)]
    mixed = given.withColumn("y", (F.col("k") % 2).cast("int"))
    assert {r["k"] for r in learn.newest_or_stratified(mixed, "ts", "y", "k", 0.25).where("validation").collect()} == set(range(30, 40))


def test_batches_are_bounded(spark):
    def make():
        def predict(batch):
            assert batch.shape[0] <= 10 and batch.shape[1] == 2
            return batch[:, 0] * 0.5 + batch[:, 1]

        return predict

    given = spark.createDataFrame([(i, None if i % 3 == 0 else i / 100, 0.1) for i in range(95)], "id long, a double, b double")
    found = {r["id"]: r["s"] for r in given.select("id", learn.batch_scores(make, ["a", "b"], batch=10).alias("s")).collect()}
    assert found == {i: pytest.approx(min(1.0, (0 if i % 3 == 0 else i / 100) * 0.5 + 0.1)) for i in range(95)}
