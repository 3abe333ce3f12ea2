"""Work that grows no faster than the tables: what the reviewer's third round found."""

import random

from pyspark.sql import functions as F

from ferrule import catalog
from ferrule.operators import advisories

SMALL = "/root/testdata/sf0.001"


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_first_threats_are_those_of_all_matches(spark):
    draw = random.Random(4)
    version = lambda: draw.choice([None, *(f"{a}.{b}.0" for a in (1, 2, 3) for b in range(6))])
    asked = spark.createDataFrame([(i, draw.choice([None, "p", "q", "r"]), version()) for i in range(60)], "ord long, name string, version string")
    ranges = lambda: draw.choice([None, [], ["<=1.3.0", "2.0.0 - 2.2.0"], [">=1.2.0 <3.0.0"], [">=3.4.0"]])
    feeds = spark.createDataFrame([(draw.choice(["snyk", "npm"]), draw.choice([None, "p", "q", "s"]), draw.choice([None, f"V{i % 25}"]), draw.choice(["LOW", "HIGH"]), ranges()) for i in range(80)], "provider string, package string, vulnerability string, severity string, ranges array<string>")
    every = advisories.feed_threats(advisories.feed_matches(asked, feeds)).groupBy("package", "vulnerability").agg(F.min(F.struct("ord", "severity")).alias("v"))
    first = advisories.first_threats(asked, feeds)
    assert first.columns == ["package", "type", "severity", "confidence", "vulnerability", "ord"]
    assert rows(first.select("package", "vulnerability", "ord", "severity")) == rows(every.select("package", "vulnerability", "v.ord", "v.severity"))


def test_merging_makes_no_match_of_all_pairs(spark, monkeypatch):
    def refuse(*a, **k):
        raise AssertionError("dependencies were joined to all their advisories")

    monkeypatch.setattr(advisories, "feed_matches", refuse)
    assert catalog.queries()["feed_threats_merged"](spark, SMALL).count() > 0


def test_schedules_touch_their_state_once_a_batch():
    """However many changes a key has, and what comes due is what the changes one by one give."""
    import pandas as pd

    from ferrule.streaming.processors import Schedule

    class Handle:
        def __init__(self):
            self.held, self.timers, self.calls = None, set(), 0

        def getValueState(self, *a):  # noqa: N802
            return self

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held, self.calls = value, self.calls + 1

        def clear(self):
            self.held, self.calls = None, self.calls + 1

        def registerTimer(self, at):  # noqa: N802
            self.timers.add(at)
            self.calls += 1

        def deleteTimer(self, at):  # noqa: N802
            self.timers.discard(at)
            self.calls += 1

    draw, handle = random.Random(3), Handle()
    schedule = Schedule()
    schedule.init(handle)
    wanted, held, first = [], None, 0
    for _ in range(5):
        changes = [(t, t, draw.choice([0, 7, 30, 90]), draw.random() < 0.6) for t in sorted(draw.sample(range(first, first + 3000), 300))]
        first += 3000
        found = [t for frame in schedule.handleInputRows(("a",), iter([pd.DataFrame(draw.sample(changes, 300), columns=["at_ms", "place", "every_ms", "enabled"])]), None) for t in frame["due"]]
        wanted = []
        for at, _, every, enabled in changes:
            while held and held[0] < at:
                wanted.append(held[0])
                held = (held[0] + held[1], held[1])
            held = (at + every, every) if enabled and every else None
        assert found == wanted
        assert handle.held == held and handle.timers == ({held[0]} if held else set())
    assert handle.calls <= 5 * 4


def test_hooks_keys_are_padded_once_a_hook(spark):
    """The join's own side has the padded keys, so no message pads one."""
    plan = catalog.queries()["webhook_messages"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "rpad(" in plan and "rpad(" not in plan[: plan.index("Join")]


def test_content_ids_turn_few_numbers(spark):
    import base64
    import hashlib

    from ferrule.operators import report

    texts = ["", "a", "é" * 50, *(f"text {i}" for i in range(200))]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", report.content_id(F.col("t")).alias("cid"))
    wanted = lambda t: "b" + base64.b32encode(bytes.fromhex("01551220") + hashlib.sha256(t.encode()).digest()).decode().rstrip("=").lower()
    assert {r["t"]: r["cid"] for r in found.collect()} == {t: wanted(t) for t in texts}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("conv(") <= 10 and "transform(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_plugins_get_bounded_batches(spark):
    """However many rows a partition has, a batch of texts holds a few megabytes."""
    import pandas as pd

    from ferrule.operators.plugins import run_plugin

    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(bound, None)
    spark.conf.unset(bound)
    files = spark.range(0, 60, 1, 1).select(F.col("id").alias("file_id"), F.repeat(F.lit("x" * 1000), F.lit(500)).alias("content"))
    try:
        run_plugin(files, lambda content, file_id: [])
        sizes = [r["n"] for r in files.mapInPandas(lambda parts: (pd.DataFrame({"n": [len(p)]}) for p in parts), "n long").collect()]
    finally:
        spark.conf.unset(bound) if before is None else spark.conf.set(bound, before)
    assert sum(sizes) == 60 and max(sizes) <= 8


def test_small_crowded_tables_go_through_passes(spark, monkeypatch):
    import numpy as np

    from llm import embeddings

    def refuse(*a, **k):
        raise AssertionError("all pairs were compared")

    monkeypatch.setattr(embeddings, "all_links", refuse)
    rng = np.random.default_rng(1)
    x = np.sqrt(0.7) * np.eye(32)[0] + np.sqrt(0.3) * rng.normal(size=(1500, 32)) / np.sqrt(32)
    frame = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r["n_links"] for r in embeddings.near_vectors(frame).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(1) - 1
    assert sum(found.values()) >= 0.99 * links.sum()


def test_articles_lose_what_their_neighbours_share_in_order():
    import numpy as np

    from llm import html_text

    def page(lines):
        n = len(lines)
        return {"lines": np.array(lines, "<u8"), "sizes": np.full(n, 10, "<u4"), "open": np.zeros(n, bool), "inside": np.ones(n, bool)}

    repeated = np.array([1, 2], np.uint64)
    own = page([1, 50, 51, 2])
    assert html_text.article_deletions(own, [page([1, 60, 61])], repeated).tolist() == [True, False, False, False]
    assert html_text.article_deletions(own, [page([1, 60]), page([70, 2])], repeated).tolist() == [True, False, False, True]
    assert not html_text.article_deletions(own, [page([1, 50, 51, 2, 9])], repeated).any()  # a near copy is no evidence
    assert not html_text.article_deletions(own, [page([60, 61])], repeated).any()  # nothing is shared, however often others repeat it


def test_caches_over_batches_without_a_whole_group(spark, tmp_path):
    """Batches end within a cache's reads; no Python call sees all reads of a cache, and a repeated batch changes nothing."""
    import pandas as pd

    from ferrule.streaming import state

    draw = random.Random(6)
    source, out, kind = str(tmp_path / "in"), str(tmp_path / "out"), "c string, k long, ts timestamp, n long"
    reads = [(draw.choice(["a", "b", None]), draw.choice([None, *range(8)]), i, i) for i in range(400)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for part in (reads[:150], reads[150:160], reads[160:]):
            spark.createDataFrame(draw.sample(part, len(part)), "c string, k long, s long, n long").select("c", "k", F.timestamp_seconds("s").alias("ts"), "n").write.mode("append").parquet(source)
            for _ in range(2):
                q, schema = state.replay(spark.readStream.schema(kind).parquet(source), out, "c", "k", "ts", "n", 60.0, 4)
                q.awaitTermination()
        commits = sorted((tmp_path / "out" / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
        (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
        commits[-1].unlink()  # the last batch ran, but the stream never learned of it
        q, schema = state.replay(spark.readStream.schema(kind).parquet(source), out, "c", "k", "ts", "n", 60.0, 4)
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    found = {r["n"]: r["hit"] for r in spark.read.schema(schema).parquet(f"{out}/data").where("hit IS NOT NULL").collect()}
    wanted = {}
    for c in ("a", "b", None):
        own = [(float(s), k, n) for o, k, s, n in reads if o == c]
        wanted.update(zip([n for *_, n in own], state.cache_steps({}, [(t, k) for t, k, _ in own], 60.0, 4), strict=True))
    assert found == wanted and pd.Series(list(found.values())).nunique() == 2


def test_scripts_are_spread_over_the_cores(spark):
    from ferrule.plans.detection import script_files

    assert script_files(spark, SMALL).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_merging_sorts_twice_whatever_the_rows(spark):
    """Each sort of a window holds a task's rows at once."""
    from ferrule.operators import relate

    kind = "package string, type string, severity string, confidence double, vulnerability string, ord long"
    draw = random.Random(9)
    some = lambda n, at: [(draw.choice([None, "p", "q", "r", "s"]), draw.choice(["SUSPICIOUS_DEPENDENCY", "MALICIOUS_CODE"]), draw.choice(["LOW", "MEDIUM", "HIGH"]), draw.random(), draw.choice([None, *"abcdefgh"]), at + i) for i in range(n)]
    known, found = some(12, 0), some(40, 100)
    merged = relate.merge_advisories(spark.createDataFrame(known, kind), spark.createDataFrame(found, kind), 3)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 2, plan
    rank = ["LOW", "MEDIUM", "HIGH"].index
    pairs = {(p, v) for p, *_, v, _ in known if p is not None and v is not None}
    fresh, seen = [], set()
    for row in found:
        if (row[0], row[4]) not in pairs | seen:
            seen.add((row[0], row[4]))
            fresh.append(row)
    wanted = []
    for row in known:
        firsts = [r for r in known if r[0] == row[0] is not None and r[1] == "SUSPICIOUS_DEPENDENCY"]
        if firsts and firsts[0] is row:
            severity, confidence = row[2], row[3]
            for other in (r for r in fresh if r[0] == row[0]):
                if rank(other[2]) > rank(severity):
                    severity, confidence = other[2], max(confidence, other[3])
            row = (*row[:2], severity, confidence, *row[4:])
        wanted.append(row)
    targets = {r[0] for r in known if r[1] == "SUSPICIOUS_DEPENDENCY" and r[0] is not None}
    wanted += [r for r in fresh if r[0] not in targets]
    assert rows(merged) == sorted(wanted, key=str)


def test_matches_of_one_package_are_spread(spark):
    """The advisories' splits don't say how many tasks make the matches, and each is still there with its nulls and repeats."""
    draw = random.Random(6)
    version = lambda: draw.choice([None, *(f"{a}.{b}.0" for a in (1, 2, 3) for b in range(4))])
    asked = spark.createDataFrame([(i % 150, draw.choice([None, "p", "p", "q"]), version()) for i in range(200)], "ord long, name string, version string")
    ranges = lambda: draw.choice([None, [], ["<=1.3.0", "2.0.0 - 2.2.0"], [">=1.2.0 <3.0.0"], [">=3.4.0", None]])
    feeds = spark.createDataFrame([(draw.choice(["snyk", "npm", None]), draw.choice([None, "p", "p", "s"]), f"V{i % 25}", ranges()) for i in range(60)], "provider string, package string, vulnerability string, ranges array<string>").coalesce(1)
    every = asked.join(feeds, F.col("name") == F.col("package")).where(advisories.in_ranges(F.col("version"), F.col("provider"), F.col("ranges"))).drop("package")
    found = advisories.feed_matches(asked, feeds)
    assert found.columns == every.columns and rows(found) == rows(every)
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 2


def test_a_task_scans_a_bounded_number_of_texts(spark, tmp_path, monkeypatch):
    """One row group is one task, into however many splits its file is cut."""
    from ferrule import session

    monkeypatch.setattr(session, "TASK_TEXTS", 50)
    spark.range(1000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text")).coalesce(1).write.parquet(str(tmp_path / "t"))
    spread = session.spread(spark.read.parquet(str(tmp_path / "t")))
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 1000 and len(sizes) >= 20 and max(sizes) <= 55


def test_imports_are_looked_for_behind_their_words(spark):
    from ferrule.functions.text import imports_any

    texts = ['import a from "three"', "import a from 'three'", "require('three')", 'require("three")', "from three", "require(three)", 'from "two"', 'from "two"; "three"', "", None]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", imports_any("t", ["three", "regl"]).alias("hit"))
    assert [r.hit for r in found.orderBy("i").collect()] == [True] * 4 + [False] * 6
