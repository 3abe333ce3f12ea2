"""Files, manifests, lines and histories as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- Fixed values: scannable suffixes and folders that are left out. ----
SUFFIXES = ("js", "ts", "jsx", "tsx")
SKIPPED = ["node_modules", ".git", "dist", "build", "coverage", ".next", ".nuxt", "out", ".cache", "tmp", "temp"]

THREAT = T.StructType([
    T.StructField(n, t) for n, t in [
        ("scan_id", T.StringType()), ("type", T.StringType()), ("message", T.StringType()), ("package", T.StringType()), ("file_path", T.StringType()), ("filename", T.StringType()),
        ("severity", T.StringType()), ("details", T.StringType()), ("line_number", T.IntegerType()), ("sample_code", T.StringType()), ("confidence", T.DoubleType()), ("metadata", T.StringType()),
    ]
])
TRAINING = T.StructType([T.StructField("features", T.MapType(T.StringType(), T.DoubleType())), T.StructField("label", T.IntegerType()), T.StructField("exportedAt", T.StringType())])


def ignore_patterns(lines: DataFrame) -> DataFrame:
    """Patterns of an ignore file (S3): comments cut off, blank and absolute ones dropped."""
    p = F.trim(F.regexp_replace("value", "#.*$", ""))
    return lines.select(p.alias("pattern")).where((F.col("pattern") != "") & ~F.col("pattern").startswith("/"))


def source_files(spark: SparkSession, root: str, depth: int = 5, ignored: list[str] | None = None) -> DataFrame:
    """(file_path, content, length) of scannable files in the ``depth`` levels of folders from the root on, which is the first (S1, S4); unreadable ones are left out."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}")
        .option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(root)
    )
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + root.rstrip("/").replace(".", r"\.") + "/", "")
    parts = F.split("file_path", "/")
    skipped = SKIPPED + list(ignored or [])
    found = files.select(relative.alias("file_path"), "length", F.decode("content", "UTF-8").alias("content"))
    return found.where((F.size(parts) <= depth) & ~F.exists(parts, lambda x: x.isin(skipped)))


def manifests(spark: SparkSession, root: str, depth: int = 5, most: int = 50) -> DataFrame:
    """(dir, json) of the first ``most`` manifests in path order (S2, S5): the cap is the operator; broken JSON gives null."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "package.json").option("wholetext", True).text(root).select("value", F.col("_metadata.file_path").alias("path"))
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + root.rstrip("/").replace(".", r"\.") + "/?", "")
    rows = files.select(F.regexp_replace(relative, "/?package\\.json$", "").alias("dir"), F.to_json(F.try_parse_json("value")).alias("json"))
    return rows.where((F.size(F.split("dir", "/")) <= depth) & ~F.exists(F.split("dir", "/"), lambda x: x.isin(SKIPPED))).orderBy("dir").limit(most)


def dependencies(rows: DataFrame) -> DataFrame:
    """(dir, name, version) of dependencies and development dependencies, the latter winning."""
    one = lambda key: F.coalesce(F.from_json(F.get_json_object("json", f"$.{key}"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    first, second = one("dependencies"), one("devDependencies")
    merged = F.map_concat(F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(second), k)), second)
    return rows.select("dir", F.explode(merged).alias("name", "version"))


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; malformed ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Scan history, one JSON file per scan (S22), newest first."""
    schema = "scanId string, timestamp string, target string, severityCounts map<string,long>, threatTypes array<string>"
    return spark.read.schema(schema).option("multiLine", True).json(path).orderBy(F.desc("timestamp"))


def latest_version(meta: DataFrame, tags: str, versions: str, wanted: str) -> DataFrame:
    """The version a request resolves to (S8): tag, exact, else the last in code-point order."""
    exact = F.when(F.array_contains(F.map_keys(versions), F.col(wanted)), F.col(wanted))
    return meta.withColumn("resolved", F.coalesce(F.try_element_at(tags, F.coalesce(wanted, F.lit("latest"))), exact, F.array_max(F.map_keys(versions))))


def package_spec(spec: str):
    """(name, version) of ``name[@version]``."""
    name = F.regexp_extract(spec, r"^(@[^/@]+/[^@]+|[^@]+)", 1)
    version = F.regexp_extract(spec, r"^(?:@[^/@]+/[^@]+|[^@]+)@(.+)$", 1)
    return F.struct(name.alias("name"), F.nullif(version, F.lit("")).alias("version"))


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """(repo, sha, author, ts, message, additions, deletions) of landed logs.

    A log is what ``git log --format='%x1e<repository>%x1f%H%x1f%an%x1f%cI%x1f%B%x1f' --shortstat`` (or ``--numstat``) prints.
    Records span lines; Spark splits the files at byte ranges and begins each record at its separator.  Records with fewer
    fields are left out; binary files count no lines.
    """
    fields = F.split("value", "\x1f", 6)
    log = spark.read.option("lineSep", "\x1e").text(path).where(F.size(fields) == 6)
    tail = fields[5]
    counted = lambda pattern: F.aggregate(F.regexp_extract_all(tail, F.lit(pattern), F.lit(1)), F.lit(0).cast("long"), lambda n, x: n + x.cast("long"))
    return log.select(
        fields[0].alias("repo"), fields[1].alias("sha"), fields[2].alias("author"), F.to_timestamp(fields[3]).alias("ts"), F.regexp_replace(fields[4], r"^\s+|\s+$", "").alias("message"),
        (counted(r"(\d+) insertions?\(\+\)") + counted(r"(?m)^(\d+)\t\d+\t")).alias("additions"), (counted(r"(\d+) deletions?\(-\)") + counted(r"(?m)^\d+\t(\d+)\t")).alias("deletions"),
    )
