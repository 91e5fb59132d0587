"""File sources of units: CSV folders with onset side files, interval labels, labelled CSV with junk headers; and sinks."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fault suffixes of unit folders, and metric suffixes of the restricted system.
FAULTS = ("cpu", "mem", "disk", "delay", "loss")
METRICS = ("cpu", "mem", "diskio", "socket", "workload", "error")


def fault_units(spark: SparkSession, root: str, metrics: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Folders {service}_{fault}/{rep} with data.csv and inject_time.txt (files, or folders of part files) as observations (unit, service, fault, time, name, x) and
    onsets (unit, onset). Time columns, columns named like addresses and repeats of a name are left out; metrics, if given,
    names the suffixes that stay."""
    path, fault, rep = (F.regexp_extract(F.input_file_name(), rf"/([^/]+?)_({'|'.join(FAULTS)})/([^/]+)/(?:data\.csv|inject_time\.txt)", k) for k in (1, 2, 3))
    raw = spark.read.text(f"{root}/*/*/data.csv").withColumns({"service": path, "fault": fault, "rep": rep})
    raw = raw.where("service <> ''").withColumn("unit", F.concat_ws("_", "service", "fault", "rep"))
    # Each file has a header of its own: it is a row that starts with the name of the time column.
    cells = F.split("value", ",")
    is_head = F.lower(F.col("value")).startswith("time")
    heads = raw.where(is_head).select("unit", F.transform(cells, lambda c: F.trim(F.regexp_replace(c, '"', ""))).alias("names")).distinct()
    rows = raw.where(~is_head & (F.trim("value") != "")).select("unit", "service", "fault", cells.alias("cells"))
    long = rows.join(heads, "unit").select(
        "unit", "service", "fault", F.get("cells", F.lit(0)).cast("double").alias("time"), F.posexplode(F.arrays_zip("names", F.col("cells").alias("cells"))).alias("at", "c"), "names"
    )
    first = F.array_position("names", F.col("c.names")) == F.col("at") + 1
    keep = ~F.lower(F.col("c.names")).startswith("time") & ~F.rlike(F.col("c.names"), F.lit(r"^\d+\.\d+\.\d+\.\d+")) & first
    if metrics:
        keep &= F.substring_index(F.col("c.names"), "_", -1).isin(*metrics)
    observations = long.where(keep).select("unit", "service", "fault", "time", F.col("c.names").alias("name"), F.expr("try_cast(c.cells as double)").alias("x"))
    side = spark.read.text(f"{root}/*/*/inject_time.txt", wholetext=True).withColumns({"service": path, "fault": fault, "rep": rep})
    onsets = side.select(F.concat_ws("_", "service", "fault", "rep").alias("unit"), F.trim("value").cast("double").alias("onset"))
    return observations, onsets


def service_roots(observations: DataFrame) -> DataFrame:
    """(unit, roots): names whose part before the last underscore is the injected service."""
    of = F.regexp_replace("name", "_[^_]*$", "") == F.col("service")
    return observations.select("unit", "service", "name").distinct().where(of).groupBy("unit").agg(F.array_sort(F.collect_set("name")).alias("roots"))


def without_constants(observations: DataFrame, onsets: DataFrame, least: float = 1e-9, missing: float = 0.99) -> DataFrame:
    """Only variables that vary before the onset and are seldom missing."""
    before = observations.join(onsets, "unit").where("time < onset")
    ok = before.groupBy("unit", "name").agg(F.stddev_pop("x").alias("s"), F.avg(F.col("x").isNull().cast("int")).alias("gone"))
    return observations.join(ok.where((F.col("s") > least) & (F.col("gone") <= missing)).select("unit", "name"), ["unit", "name"], "left_semi")


def interval_marks(spark: SparkSession, path: str, unit: str = r"([^/]+?)(\.[^./]*)?$") -> DataFrame:
    """Lines start-end:dim,dim (inclusive, dims from 1) as rows (unit, t, var) with var from 0. unit: a pattern whose first group is
    the unit in a file's path; the file's name if not given."""
    lines = spark.read.text(path).withColumn("unit", F.regexp_extract(F.input_file_name(), unit, 1))
    m = r"^\s*(\d+)\s*-\s*(\d+)\s*:\s*([\d,\s]+)$"
    parts = lines.where(F.rlike("value", F.lit(m))).select("unit", *[F.regexp_extract("value", m, k).alias(n) for k, n in ((1, "a"), (2, "b"), (3, "dims"))])
    rows = parts.select("unit", F.explode(F.sequence(F.col("a").cast("long"), F.col("b").cast("long"))).alias("t"), "dims")
    dims = rows.select("unit", "t", F.explode(F.split(F.regexp_replace("dims", r"\s", ""), ",")).alias("d"))
    return dims.select("unit", "t", (F.expr("try_cast(d as int)") - 1).alias("var")).where("var >= 0").distinct()


def labelled_csv(spark: SparkSession, path: str, label: str = "Attack LABLE", skip: int = 1, meta: int = 3) -> DataFrame:
    """A CSV whose first `skip` lines are junk: (row, name, x, attack). The column that contains `label` is -1 under attack; the
    first `meta` columns are no variables. Rows count on from 0 over all parts of the file."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start").withColumn("n", F.monotonically_increasing_id())
    place = ["file_path", "file_block_start"]
    header = lines.orderBy(*place, "n").limit(skip + 1).collect()[skip]
    names = [c.strip().strip('"').strip() for c in header.value.split(",")]
    at = next(k for k, c in enumerate(names) if label in c)
    cells = F.split("value", ",")
    junk = (F.col("file_path") == header.file_path) & (F.col("file_block_start") == header.file_block_start) & (F.col("n") <= header.n)
    rows = lines.where(~junk).where(F.trim("value") != "")
    attack = F.get(cells, F.lit(at)).cast("double") == -1
    kept = [(k, c) for k, c in enumerate(names) if k >= meta and k != at]
    values = F.array(*[F.struct(F.lit(c).alias("name"), F.expr(f"try_cast(split(value, ',')[{k}] as double)").alias("x")) for k, c in kept])
    # The number within a block of a file, and how many rows the blocks before have: one number a block.
    sizes = rows.groupBy(*place).agg(F.count("*").alias("rows"))
    before = Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*place, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("skipped"))
    within = F.row_number().over(Window.partitionBy(*place).orderBy("n")) - 1
    numbered = rows.join(F.broadcast(sizes), place).withColumn("row", F.col("skipped") + within)
    return numbered.select("row", attack.alias("attack"), F.explode(values).alias("v")).select("row", "attack", "v.name", "v.x")


def sampled(rows: DataFrame, order: str, most: int) -> DataFrame:
    """Every max(1, n // most)-th row in order: systematic sampling of a long table."""
    n = rows.count()
    return rows.where(F.col(order) % max(1, n // most) == 0)


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records that write_json wrote, or a file with one JSON array."""
    return spark.read.schema(schema).json(path)


def aligned(parts: list[DataFrame]) -> DataFrame:
    """Union by name, missing columns as null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


class StagedTable:
    """A table of units (groups of keys) that any number of runs add to, each unit once.

    A run writes what is missing aside and publishes it by one rename of a small file to the next number, which fails if another
    run took the number; the run then reads what was published meanwhile and drops those units from its own. So a run that stops
    before the rename leaves nothing that is read, and two runs at once never double a unit.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path, keys
        jvm = spark._jvm
        self.hadoop = jvm.org.apache.hadoop
        self.files = self.hadoop.fs.FileContext.getFileContext(jvm.java.net.URI.create(self.at("").toUri().toString()), spark._jsc.hadoopConfiguration())
        self.system = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def published(self) -> list[str]:
        """Names of the published parts, in order."""
        if not self.system.exists(self.at("_published")):
            return []
        out = []
        for number in sorted(s.getPath().getName() for s in self.system.listStatus(self.at("_published"))):
            stream = self.system.open(self.at(f"_published/{number}"))
            try:
                out.append(stream.readUTF())
            finally:
                stream.close()
        return out

    def read(self) -> DataFrame | None:
        parts = self.published()
        return self.spark.read.parquet(*[f"{self.path}/{p}" for p in parts]) if parts else None

    def missing(self, df: DataFrame) -> DataFrame:
        there = self.read()
        return df if there is None else df.join(there.select(*self.keys).distinct(), self.keys, "left_anti")

    def stage(self, df: DataFrame) -> tuple[str, int]:
        """Write what is missing aside: the part's name, and how many parts were published then."""
        seen, name = len(self.published()), f"part-{uuid.uuid4().hex}"
        self.missing(df).write.parquet(f"{self.path}/{name}")
        return name, seen

    def publish(self, name: str, seen: int) -> str:
        """Make a staged part count. If others came first, what they have is dropped from it."""
        while True:
            if len(self.published()) > seen:
                part = self.spark.read.parquet(f"{self.path}/{name}")
                name, seen = self.stage(part)
                continue
            draft = self.at(f"_drafts/{name}")
            out = self.system.create(draft, True)
            out.writeUTF(name)
            out.close()
            none = self.spark.sparkContext._gateway.new_array(self.hadoop.fs.Options.Rename, 0)
            self.system.mkdirs(self.at("_published"))
            try:
                self.files.rename(draft, self.at(f"_published/{seen:010d}"), none)
                return name
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in str(e.java_exception):
                    raise

    def add(self, df: DataFrame) -> None:
        self.publish(*self.stage(df))


def write_missing(df: DataFrame, path: str, keys: list[str]) -> int:
    """Add the groups that the staged table at path lacks; returns how many groups were there. A job that stopped resumes so."""
    table = StagedTable(df.sparkSession, path, keys)
    there = table.read()
    done = 0 if there is None else there.select(*keys).distinct().count()
    table.add(df)
    return done


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def log_run(spark: SparkSession, path: str, name: str, status: str, seconds: float) -> None:
    spark.createDataFrame([(name, status, seconds)], "name string, status string, seconds double").coalesce(1).write.mode("append").json(path)
