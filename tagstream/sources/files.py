"""File sources and sinks (S5–S12): sparse ARFF datasets, result files, learner configs, melted
CSV.  Every reader is a distributed ``spark.read`` over a directory; file names come from the
``_metadata`` column, never from a driver-side listing loop."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagstream.functions.scalar import TS_TEXT_FORMAT, digits_label, part_int, ts_text

# Result-file attribute layout (position, name, type).
RESULT_ATTRIBUTES = (
    ("QuestionId", "numeric"),
    ("CreatedOn", "date"),
    ("Fmeasure", "numeric"),
    ("TopkFmeasure", "numeric"),
    ("IsTest", "{0,1}"),
    ("IsPrequential", "{0,1}"),
)
RESULT_SCHEMA = ("question_id long, created_on string, fmeasure double, topk_fmeasure double, "
                 "is_test string, is_prequential string")

#: Tasks a core that read learner configs, at most.
CONFIG_TASKS = 4


def _lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    r = spark.read
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.text(path).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"),
        F.monotonically_increasing_id().alias("_line"), F.col("value").alias("line"))


def read_sparse_arff(spark: SparkSession, path: str, glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(header, rows) of sparse ARFF files.

    header: (file_name, attr_index, name, type) — attribute lines numbered in file order (line ids
    grow with the file offset inside a file, and the header is small).
    rows:   (file_name, question_id, attr_index, val) — entries ``{i v, j w}``; the id is the value
    of attribute 0, 0 when the sparse row omits it.  An instance that holds only its id is one row
    with null attr_index and val.
    """
    lines = _lines(spark, path, glob)
    attr = lines.filter(F.lower(F.trim("line")).startswith("@attribute"))
    m = F.regexp_extract(F.trim("line"), r"(?i)^@attribute\s+('[^']*'|\S+)\s+(.+)$", 1)
    t = F.regexp_extract(F.trim("line"), r"(?i)^@attribute\s+('[^']*'|\S+)\s+(.+)$", 2)
    header = attr.select(
        "file_name",
        (F.row_number().over(Window.partitionBy("file_name").orderBy("_line")) - 1).cast("int").alias("attr_index"),
        F.regexp_replace(m, "^'|'$", "").alias("name"), F.trim(t).alias("type"))
    data = lines.filter(F.trim("line").startswith("{")).withColumn("_row", F.col("_line"))
    pairs = data.select("file_name", "_row", F.explode(F.regexp_extract_all(
        F.col("line"), F.lit(r"(\d+)\s+([^,}\s]+)"), F.lit(0))).alias("_p"))
    kv = pairs.select("file_name", "_row",
                      F.split(F.trim("_p"), r"\s+")[0].cast("int").alias("attr_index"),
                      F.split(F.trim("_p"), r"\s+")[1].alias("_v"))
    ids = kv.filter(F.col("attr_index") == 0).select("file_name", "_row", F.col("_v").cast("long").alias("question_id"))
    rows = (data.select("file_name", "_row").join(ids, ["file_name", "_row"], "left")
            .join(kv.filter(F.col("attr_index") != 0), ["file_name", "_row"], "left")
            .select("file_name", F.coalesce("question_id", F.lit(0)).alias("question_id"), "attr_index",
                    F.col("_v").cast("double").alias("val")))
    return header, rows


def _result_lines(spark: SparkSession, path: str, glob: str | None, name_text: str | None, after_pos: int) -> DataFrame:
    """file_name, line, r (the parsed row) and wrong (the line if it has no such row) of result files."""
    lines = _lines(spark, path, glob)
    if name_text is not None:
        lines = lines.filter(F.instr("file_name", name_text) > after_pos)
    body = lines.filter(~F.trim("line").startswith("@") & (F.length(F.trim("line")) > 0)
                        & ~F.trim("line").startswith("%"))
    return body.select("file_name", "line", F.from_csv(F.col("line"), RESULT_SCHEMA + ", wrong string",
                                                       {"quote": "'", "ignoreLeadingWhiteSpace": "true", "columnNameOfCorruptRecord": "wrong"}).alias("r"))


def read_results(spark: SparkSession, path: str, glob: str | None = "*.arff", name_text: str | None = None,
                 after_pos: int = 1) -> DataFrame:
    """Dense result rows of every file under ``path`` (``@`` header lines and blank lines
    dropped), with the file name; ``name_text`` keeps files whose name contains it at a 1-based
    position > ``after_pos``.  Lines that are no such row are left out; ``malformed_results`` has them."""
    rows = _result_lines(spark, path, glob, name_text, after_pos).filter("r.wrong is null")
    return rows.select("file_name", "r.*").drop("wrong").withColumn(
        "created_on", F.to_timestamp_ntz(F.col("created_on"), F.lit(TS_TEXT_FORMAT)))


def malformed_results(spark: SparkSession, path: str, glob: str | None = "*.arff", name_text: str | None = None,
                      after_pos: int = 1) -> DataFrame:
    """file_name and line of every line that is no result row, for a report."""
    return _result_lines(spark, path, glob, name_text, after_pos).filter("r.wrong is not null").select("file_name", "line")


def with_file_learner(df: DataFrame, rule: str = "stem", sep: str = "-", part: int = 2) -> DataFrame:
    """Learner id / parameter from the file name: ``stem`` (extension removed), ``part``
    (the n-th ``sep`` part as int) or ``digits`` (letters and dots removed)."""
    stem = F.regexp_replace(F.col("file_name"), r"\.[^.]*$", "")
    if rule == "stem":
        v: Column = stem
    elif rule == "part":
        v = part_int(stem, sep, part)
    elif rule == "digits":
        v = digits_label(F.col("file_name"))
    else:
        raise ValueError(rule)
    return df.withColumn("learner", v)


def read_learner_configs(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``<learner id>.json`` config (type-tagged ``[class, {...}]`` arrays)."""
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    # Spark counts a small file as megabytes, which makes a task of every few files
    raw = raw.coalesce(CONFIG_TASKS * spark.sparkContext.defaultParallelism)
    return raw.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("learner_id"),
                      F.col("value").alias("config"))


def _rename_parts(spark: SparkSession, path: str, name) -> None:
    """Give the part files under ``path/key=value/`` their final names ``name(value, n)``: one metadata
    call for each file, no data is moved."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    seen: dict[str, int] = {}
    for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(path, "*=*/part-*")):
        part = status.getPath()
        value = part.getParent().getName().split("=", 1)[1]
        seen[value] = seen.get(value, -1) + 1
        fs.rename(part, jvm.org.apache.hadoop.fs.Path(path, name(value, seen[value])))


def write_results(df: DataFrame, path: str, prefix: str) -> None:
    """Result files ``<prefix>-<learner>-<n>.arff``, as ``read_results`` reads them: (learner, question_id,
    created_on, fmeasure, topk_fmeasure, is_test, is_prequential)."""
    line = F.concat_ws(",", "question_id", F.concat(F.lit("'"), ts_text("created_on"), F.lit("'")), "fmeasure", "topk_fmeasure",
                       "is_test", "is_prequential")
    df.select("learner", line.alias("line")).write.partitionBy("learner").text(path)
    _rename_parts(df.sparkSession, path, lambda learner, n: f"{prefix}-{learner}-{n}.arff")


def _escaped(name: str | None) -> str:
    """A value as Spark writes it into the name of a partition's folder."""
    if not name:
        return "__HIVE_DEFAULT_PARTITION__"
    return "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\\x7f{[]^" or c < " " else c for c in name)


def _task_file_system(spark: SparkSession, path: str):
    """(URI, folder) of ``path`` if tasks can write there by themselves, else None."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    uri = f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getRawPath()}"
    try:
        store, folder = pa_fs.FileSystem.from_uri(uri)
        store.create_dir(folder, recursive=True)
        return uri, folder
    except (pa.ArrowException, OSError):
        return None


def _write_each(uri: str):
    """Writes one file for each row; a file has its name once it is whole, and a repeated task writes the same."""
    def run(batches):
        store, folder = pa_fs.FileSystem.from_uri(uri)
        for batch in batches:
            for learner, text in zip(batch.column("learner_id").to_pylist(), batch.column("text").to_pylist()):
                draft = f"{folder}/_{uuid.uuid4().hex}"
                with store.open_output_stream(draft, compression=None) as out:
                    out.write(text.encode())
                store.move(draft, f"{folder}/{_escaped(learner)}.json")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["files"])
    return run


def write_learner_configs(df: DataFrame, path: str) -> None:
    """One ``<learner id>.json`` for each learner of (learner_id, config); several rows of one are its lines.

    The tasks write the files under their names.  Only where they cannot reach the store by themselves do
    Spark's partition folders and a renaming of each file take their place."""
    spark = df.sparkSession
    found = _task_file_system(spark, path)
    if found is None:
        df.write.partitionBy("learner_id").text(path)
        _rename_parts(spark, path, lambda learner, n: f"{learner}.json")
        return
    lines = F.concat(F.array_join(F.array_sort(F.collect_list("config")), "\n"), F.lit("\n"))
    rows = df.select(F.col("learner_id").cast("string").alias("learner_id"), F.coalesce("config", F.lit("")).alias("config"))
    rows.groupBy("learner_id").agg(lines.alias("text")).mapInArrow(_write_each(found[0]), "files long").agg(F.sum("files")).collect()


def write_sparse_arff(header: DataFrame, rows: DataFrame, path: str) -> None:
    """S5 layout: the attribute lines in order, in one file, and the data lines ``{0 id,i v,...}``."""
    attr = header.orderBy("attr_index").coalesce(1)  # one line for each attribute
    attr.select(F.concat(F.lit("@attribute '"), "name", F.lit("' numeric")).alias("line")).write.mode("append").text(path)
    entry = F.struct("attr_index", F.concat_ws(" ", "attr_index", "val").alias("e"))
    lines = rows.groupBy("question_id").agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    text = F.concat(F.lit("{0 "), F.col("question_id").cast("string"), F.lit(","), F.array_join(F.transform("_e", lambda x: x["e"]), ","), F.lit("}"))
    lines.select(text.alias("line")).write.mode("append").text(path)


def boosted_config_label(config: Column) -> Column:
    """F6 + F18: ``hd-ensembleSize-minEpochs-strategy`` of a boosted-ensemble config; the
    strategy is LCW when aggregating by λ-CW, else MV by majority vote, else FM."""
    def g(p: str) -> Column:
        return F.get_json_object(config, p)
    strategy = (F.when(g("$[1].isToAggregateByLambdaCW") == "true", F.lit("LCW"))
                .when(g("$[1].isToAggregateByMajorityVote") == "true", F.lit("MV")).otherwise(F.lit("FM")))
    return F.concat_ws("-", g("$[1].individualPLTConfiguration[1].hd"), g("$[1].ensembleSize"),
                       g("$[1].minEpochs"), strategy)


def append_results(df: DataFrame, path: str, by_learner: bool = True) -> None:
    """Append metric rows to the result store (created if missing), one folder per learner."""
    w = df.write.mode("append")
    if by_learner:
        w = w.partitionBy("learner")
    w.parquet(path)


def validate_results(spark: SparkSession, df: DataFrame, nominal: Sequence[str] = ("is_test", "is_prequential"),
                     domain: Sequence[str] = ("0", "1")) -> DataFrame:
    """Violations of a result store: wrong column count/name/type at a position, and nominal
    columns whose value set is not exactly the domain (checked both ways on distinct values)."""
    expected = [("question_id", "bigint"), ("created_on", "timestamp_ntz"), ("fmeasure", "double"),
                ("topk_fmeasure", "double"), ("is_test", "string"), ("is_prequential", "string")]
    got = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    issues = []
    for i, (name, typ) in enumerate(expected):
        if i >= len(got):
            issues.append((i, name, "missing column"))
        elif got[i][0] != name:
            issues.append((i, name, f"name {got[i][0]}"))
        elif got[i][1] != typ:
            issues.append((i, name, f"type {got[i][1]}"))
    issues += [(i, got[i][0], "unexpected column") for i in range(len(expected), len(got))]
    schema_df = spark.createDataFrame(issues, "position int, column string, problem string")
    dom = spark.createDataFrame([(d,) for d in domain], "v string")
    parts = [schema_df]
    for c in nominal:
        if c not in df.columns:
            continue
        seen = df.select(F.col(c).cast("string").alias("v")).distinct()
        pos = F.lit(df.columns.index(c)).cast("int")
        extra = seen.join(F.broadcast(dom), "v", "left_anti").select(
            pos.alias("position"), F.lit(c).alias("column"), F.concat(F.lit("value outside domain: "), F.coalesce("v", F.lit("null"))).alias("problem"))
        missing = dom.join(seen, "v", "left_anti").select(
            pos.alias("position"), F.lit(c).alias("column"), F.concat(F.lit("domain value never seen: "), "v").alias("problem"))
        parts += [extra, missing]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_melted(df: DataFrame, path: str) -> None:
    """The melted report as CSV with a header (timestamps as text with milliseconds)."""
    out = df.withColumn("created_on", F.date_format("created_on", TS_TEXT_FORMAT))
    out.write.mode("overwrite").option("header", True).csv(path)
