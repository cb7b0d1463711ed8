"""Queries over files (S5–S12, F17, F18): the tables are written in the file layouts that the readers
expect, to the shared scratch folder, and read back."""

from pyspark.sql import functions as F

from tagstream.functions import scalar as S
from tagstream.operators import windows as W
from tagstream.plans.q_windows import _MELT_SQL
from tagstream.plans.registry import query
from tagstream.session import scratch_path
from tagstream.sources import files as X


@query("s5_arff_header", """
select cast(row_number() over (order by attr_index) - 1 as int) as attr_index, name, 'numeric' as type from fx_header""")
def s5_arff_header(fx):
    path = scratch_path(fx.spark, "arff")
    X.write_sparse_arff(fx.header, fx.sparse, path)
    return X.read_sparse_arff(fx.spark, path)[0].drop("file_name")


@query("s5_arff_rows", "select question_id, attr_index, cast(val as double) as val from fx_sparse")
def s5_arff_rows(fx):
    path = scratch_path(fx.spark, "arff")
    X.write_sparse_arff(fx.header, fx.sparse, path)
    return X.read_sparse_arff(fx.spark, path)[1].drop("file_name")


_RESULTS = """select cast(substr(learner, 2) as int) as learner, question_id, date_trunc('millisecond', created_on) as created_on,
  fm_units / cast(50000 as double) as fmeasure, topk_units / cast(50000 as double) as topk_fmeasure,
  cast(is_test as varchar) as is_test, cast(is_prequential as varchar) as is_prequential from fx_result"""


def _result_files(fx) -> str:
    """Result files ``run-<learner number>-<part>.arff`` of the whole metric log."""
    r = fx.result
    path = scratch_path(fx.spark, "results")
    X.write_results(r.select(
        F.substring("learner", 2, 9).alias("learner"), "question_id", "created_on", (F.col("fm_units") / F.lit(50000.0)).alias("fmeasure"),
        (F.col("topk_units") / F.lit(50000.0)).alias("topk_fmeasure"), "is_test", "is_prequential"), path, "run")
    return path


@query("s6_read_results", f"select * exclude (learner) from ({_RESULTS}) r")
def s6_read_results(fx):
    return X.read_results(fx.spark, _result_files(fx)).drop("file_name")


@query("s7_named_results", f"select * exclude (learner) from ({_RESULTS}) r where learner = 2")
def s7_named_results(fx):
    """Only the files whose name holds the text after position 1."""
    return X.read_results(fx.spark, _result_files(fx), name_text="-2-", after_pos=1).drop("file_name")


@query("s8_file_learner", f"select * from ({_RESULTS}) r")
def s8_file_learner(fx):
    return X.with_file_learner(X.read_results(fx.spark, _result_files(fx)), "part", part=2).drop("file_name")


@query("s9_learner_configs", """
select learner_id, concat('16384-', cast(10 + length(learner_id) as varchar), '-30-',
  case when parent_id is null then 'LCW' when is_active = 1 then 'MV' else 'FM' end) as label from fx_learner""")
def s9_learner_configs(fx):
    """S9 (F6, F18): one type-tagged JSON file for each learner."""
    flag = lambda c: F.when(c, F.lit("true")).otherwise(F.lit("false"))
    config = F.concat(
        F.lit('["Boosted",{"ensembleSize":'), (F.length("learner_id") + 10).cast("string"), F.lit(',"minEpochs":30,"isToAggregateByLambdaCW":'),
        flag(F.col("parent_id").isNull()), F.lit(',"isToAggregateByMajorityVote":'), flag(F.col("is_active") == 1),
        F.lit(',"individualPLTConfiguration":["Plt",{"hd":16384}]}]'))
    path = scratch_path(fx.spark, "configs")
    X.write_learner_configs(fx.learner.select("learner_id", config.alias("config")), path)
    return X.read_learner_configs(fx.spark, path).select("learner_id", X.boosted_config_label(F.col("config")).alias("label"))


@query("s10_append_results", "select * from fx_result")
def s10_append_results(fx):
    """Two appends to one result store, a folder for each learner."""
    path = scratch_path(fx.spark, "result-store")
    first = F.col("question_id") % 2 == 0
    X.append_results(fx.result.filter(first), path)
    X.append_results(fx.result.filter(~first), path)
    return fx.spark.read.schema(fx.result.schema).parquet(path)


def _domain_sql(position: int, column: str) -> str:
    return f"""
select cast({position} as int) as position, '{column}' as "column", concat('domain value never seen: ', v) as problem
from dom where v not in (select {column} from r)
union all
select cast({position} as int), '{column}', concat('value outside domain: ', v)
from (select distinct {column} as v from r) s where v not in (select v from dom)"""


@query("s11_validate_results", f"""
with r as (select is_test, case when question_id % 2 = 0 then '2' else is_prequential end as is_prequential
           from ({_RESULTS}) x where is_test = '0'),
dom as (select '0' as v union all select '1')
{_domain_sql(4, 'is_test')} union all {_domain_sql(5, 'is_prequential')}""")
def s11_validate_results(fx):
    """The log without its test rows, and with a flag that is no longer 0 or 1."""
    r = X.read_results(fx.spark, _result_files(fx)).drop("file_name").filter("is_test = '0'")
    bad = F.when(F.col("question_id") % 2 == 0, F.lit("2")).otherwise(F.col("is_prequential"))
    return X.validate_results(fx.spark, r.withColumn("is_prequential", bad))


@query("s12_write_melted", f"select * replace (strftime(created_on, '%Y-%m-%d %H:%M:%S.%g') as created_on) from ({_MELT_SQL}) m")
def s12_write_melted(fx):
    """The melted report (W4) as CSV with a header, read back by its header."""
    path = scratch_path(fx.spark, "melted")
    m = W.melt_results(fx.result)
    X.write_melted(m, path)
    kinds = {f.name: "string" if f.name == "created_on" else f.dataType.simpleString() for f in m.schema.fields}
    return fx.spark.read.option("header", True).schema(", ".join(f"{n} {t}" for n, t in kinds.items())).csv(path)


_CLASS_JSON = """case event_id % 5
  when 0 then '{"epochs": 1, "hd": 2}' when 1 then '{"ensembleSize": 3, "minEpochs": 4}'
  when 2 then '{"ensembleSize": 3, "toAggregateByLambdaCW": true}' when 3 then '{"epsilon": 0.1, "a": 1}'
  else props end"""


def _class_sql() -> str:
    known = lambda keys: "[" + ", ".join(f"'{k}'" for k in keys) + "]"
    return "case " + " ".join(f"when list_has_all({known(keys)}, json_keys(j)) then '{name}'" for name, keys in S.CONFIG_CLASSES) + " end"


@query("f17_config_class", f"select event_id, {_class_sql()} as class from (select event_id, {_CLASS_JSON} as j from events) e")
def f17_config_class(fx):
    """a key list of each class, or the event's own properties."""
    return fx.t.events.select("event_id", S.config_class(F.expr(_CLASS_JSON)).alias("class"))


@query("f18_tagged_value", "select event_id, json_extract_string(props, '$.k') as k from events")
def f18_tagged_value(fx):
    """F18 on nested type-tagged arrays ``[class, {...}]``."""
    j = F.concat(F.lit('["A",{"part":["B",'), F.col("props"), F.lit("]}]"))
    return fx.t.events.select("event_id", S.config_value(j, "$[1].part[1].k").alias("k"))
