"""Queries over the metric log: melt, record ids, running F / regret, series, chunks."""

from pyspark.sql import functions as F

from tagstream.operators import relational as R
from tagstream.operators import windows as W
from tagstream.plans.registry import query

_MELT_SQL = """
with base as (
  select *, cast(dense_rank() over (partition by learner order by question_id) as bigint) as record_id
  from fx_result where is_test = 0),
long as (
  select record_id, learner, question_id, created_on,
         concat(case when is_prequential = 1 then 'prequential' else 'post-training' end, ' ', 'general') as category,
         fm_units as units from base
  union all
  select record_id, learner, question_id, created_on,
         concat(case when is_prequential = 1 then 'prequential' else 'post-training' end, ' ', 'topk'),
         topk_units from base)
select record_id, learner, category, created_on,
       units / cast(50000 as double) as fm,
       cast(sum(units) over (partition by learner, category order by question_id, created_on
            rows between unbounded preceding and current row) as bigint) / cast(50000 as double) as cum_fm,
       (50000 - units) / cast(50000 as double) as regret,
       cast(sum(50000 - units) over (partition by learner, category order by question_id, created_on
            rows between unbounded preceding and current row) as bigint) / cast(50000 as double) as cum_regret
from long
"""


@query("w4_melt_results", _MELT_SQL)
def w4_melt_results(fx):
    """W4 (with W1–W3, U2): the reference's result melt over the whole metric log."""
    return W.melt_results(fx.result)


@query("w1_record_id", """
select learner, question_id,
       cast(dense_rank() over (partition by learner order by question_id) as bigint) as record_id
from fx_result""")
def w1_record_id(fx):
    d = W.record_id(fx.result.select("learner", "question_id"))
    return d.select("learner", "question_id", F.col("record_id").cast("bigint").alias("record_id"))


_LONG_SQL = """long as (
  select learner, question_id, created_on,
         concat(case when is_prequential = 1 then 'prequential' else 'post-training' end, ' ',
                case when is_topk = 1 then 'topk' else 'general' end) as category, units
  from fx_log where is_test = 0)"""


@query("u2_concat_categories", f"with {_LONG_SQL} select * from long")
def u2_concat_categories(fx):
    """The four tables of one category each, concatenated."""
    log = fx.log.filter("is_test = 0")
    tables = [log.filter((F.col("is_prequential") == p) & (F.col("is_topk") == k)).select(
        "learner", "question_id", "created_on", W.category(F.lit(p), F.lit(k)).alias("category"), "units") for p in (1, 0) for k in (0, 1)]
    return R.concat_categories(*tables)


@query("w2_cumulative_f", f"""with {_LONG_SQL}
select learner, category, question_id,
       cast(sum(units) over (partition by learner, category order by question_id, created_on
            rows between unbounded preceding and current row) as bigint) as cum_f
from long""")
def w2_cumulative_f(fx):
    d = W.cumulative_f(W.melt_long(fx.result), "units")
    return d.select("learner", "category", "question_id", F.col("cum_f").cast("bigint").alias("cum_f"))


@query("w3_regret", f"""with {_LONG_SQL}
select learner, category, question_id, 50000 - units as regret,
       cast(sum(50000 - units) over (partition by learner, category order by question_id, created_on
            rows between unbounded preceding and current row) as bigint) as cum_regret
from long""")
def w3_regret(fx):
    """W3 in F units (1 = 50000)."""
    d = W.regret(W.melt_long(fx.result), "units", scale=50000)
    return d.select("learner", "category", "question_id", F.col("regret").cast("bigint").alias("regret"),
                    F.col("cum_regret").cast("bigint").alias("cum_regret"))
