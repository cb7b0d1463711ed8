"""Queries over the metric log: averages, series, summaries, reports."""

from pyspark.sql import functions as F

from tagstream.operators import aggregates as A
from tagstream.operators import relational as R
from tagstream.plans.registry import query

_SPINE = """select l.learner, c.is_prequential, c.is_topk
  from (select distinct learner from fx_log) l
  cross join (select * from (values (0, 0), (0, 1), (1, 0), (1, 1)) v(is_prequential, is_topk)) c"""


@query("t2_metric_events", "select * from fx_log")
def t2_metric_events(fx):
    """T2 batch form: two rows (general, top-k) per scored instance."""
    return fx.log


@query("a3_avg_f", f"""
with spine as ({_SPINE}),
a as (select learner, is_prequential, is_topk, avg(units) as a from fx_log where is_test = 0
      group by learner, is_prequential, is_topk)
select s.learner, s.is_prequential, s.is_topk, coalesce(a.a / cast(50000 as double), 0.0) as avg_f
from spine s left join a using (learner, is_prequential, is_topk)""")
def a3_avg_f(fx):
    return A.avg_f(fx.log)


@query("a4_avg_test_f", """
with spine as (select l.learner, k.is_topk from (select distinct learner from fx_log) l
               cross join (select * from (values (0), (1)) v(is_topk)) k),
a as (select learner, is_topk, avg(units) as a from fx_log where is_test = 1 group by learner, is_topk)
select s.learner, s.is_topk, coalesce(a.a / cast(50000 as double), 0.0) as avg_test_f
from spine s left join a using (learner, is_topk)""")
def a4_avg_test_f(fx):
    return A.avg_test_f(fx.log)


@query("t3_running_avg", """
select learner, is_prequential, is_topk, avg(units) / cast(50000 as double) as avg_f, count(*) as n
from fx_log where is_test = 0 group by learner, is_prequential, is_topk""")
def t3_running_avg(fx):
    """T3 batch form (the streaming twin is ``streaming.running_avg_stream``)."""
    return A.running_avg(fx.log)


@query("p6_metric_filter", """
select * from fx_log where learner = 'L2' and is_prequential = 1 and is_topk = 1 and is_test = 0""")
def p6_metric_filter(fx):
    return R.metric_filter(fx.log, learner="L2", is_prequential=1, is_topk=1, is_test=0)


@query("a9_f_series", """
select learner,
       concat(case when is_prequential = 1 then 'prequential' else 'post-training' end, ' ',
              case when is_topk = 1 then 'topk' else 'general' end) as series,
       cast(row_number() over (partition by learner, is_prequential, is_topk
                               order by created_on, question_id) as bigint) as pos,
       question_id, created_on, units / cast(50000 as double) as f
from fx_log where is_test = 0""")
def a9_f_series(fx):
    return A.f_series(fx.log)


_PIVOT = """
  select learner,
    coalesce(max(case when is_prequential = 1 and is_topk = 0 then avg_f end), 0.0) as preq_general,
    coalesce(max(case when is_prequential = 1 and is_topk = 1 then avg_f end), 0.0) as preq_topk,
    coalesce(max(case when is_prequential = 0 and is_topk = 0 then avg_f end), 0.0) as post_general,
    coalesce(max(case when is_prequential = 0 and is_topk = 1 then avg_f end), 0.0) as post_topk
  from avgs group by learner"""

_MACRO_PER_LEARNER = """
  -- each learner's predictions: fx_prediction rows of the questions it logged
  lp as (select distinct r.learner, p.question_id, p.tag from fx_prediction p
         join (select distinct learner, question_id from fx_result) r on r.question_id = p.question_id),
  lt as (select distinct r.learner, t.question_id, t.tag from fx_question_tag t
         join (select distinct learner, question_id from fx_result) r on r.question_id = t.question_id),
  pairs as (select coalesce(lp.learner, lt.learner) as learner, coalesce(lp.tag, lt.tag) as tag,
                   case when lp.tag is not null and lt.tag is not null then 1 else 0 end as tp,
                   case when lp.tag is not null and lt.tag is null then 1 else 0 end as fp,
                   case when lp.tag is null and lt.tag is not null then 1 else 0 end as fn
            from lp full outer join lt on lp.learner = lt.learner and lp.question_id = lt.question_id and lp.tag = lt.tag),
  per_label as (select learner, tag, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from pairs group by learner, tag),
  macro as (select learner, round(avg(cast(2 * tp as double) / (2 * tp + fp + fn)), 9) as macro_f from per_label group by learner)"""


def _learner_predictions(fx):
    logged = fx.result.select("learner", "question_id").distinct()
    pred = fx.prediction.join(logged, "question_id").select("learner", "question_id", "tag").distinct()
    truth = fx.question_tag.join(logged, "question_id").select("learner", "question_id", "tag").distinct()
    return pred, truth


@query("a10_learner_summary", f"""
with spine as ({_SPINE}),
a as (select learner, is_prequential, is_topk, avg(units) as a from fx_log where is_test = 0
      group by learner, is_prequential, is_topk),
avgs as (select s.learner, s.is_prequential, s.is_topk, coalesce(a.a / cast(50000 as double), 0.0) as avg_f
         from spine s left join a using (learner, is_prequential, is_topk)),
p as ({_PIVOT}),
{_MACRO_PER_LEARNER}
select p.*, m.macro_f from p left join macro m using (learner)""")
def a10_learner_summary(fx):
    from tagstream.operators.quality import macro_f

    pred, truth = _learner_predictions(fx)
    macro = macro_f(pred, truth, keys=["learner"])
    return A.learner_summary(fx.log, macro)


@query("a11_latest_vs_avg", """
with r as (select *, row_number() over (partition by learner, is_prequential, is_topk
                                        order by created_on desc, question_id desc) as rn
           from fx_log where is_test = 0)
select learner, is_prequential, is_topk,
       max(case when rn = 1 then units end) / cast(50000 as double) as latest_f,
       avg(units) / cast(50000 as double) as avg_f
from r group by learner, is_prequential, is_topk""")
def a11_latest_vs_avg(fx):
    return A.latest_vs_avg(fx.log)


@query("a12_family_mean", """
with runs as (
  select learner, cast(created_on as date) as run_day, avg(units) / cast(50000 as double) as final_topk
  from fx_log where is_test = 0 and is_topk = 1 group by learner, cast(created_on as date))
select learner, round(avg(final_topk), 9) as mean_value, count(*) as n_runs from runs group by learner""")
def a12_family_mean(fx):
    """family = learner, run = UTC day; each run's value is its top-k average."""
    runs = (fx.log.filter((F.col("is_test") == 0) & (F.col("is_topk") == 1))
            .groupBy("learner", F.to_date("created_on").alias("run_day"))
            .agg((F.avg("units") / F.lit(50000.0)).alias("final_topk")))
    return A.family_mean(runs, "learner", "run_day", "final_topk")


@query("a17_avg_times", """
select learner, is_prequential, is_topk, avg(duration_us) as avg_duration_us
from fx_log group by learner, is_prequential, is_topk""")
def a17_avg_times(fx):
    return A.avg_times(fx.log)


_CONFIGS = """configs as (select learner_id as learner, coalesce(parent_id, 'root') as parent, is_active
                 from fx_learner)"""


@query("a21_experiment_report", f"""
with {_CONFIGS}
select c.parent, c.is_active,
  coalesce(avg(case when is_prequential = 1 and is_topk = 0 then units end) / cast(50000 as double), 0.0) as preq_general,
  coalesce(avg(case when is_prequential = 1 and is_topk = 1 then units end) / cast(50000 as double), 0.0) as preq_topk,
  coalesce(avg(case when is_prequential = 0 and is_topk = 0 then units end) / cast(50000 as double), 0.0) as post_general,
  coalesce(avg(case when is_prequential = 0 and is_topk = 1 then units end) / cast(50000 as double), 0.0) as post_topk,
  avg(duration_us) as avg_duration_us, count(distinct question_id) as n_instances
from fx_log l join configs c using (learner) where l.is_test = 0
group by c.parent, c.is_active""")
def a21_experiment_report(fx):
    """The learner's configuration is its (parent, is_active) from the learner table."""
    configs = fx.learner.select(F.col("learner_id").alias("learner"),
                                F.coalesce("parent_id", F.lit("root")).alias("parent"), "is_active")
    return A.experiment_report(fx.log, configs, ["parent", "is_active"])


@query("j9_label_results", f"""
with {_CONFIGS}
select r.*, c.parent, c.is_active from fx_result r left join configs c on r.learner = c.learner""")
def j9_label_results(fx):
    configs = fx.learner.select(F.col("learner_id"), F.coalesce("parent_id", F.lit("root")).alias("parent"),
                                "is_active")
    return R.label_results(fx.result, configs, key="learner", cfg_key="learner_id")


@query("j5_log_details", """
select r.question_id, r.learner, r.created_on, r.fm_units, q.title, l.parent_id, l.is_active
from fx_result r join fx_question q on q.question_id = r.question_id
join fx_learner l on l.learner_id = r.learner""")
def j5_log_details(fx):
    d = R.log_details(fx.result, fx.question, fx.learner)
    return d.select("question_id", "learner", "created_on", "fm_units", "title", "parent_id", "is_active")
