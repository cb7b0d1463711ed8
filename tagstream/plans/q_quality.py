"""Quality metrics, thresholds, votes and label decoding (M7, M8, M10–M13, M15, M16, M18, M19, O5,
U3, J6)."""

from pyspark.sql import functions as F

from tagstream.operators import quality as Q
from tagstream.operators import relational as R
from tagstream.operators.aggregates import bernoulli_split
from tagstream.plans.registry import query

_FLAGS = """fl as (select question_id, tag, max(p) as p, max(t) as t from (
    select question_id, tag, 1 as p, 0 as t from {pred}
    union all select question_id, tag, 0, 1 from {truth}) u group by question_id, tag)"""

_INSTANCE_F = """
with {flags},
pq as (select question_id, sum(p * t) as tp, sum(p) as np, sum(t) as nt from fl group by question_id)
select q.question_id,
       case when coalesce(pq.np, 0) + coalesce(pq.nt, 0) = 0 then cast(1 as double)
            else cast(2 * pq.tp as double) / (pq.np + pq.nt) end as f
from fx_question q left join pq on pq.question_id = q.question_id"""

_TOP5 = """top5 as (select ls.question_id, t.name as tag, ls.tag_index, ls.score_milli,
                  row_number() over (partition by ls.question_id order by ls.score_milli desc, ls.tag_index) as rnk
                  from fx_label_score ls join fx_tag t on t.tag_index = ls.tag_index)"""


@query("m7_instance_f", _INSTANCE_F.format(flags=_FLAGS.format(pred="fx_prediction", truth="fx_question_tag")))
def m7_instance_f(fx):
    return Q.instance_f(fx.prediction, fx.question_tag, fx.question)


def _top5_tags(fx):
    top = Q.topk_labels(fx.label_score, 5, score="score_milli")
    return top.join(fx.tag, "tag_index").select("question_id", F.col("name").alias("tag"))


@query("m8_topk_f", f"""
with {_TOP5}, pred as (select question_id, tag from top5 where rnk <= 5),
{_FLAGS.format(pred="pred", truth="fx_question_tag")},
pq as (select question_id, sum(p * t) as tp, sum(p) as np, sum(t) as nt from fl group by question_id)
select q.question_id,
       case when coalesce(pq.np, 0) + coalesce(pq.nt, 0) = 0 then cast(1 as double)
            else cast(2 * pq.tp as double) / (pq.np + pq.nt) end as f
from fx_question q left join pq on pq.question_id = q.question_id""")
def m8_topk_f(fx):
    """M8: F of the top-5 prediction (O5 then M7)."""
    return Q.instance_f(_top5_tags(fx), fx.question_tag, fx.question)


_LABEL_COUNTS = """
with {flags}
select tag, sum(p * t) as tp, sum(p * (1 - t)) as fp, sum((1 - p) * t) as fn,
       cast(2 * sum(p * t) as double) / (2 * sum(p * t) + sum(p * (1 - t)) + sum((1 - p) * t)) as f
from fl group by tag""".replace("{flags}", _FLAGS.format(pred="fx_prediction", truth="fx_question_tag"))


@query("m11_label_f", _LABEL_COUNTS)
def m11_label_f(fx):
    return Q.label_counts(fx.prediction, fx.question_tag)


@query("m11_macro_f", f"select round(avg(f), 9) as macro_f from ({_LABEL_COUNTS}) x")
def m11_macro_f(fx):
    return Q.macro_f(fx.prediction, fx.question_tag)


_VOTE_FLAGS = """fl as (select member, question_id, tag, max(p) as p, max(t) as t from (
    select member, question_id, tag, 1 as p, 0 as t from fx_vote
    union all select m.member, qt.question_id, qt.tag, 0, 1 from fx_question_tag qt
      join (select distinct member from fx_vote) m on true
      where qt.question_id in (select question_id from fx_question)) u
  group by member, question_id, tag)"""
_MEMBER_MACRO = f"""with {_VOTE_FLAGS},
lab as (select member, tag, cast(2 * sum(p * t) as double) / (2 * sum(p * t) + sum(p * (1 - t)) + sum((1 - p) * t)) as f
        from fl group by member, tag)
select member, round(avg(f), 9) as quality from lab group by member"""


def _member_truth(fx):
    return fx.question_tag.join(fx.question.select("question_id"), "question_id", "left_semi")


@query("m12_member_quality_macro", _MEMBER_MACRO)
def m12_member_quality_macro(fx):
    return Q.member_macro_f(fx.vote, _member_truth(fx))


@query("m12_member_quality_avg", f"""with {_VOTE_FLAGS},
pq as (select member, question_id, sum(p * t) as tp, sum(p) as np, sum(t) as nt from fl group by member, question_id),
qf as (select m.member, q.question_id,
         case when coalesce(pq.np, 0) + coalesce(pq.nt, 0) = 0 then cast(1 as double)
              else cast(2 * pq.tp as double) / (pq.np + pq.nt) end as f
       from fx_question q join (select distinct member from fx_vote) m on true
       left join pq on pq.question_id = q.question_id and pq.member = m.member)
select member, round(avg(f), 9) as quality from qf group by member""")
def m12_member_quality_avg(fx):
    return Q.member_avg_f(fx.vote, _member_truth(fx), fx.question)


_SCORED = """scored as (select ls.tag_index, ls.question_id, ls.score_milli,
    case when qt.question_id is null then 0 else 1 end as y
  from fx_label_score ls join fx_tag t on t.tag_index = ls.tag_index
  left join fx_question_tag qt on qt.question_id = ls.question_id and qt.tag = t.name)"""
_THRESH = f"""{_SCORED},
bins as (select tag_index, score_milli, count(*) as n, sum(y) as tp from scored group by tag_index, score_milli),
c as (select tag_index, score_milli,
        sum(tp) over (partition by tag_index order by score_milli desc rows between unbounded preceding and current row) as cum_tp,
        sum(n) over (partition by tag_index order by score_milli desc rows between unbounded preceding and current row) as cum_n,
        sum(tp) over (partition by tag_index) as n_pos from bins),
f as (select tag_index, score_milli, cast(2 * cum_tp as double) / (cum_n + n_pos) as f from c),
best as (select tag_index, score_milli as threshold, f as best_f,
           row_number() over (partition by tag_index order by f desc, score_milli desc) as rn from f)"""


def _scored(fx):
    truth = fx.question_tag.join(fx.tag, F.col("name") == F.col("tag")).select(
        "question_id", "tag_index", F.lit(1).alias("y"))
    return fx.label_score.join(truth, ["question_id", "tag_index"], "left").select(
        "tag_index", "question_id", F.col("score_milli").alias("score"), F.coalesce("y", F.lit(0)).alias("y"))


@query("m13_tune_thresholds", f"with {_THRESH} select tag_index, threshold, best_f from best where rn = 1")
def m13_tune_thresholds(fx):
    return Q.tune_thresholds(_scored(fx))


@query("m10_positive_labels", f"""with {_THRESH}
select ls.question_id, ls.tag_index, ls.score_milli as score from fx_label_score ls
join best b on b.tag_index = ls.tag_index and b.rn = 1 where ls.score_milli >= b.threshold""")
def m10_positive_labels(fx):
    """Labels at or above the tuned (M13) per-label threshold."""
    s = _scored(fx)
    thr = Q.tune_thresholds(s)
    return Q.positive_labels(s.select("question_id", "tag_index", "score"), thr)


@query("m15_vote_mv", """
select question_id, tag from (select distinct question_id, member, tag from fx_vote) v
group by question_id, tag having count(*) * 2 > (select count(distinct member) from fx_vote)""")
def m15_vote_mv(fx):
    return Q.ensemble_vote(fx.vote, "MV")


@query("m15_vote_fm", f"""
with w as ({_MEMBER_MACRO})
select v.question_id, v.tag from (select distinct question_id, member, tag from fx_vote) v join w on w.member = v.member
group by v.question_id, v.tag having sum(w.quality) * 2 > (select sum(quality) from w)""")
def m15_vote_fm(fx):
    """M15 FM: members weighted by their macro F."""
    w = m12_member_quality_macro(fx).withColumnRenamed("quality", "weight")
    return Q.ensemble_vote(fx.vote, "FM", w)


@query("m15_vote_lcw", """
with w as (select member, cast(member as double) as weight from (select distinct member from fx_vote) m)
select v.question_id, v.tag from (select distinct question_id, member, tag from fx_vote) v join w on w.member = v.member
group by v.question_id, v.tag having sum(w.weight) * 2 > (select sum(weight) from w)""")
def m15_vote_lcw(fx):
    """M15 LCW: the member weight is an input column (here the member number)."""
    w = fx.vote.select("member").distinct().withColumn("weight", F.col("member").cast("double"))
    return Q.ensemble_vote(fx.vote, "LCW", w)


@query("m16_retain_members", """
with st as (select user_id, count(*) as n_rows, sum(cast(round(value * 100) as bigint)) as score from events group by user_id),
m as (select l.learner_id, l.parent_id, s.n_rows, s.score from fx_learner l
      join st s on concat('L', cast(s.user_id as varchar)) = l.learner_id where l.parent_id is not null),
r as (select *, row_number() over (partition by parent_id, n_rows >= 60 order by score desc, learner_id) as rk,
             count(*) over (partition by parent_id, n_rows >= 60) as n from m)
select learner_id, parent_id, n_rows, score,
       cast(case when n_rows < 60 or rk <= ceil(n * 0.5) then 1 else 0 end as int) as is_active from r""")
def m16_retain_members(fx):
    """Ensembles are the parent learners; members need 60 training rows; the best half stays."""
    st = fx.t.events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("score"))
    st = st.select(F.concat(F.lit("L"), F.col("user_id").cast("string")).alias("learner_id"), "n_rows", "score")
    m = fx.learner.filter(F.col("parent_id").isNotNull()).select("learner_id", "parent_id").join(st, "learner_id")
    return Q.retain_members(m, 0.5, 60, "parent_id", "learner_id", "n_rows", "score")


@query("m18_bernoulli_split", """
select question_id, cast(cast(('0x' || substr(md5(concat(cast(question_id as varchar), '42')), 1, 8)) as bigint)
                         / 4294967296.0 < 0.2 as int) as is_test from fx_question""")
def m18_bernoulli_split(fx):
    return bernoulli_split(fx.question.select("question_id"), "question_id", 0.2, 42)


@query("o5_topk_labels", f"""with {_TOP5}
select question_id, tag_index, score_milli, cast(rnk as int) as rank from top5 where rnk <= 5""")
def o5_topk_labels(fx):
    return Q.topk_labels(fx.label_score, 5, score="score_milli")


@query("m19_top_estimates", f"""with {_TOP5}
select question_id, tag_index, score_milli, cast(rnk as int) as rank from top5 where rnk <= 3""")
def m19_top_estimates(fx):
    return Q.topk_labels(fx.label_score, 3, score="score_milli")


_PRED_SETS = f"""{_TOP5},
pos as (select question_id, list(tag_index) as general from fx_label_score where score_milli >= 900 group by question_id),
tk as (select question_id, list(tag_index order by rnk) as topk from top5 where rnk <= 5 group by question_id),
sets as (select tk.question_id, coalesce(pos.general, []) as general, tk.topk from tk left join pos using (question_id))"""


def _pred_sets(fx):
    ls = fx.label_score
    pos = ls.filter(F.col("score_milli") >= 900).groupBy("question_id").agg(F.collect_list("tag_index").alias("general"))
    top = Q.topk_labels(ls, 5, score="score_milli")
    tk = top.groupBy("question_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag_index"))), lambda s: s["tag_index"]).alias("topk"))
    return tk.join(pos, "question_id", "left").select(
        "question_id", F.coalesce("general", F.array().cast("array<int>")).alias("general"), "topk")


@query("u3_predicted_labels", f"""with {_PRED_SETS}
select question_id, list_sort(list_distinct(list_concat(general, topk))) as labels from sets""")
def u3_predicted_labels(fx):
    s = _pred_sets(fx)
    return s.select("question_id", R.predicted_labels("general", "topk").alias("labels"))


@query("j6_decode_predictions", f"""with {_PRED_SETS},
g as (select question_id, unnest(general) as i from sets),
k as (select question_id, unnest(topk) as i, generate_subscripts(topk, 1) as pos from sets),
gn as (select g.question_id, list_sort(list(t.name)) as general from g left join fx_tag t on t.tag_index = g.i group by g.question_id),
kn as (select k.question_id, list(t.name order by k.pos) as topk from k left join fx_tag t on t.tag_index = k.i group by k.question_id)
select s.question_id, coalesce(gn.general, []) as general, kn.topk
from sets s left join gn on gn.question_id = s.question_id join kn on kn.question_id = s.question_id""")
def j6_decode_predictions(fx):
    return R.decode_predictions(_pred_sets(fx), fx.tag)
