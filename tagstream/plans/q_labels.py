"""Label statistics, sampling and ordering queries."""

from pyspark.sql import functions as F

from tagstream.operators import aggregates as A
from tagstream.operators import relational as R
from tagstream.operators import windows as W
from tagstream.operators.indexing import assign_index
from tagstream.plans.q_windows import _MELT_SQL as _MELT
from tagstream.plans.registry import query
from tagstream.session import dimension

_TOP = """cnt as (select tag, count(*) as n from fx_question_tag group by tag),
top as (select tag from cnt order by n desc, tag limit 10),
rare as (select tag from cnt order by n, tag limit 10)"""

_COOC = f"""with {_TOP},
qt as (select * from fx_question_tag where tag in (select tag from top)),
pairs as (select a.tag as tag1, b.tag as tag2 from top a join top b on a.tag < b.tag),
x as (select a.tag as t1, b.tag as t2 from qt a join qt b on a.question_id = b.question_id and a.tag < b.tag)
select p.tag1, p.tag2, cast(count(x.t1) as bigint) as n
from pairs p left join x on x.t1 = p.tag1 and x.t2 = p.tag2 group by p.tag1, p.tag2"""


@query("a13_top_tags", f"with {_TOP} select tag, n from cnt order by n desc, tag limit 10")
def a13_top_tags(fx):
    return A.top_tags(fx.question_tag, 10)


@query("a14_rare_tags", f"with {_TOP} select tag, n from cnt order by n, tag limit 10")
def a14_rare_tags(fx):
    return A.rare_tags(fx.question_tag, 10)


@query("a15_cooccurrence", _COOC)
def a15_cooccurrence(fx):
    top = A.top_tags(fx.question_tag, 10)
    return A.cooccurrence(fx.question_tag, top)


@query("a15_cooccurrence_top_rare", f"""with {_TOP},
qt as (select * from fx_question_tag where tag in (select tag from top) or tag in (select tag from rare)),
pairs as (select a.tag as tag1, b.tag as tag2 from top a join rare b on a.tag <> b.tag),
x as (select a.tag as t1, b.tag as t2 from qt a join qt b on a.question_id = b.question_id and a.tag <> b.tag)
select p.tag1, p.tag2, cast(count(x.t1) as bigint) as n
from pairs p left join x on x.t1 = p.tag1 and x.t2 = p.tag2 group by p.tag1, p.tag2""")
def a15_cooccurrence_top_rare(fx):
    """A15 ``highLowCor``: top tags × rare tags."""
    return A.cooccurrence(fx.question_tag, A.top_tags(fx.question_tag, 10), A.rare_tags(fx.question_tag, 10))


@query("j10_tag_pairs", f"""with {_TOP},
qt as (select * from fx_question_tag where tag in (select tag from top))
select a.question_id, a.tag as tag1, b.tag as tag2 from qt a join qt b on a.question_id = b.question_id and a.tag < b.tag""")
def j10_tag_pairs(fx):
    return R.tag_pairs(fx.question_tag, A.top_tags(fx.question_tag, 10))


@query("u6_edge_nodes", f"""with edges as ({_COOC})
select distinct node from (select tag1 as node from edges where n > 0 union all select tag2 from edges where n > 0) u""")
def u6_edge_nodes(fx):
    e = A.cooccurrence(fx.question_tag, A.top_tags(fx.question_tag, 10)).filter(F.col("n") > 0)
    return R.edge_nodes(e)


@query("o4_node_index", f"""with edges as ({_COOC}),
nodes as (select distinct node from (select tag1 as node from edges where n > 0 union all select tag2 from edges where n > 0) u)
select node, cast(row_number() over (order by node) - 1 as int) as index from nodes""")
def o4_node_index(fx):
    e = A.cooccurrence(fx.question_tag, A.top_tags(fx.question_tag, 10)).filter(F.col("n") > 0)
    return assign_index(R.edge_nodes(e), "node", 0, out="index")


@query("a16_scaled_weight", """
with cnt as (select tag, count(*) as n from fx_question_tag group by tag)
select tag, n, cast(n - (select min(n) from cnt) as double) / cast(nullif((select max(n) from cnt) - (select min(n) from cnt), 0) as double) as weight
from cnt""")
def a16_scaled_weight(fx):
    return A.scaled_weight(A.tag_counts(fx.question_tag), "n")


@query("a18_monthly_counts", """
select m.month, coalesce(c.n, 0) as n
from (select unnest(generate_series(timestamp '1994-01-01', timestamp '2002-12-01', interval 1 month)) as month) m
left join (select date_trunc('month', o_orderdate) as month, count(*) as n from orders group by 1) c on c.month = m.month""")
def a18_monthly_counts(fx):
    return A.monthly_counts(fx.t.orders, "o_orderdate", "1994-01-01", "2002-12-01")


@query("a19_user_tag_counts", """
select user_id, count(distinct event_type) as n_tags from events group by user_id""")
def a19_user_tag_counts(fx):
    return A.user_tag_counts(fx.t.events, "user_id", "event_type")


@query("a19_user_tag_counts_approx", """
select user_id, count(distinct event_id % 1000) as n_tags, true as within_bound from events group by user_id""")
def a19_user_tag_counts_approx(fx):
    """A19 by stored sketches per user and day: the exact count, and whether the merged estimate keeps its bound."""
    ev = fx.t.events.withColumn("tag", F.col("event_id") % 1000)
    sketches = dimension(A.user_tag_sketches(ev, "user_id", F.to_date("ts"), "tag"), "a19-sketches")
    near = A.user_tag_counts_approx(sketches, "user_id").withColumnRenamed("n_tags", "estimate")
    both = A.user_tag_counts(ev, "user_id", "tag").join(near, "user_id")
    off = F.abs(F.col("estimate") - F.col("n_tags"))
    return both.select("user_id", "n_tags", (off <= F.lit(A.SKETCH_BOUND) * F.col("n_tags")).alias("within_bound"))


@query("a20_sample_users", """
with u as (select distinct user_id from events),
s as (select user_id from u order by md5(concat(cast(user_id as varchar), '42')) limit 20)
select e.user_id, count(distinct e.event_type) as n_tags from events e where e.user_id in (select user_id from s)
group by e.user_id""")
def a20_sample_users(fx):
    ev = fx.t.events
    s = A.sample_users(ev, "user_id", 20, 42)
    return A.user_tag_counts(ev.join(s, "user_id", "left_semi"), "user_id", "event_type")


@query("w5_cumulative_series", """
select learner, question_id,
       cast(row_number() over (partition by learner order by question_id) as bigint) as pos,
       cast(sum(fm_units) over (partition by learner order by question_id rows between unbounded preceding and current row) as bigint) as cum_value
from fx_result where is_prequential = 1 and is_test = 0""")
def w5_cumulative_series(fx):
    d = fx.result.filter((F.col("is_prequential") == 1) & (F.col("is_test") == 0)).select(
        "learner", "question_id", "fm_units")
    out = W.cumulative_series(d, "question_id", "fm_units", keys=["learner"])
    return out.select("learner", "question_id", F.col("pos").cast("bigint").alias("pos"),
                      F.col("cum_value").cast("bigint").alias("cum_value"))


@query("w6_chunk_no", """
select question_id, cast(row_number() over (order by question_id) as bigint) as rn,
       cast(floor((row_number() over (order by question_id) - 1) / 100) as bigint) as chunk_no
from fx_question""")
def w6_chunk_no(fx):
    out = W.chunk_no(fx.question.select("question_id"), "question_id", 100)
    return out.select("question_id", F.col("rn").cast("bigint").alias("rn"), "chunk_no")


@query("s2_page_sample", """
with r as (select event_id, ts,
  row_number() over (partition by cast(ts as date) order by ts, event_id) as rn from events)
select event_id, ts, cast(floor((rn - 1) / 10) as bigint) as page from r where floor((rn - 1) / 10) % 10 = 0""")
def s2_page_sample(fx):
    """Per-day pages of 10, every 10th page."""
    return W.page_sample(fx.t.events.select("event_id", "ts"), "ts", "event_id", page_size=10, stride=10)


@query("o1_first_n", "select question_id, title from fx_question order by question_id limit 50")
def o1_first_n(fx):
    from tagstream.operators.sorting import first_n

    return first_n(fx.question.select("question_id", "title"), "question_id", 50)


@query("o2_oldest_first", "select question_id, created_on from fx_question order by created_on, question_id")
def o2_oldest_first(fx):
    from tagstream.operators.sorting import oldest_first

    return oldest_first(fx.question.select("question_id", "created_on"))


@query("o3_report_order", "select record_id, learner, category, created_on from (" + _MELT + ") m order by learner, category, created_on")
def o3_report_order(fx):
    m = W.melt_results(fx.result)
    return W.report_order(m).select("record_id", "learner", "category", "created_on")
