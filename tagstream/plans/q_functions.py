"""Scalar function queries (F6–F21) over the fixture views and driver tables."""

from pyspark.sql import functions as F

from tagstream.functions import scalar as S
from tagstream.plans.registry import query


@query("f6_config_label", """
select question_id, concat_ws('-', learner, cast(is_prequential as varchar), cast(is_test as varchar)) as label from fx_result""")
def f6_config_label(fx):
    r = fx.result
    return r.select("question_id", S.config_label("learner", "is_prequential", "is_test").alias("label"))


@query("f7_name_matches", """
select attr_index, name, starts_with(name, 'L_') as is_label, suffix(name, '1') as ends_1,
       instr(name, 'src') > 2 as src_after_2
from fx_header""")
def f7_name_matches(fx):
    h = fx.header
    return h.select("attr_index", "name", S.name_matches("name", prefix="L_").alias("is_label"),
                    S.name_matches("name", suffix="1").alias("ends_1"),
                    S.name_matches("name", text="src", after_pos=2).alias("src_after_2"))


@query("f8_part_int", """
select question_id, try_cast(split_part(concat_ws('-', learner, cast(is_prequential as varchar), cast(duration_us as varchar)), '-', 3) as int) as part3,
       try_cast(split_part(concat_ws('-', learner, cast(is_prequential as varchar)), '-', 1) as int) as part1
from fx_result""")
def f8_part_int(fx):
    r = fx.result
    lab3 = S.config_label("learner", "is_prequential", "duration_us")
    lab2 = S.config_label("learner", "is_prequential")
    return r.select("question_id", S.part_int(lab3, "-", 3).alias("part3"), S.part_int(lab2, "-", 1).alias("part1"))


@query("f9_digits_label", "select tag_index, regexp_replace(name, '(?i)[a-z.]', '', 'g') as digits from fx_tag")
def f9_digits_label(fx):
    return fx.tag.select("tag_index", S.digits_label("name").alias("digits"))


@query("f10_day_window", """
select question_id, created_on as win_start,
       least(date_trunc('day', created_on) + interval '23:59:59',
             (select max(created_on) from fx_question)) as win_end,
       created_on + interval 1 second as next_start
from fx_question""")
def f10_day_window(fx):
    q = fx.question
    start, end = S.day_window("created_on", q.agg(F.max("created_on")).scalar())
    return q.select("question_id", start.alias("win_start"), end.alias("win_end"),
                    S.add_seconds("created_on", 1).alias("next_start"))


@query("f11_month_bounds", """
select o_orderkey, date_trunc('month', o_orderdate) as month_start, last_day(o_orderdate) as month_end,
       cast(date_trunc('month', o_orderdate) + interval 1 month as date) as next_month
from orders""")
def f11_month_bounds(fx):
    o = fx.t.orders
    return o.select("o_orderkey", S.month_start("o_orderdate").alias("month_start"),
                    S.month_end("o_orderdate").alias("month_end"), S.next_month("o_orderdate").alias("next_month"))


@query("f12_ts_text", """
select question_id, strftime(created_on, '%Y-%m-%d %H:%M:%S.%g') as ts_text,
       strptime(strftime(created_on, '%Y-%m-%d %H:%M:%S.%g'), '%Y-%m-%d %H:%M:%S.%g') as ts_back
from fx_question""")
def f12_ts_text(fx):
    q = fx.question
    return q.select("question_id", S.ts_text("created_on").alias("ts_text"),
                    S.text_ts(S.ts_text("created_on")).alias("ts_back"))


@query("f13_epoch_s", "select question_id, epoch_us(created_on) // 1000000 as epoch_s from fx_question")
def f13_epoch_s(fx):
    return fx.question.select("question_id", S.epoch_s("created_on").alias("epoch_s"))


@query("f14_regret_of", "select question_id, 1 - fm_units / cast(50000 as double) as regret from fx_result")
def f14_regret_of(fx):
    from tagstream.operators.windows import regret_of

    r = fx.result
    return r.select("question_id", regret_of(F.col("fm_units") / F.lit(50000.0)).alias("regret"))


@query("f15_percent2", """
select question_id, round(coalesce(case when is_test = 1 then null else fm_units / cast(50000 as double) end, 0) * 100, 2) as pct
from fx_result""")
def f15_percent2(fx):
    r = fx.result
    f = F.when(F.col("is_test") == 1, F.lit(None)).otherwise(F.col("fm_units") / F.lit(50000.0))
    return r.select("question_id", S.percent2(f).alias("pct"))


@query("f16_page_no", "select learner, cast(floor(count(*) / 100) + 1 as bigint) as page from fx_result group by learner")
def f16_page_no(fx):
    c = fx.result.groupBy("learner").agg(F.count(F.lit(1)).alias("n"))
    return c.select("learner", S.page_no("n", F.lit(100)).alias("page"))


@query("f18_config_value", "select event_id, json_extract_string(props, '$.k') as k from events")
def f18_config_value(fx):
    return fx.t.events.select("event_id", S.config_value("props", "$.k").alias("k"))


@query("f19_count_map", """
select question_id, list(struct_pack(key := tag, value := n) order by tag) as counts
from (select question_id, split_part(tag, ':', 1) as tag, cast(count(*) as int) as n
      from fx_question_tag group by question_id, split_part(tag, ':', 1)) x
group by question_id""")
def f19_count_map(fx):
    """per question, the count map of its tag families, as sorted (key, value) entries."""
    fam = fx.question_tag.groupBy("question_id").agg(F.collect_list(F.split_part("tag", F.lit(":"), F.lit(1))).alias("fams"))
    m = S.count_map("fams")
    return fam.select("question_id", F.array_sort(F.map_entries(m)).alias("counts"))


@query("f20_rank_in", """
with top as (select question_id, tag_index, row_number() over (partition by question_id order by score_milli desc, tag_index) as rnk
             from fx_label_score),
lists as (select question_id, list(tag_index order by rnk) as topk from top where rnk <= 5 group by question_id),
truth as (select qt.question_id, t.tag_index from fx_question_tag qt join fx_tag t on t.name = qt.tag)
select tr.question_id, tr.tag_index, coalesce(list_position(l.topk, tr.tag_index), 0) as rank
from truth tr join lists l on l.question_id = tr.question_id""")
def f20_rank_in(fx):
    """rank of each true label inside the question's top-5 list (0 when absent)."""
    from tagstream.operators.quality import topk_labels

    top = topk_labels(fx.label_score, 5, score="score_milli")
    lists = top.groupBy("question_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag_index"))), lambda s: s["tag_index"]).alias("topk"))
    truth = fx.question_tag.join(fx.tag, F.col("name") == F.col("tag")).select("question_id", "tag_index")
    return truth.join(lists, "question_id").select("question_id", "tag_index",
                                                   S.rank_in("topk", F.col("tag_index")).cast("bigint").alias("rank"))


@query("f21_row_key", """
select question_id, learner, md5(concat_ws(chr(1), learner, cast(question_id as varchar))) as row_key from fx_result""")
def f21_row_key(fx):
    r = fx.result
    return r.select("question_id", "learner", S.row_key("learner", "question_id").alias("row_key"))
