"""Filters, joins, set operations, writes and loads over the question / tag / learner views."""

from pyspark.sql import functions as F

from tagstream.operators import relational as R
from tagstream.operators.aggregates import max_created
from tagstream.operators.indexing import assign_index
from tagstream.operators.windows import newest_n, prefix_aggregate
from tagstream.plans.registry import query


@query("p3_by_key", """
select * from fx_question where question_id = (select max(question_id) from fx_question)""")
def p3_by_key(fx):
    """Key lookup; the key is the newest id, a scalar subquery over the table."""
    q = fx.question
    return R.by_key(q, "question_id", q.agg(F.max("question_id")).scalar())


@query("p4_by_names", """
select * from fx_tag where name in (select distinct concat('quality:', cast(quality as varchar(4))) from labels)""")
def p4_by_names(fx):
    names = fx.t.labels.select(F.concat(F.lit("quality:"), F.col("quality").cast("string")).alias("name"))
    return R.by_names(fx.tag, names)


@query("p5_by_indices", """
select * from fx_tag where tag_index in (select attr_index - 17 from fx_sparse where attr_index >= 17)""")
def p5_by_indices(fx):
    idx = fx.sparse.filter(F.col("attr_index") >= 17).select((F.col("attr_index") - 17).alias("tag_index"))
    return R.by_indices(fx.tag, idx)


@query("p7_featurised", """
select question_id, title, 1 as is_featurised from fx_question where question_id in (select doc_id from labels)
union all
select question_id, title, 0 from fx_question where question_id not in (select doc_id from labels)""")
def p7_featurised(fx):
    """Split into featurised (a ``labels`` row exists) and not."""
    feats = fx.t.labels.select(F.col("doc_id").alias("question_id"))
    done, todo = R.split_featurised(fx.question.select("question_id", "title"), feats)
    return done.withColumn("is_featurised", F.lit(1)).unionByName(todo.withColumn("is_featurised", F.lit(0)))


@query("p8_classify_columns", """
select attr_index, name, case when attr_index = (select min(attr_index) from fx_header) then 'id'
  when starts_with(name, 'L_') then 'label' else 'feature' end as role
from fx_header""")
def p8_classify_columns(fx):
    return R.classify_columns(fx.header, "L_")


@query("p9_split_sparse", """
select question_id, case when attr_index >= 17 then 'label' else 'feature' end as kind,
       cast(case when attr_index >= 17 then attr_index - 17 else attr_index end as int) as index, val as value
from fx_sparse where attr_index <> 0""")
def p9_split_sparse(fx):
    return R.split_sparse(fx.sparse, 17)


@query("p10_question_docs", """
select q.question_id, q.title,
       coalesce(list(struct_pack(index := t.tag_index, name := t.name) order by t.tag_index, t.name)
                filter (where t.tag_index is not null), []) as tags
from fx_question q left join fx_question_tag qt on qt.question_id = q.question_id
left join fx_tag t on t.name = qt.tag
group by q.question_id, q.title""")
def p10_question_docs(fx):
    return R.question_docs(fx.question, fx.question_tag, fx.tag)


@query("p11_to_questions", """
select q.question_id, q.title, q.body, q.created_on, coalesce(list_sort(list_distinct(list(qt.tag) filter (where qt.tag is not null))), []) as tags
from fx_question q left join fx_question_tag qt on qt.question_id = q.question_id
group by q.question_id, q.title, q.body, q.created_on""")
def p11_to_questions(fx):
    """Source records carry the tag names as a list (with repeats from the bridge)."""
    tags = fx.question_tag.groupBy("question_id").agg(F.collect_list("tag").alias("tags"))
    raw = fx.question.select("question_id", "title", "body", "created_on").join(tags, "question_id", "left")
    return R.to_questions(raw.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))))


@query("p12_assert_ids", """
select * from fx_result where question_id is null or question_id = 0""")
def p12_assert_ids(fx):
    return R.assert_ids(fx.result, "question_id")


@query("j1_unprocessed", """
select q.* from fx_question q
where not exists (select 1 from fx_result r where r.learner = 'L1' and r.question_id = q.question_id)
order by q.question_id limit 100""")
def j1_unprocessed(fx):
    """The next 100 questions learner L1 has not processed (the limit is the feature)."""
    return R.unprocessed(fx.question, fx.result, "L1", 100)


@query("j2_question_tags", """
select qt.question_id, t.tag_index, t.name from fx_question q
join fx_question_tag qt on qt.question_id = q.question_id join fx_tag t on t.name = qt.tag""")
def j2_question_tags(fx):
    return R.question_tags(fx.question, fx.question_tag, fx.tag)


@query("j4_encode", """
select qt.question_id, qt.tag, t.tag_index from fx_question_tag qt join fx_tag t on t.name = qt.tag""")
def j4_encode(fx):
    return R.encode(fx.question_tag, fx.tag, "tag", name="name", index="tag_index", out="tag_index")


@query("j4_encode_unmatched", """
select p.question_id, p.tag from fx_prediction p where p.tag not in (select name from fx_tag where starts_with(name, 'src:'))""")
def j4_encode_unmatched(fx):
    """Names missing from a (source-tag) vocabulary are reported."""
    vocab = fx.tag.filter(F.col("name").startswith("src:"))
    return R.encode_unmatched(fx.prediction, vocab, "tag")


@query("j7_learner_tree", """
with recursive lt(learner_id, root_id, depth) as (
  select learner_id, learner_id, 0 from fx_learner where parent_id is null
  union all
  select l.learner_id, t.root_id, t.depth + 1 from fx_learner l join lt t on l.parent_id = t.learner_id)
select learner_id, root_id, depth from lt""")
def j7_learner_tree(fx):
    return R.learner_tree(fx.learner)


@query("j8_fetch_or_store", """
with vocab as (select cast(row_number() over (order by tag) - 1 as int) as index, tag as name
               from (select distinct tag from fx_question_tag where starts_with(tag, 'lang:')) t),
new as (select distinct tag as name from fx_question_tag where tag not in (select name from vocab))
select index, name from vocab
union all
select cast((select count(*) from vocab) + row_number() over (order by name) - 1 as int), name from new""")
def j8_fetch_or_store(fx):
    """The vocabulary holds the language tags; every other tag is stored once, in name order."""
    vocab = assign_index(fx.question_tag.filter(F.col("tag").startswith("lang:")).select(
        F.col("tag").alias("name")).distinct(), "name", 0, out="index")
    return R.fetch_or_store(vocab, fx.question_tag.select(F.col("tag").alias("name")))


@query("u1_all_features", """
select question_id, tag, 'new' as origin from fx_prediction
union all select question_id, tag, 'stored' from fx_question_tag""")
def u1_all_features(fx):
    return R.all_features(fx.prediction.withColumn("origin", F.lit("new")),
                          fx.question_tag.withColumn("origin", F.lit("stored")))


@query("u4_names_minus", """
select distinct tag as name from fx_prediction
where tag not in (select name from fx_tag where starts_with(name, 'lang:'))""")
def u4_names_minus(fx):
    names = fx.prediction.select(F.col("tag").alias("name"))
    return R.names_minus(names, fx.tag.filter(F.col("name").startswith("lang:")).select("name"))


@query("u5_domain_equal", """
with seen as (select distinct cast(is_test as varchar) as v from fx_result),
dom as (select * from (values ('0'), ('1')) d(v))
select 'is_test' as "column",
       (select count(*) from seen where v not in (select v from dom)) as n_extra,
       (select count(*) from dom where v not in (select v from seen)) as n_missing,
       (select count(*) from seen where v not in (select v from dom)) = 0
         and (select count(*) from dom where v not in (select v from seen)) = 0 as is_equal""")
def u5_domain_equal(fx):
    return R.domain_equal(fx.result, "is_test", ["0", "1"])


@query("k1_append_rows", """
select question_id, title, created_on from fx_question where question_id not in (select doc_id from labels)
union all
select question_id, title, coalesce(case when question_id % 2 = 0 then null else created_on end,
                                    timestamp '2020-01-01 00:00:00') from fx_question
where question_id in (select doc_id from labels)""")
def k1_append_rows(fx):
    """K1: labelled questions arrive as a new batch, half of them without a creation time."""
    q = fx.question.select("question_id", "title", "created_on")
    lab = fx.t.labels.select(F.col("doc_id").alias("question_id"))
    base = q.join(lab, "question_id", "left_anti")
    new = q.join(lab, "question_id", "left_semi").withColumn(
        "created_on", F.when(F.col("question_id") % 2 == 0, F.lit(None)).otherwise(F.col("created_on")))
    return R.append_rows(base, new, F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"))


@query("k2_upsert", """
with u as (select question_id, title, created_on from fx_question
           union all
           select question_id, concat(title, ' (v2)'), created_on + interval 1 day from fx_question
           where question_id in (select doc_id from labels)),
r as (select *, row_number() over (partition by question_id order by created_on desc) as rn from u)
select question_id, title, created_on from r where rn = 1""")
def k2_upsert(fx):
    """K2: a newer version (a day later) of every labelled question replaces the stored row."""
    q = fx.question.select("question_id", "title", "created_on")
    delta = q.join(fx.t.labels.select(F.col("doc_id").alias("question_id")), "question_id", "left_semi").select(
        "question_id", F.concat("title", F.lit(" (v2)")).alias("title"),
        (F.col("created_on") + F.expr("INTERVAL 1 DAY")).alias("created_on"))
    return R.upsert(q, delta, "question_id", "created_on")


@query("k3_delete_keys", """
select * from fx_question where question_id not in (select doc_id from labels)""")
def k3_delete_keys(fx):
    return R.delete_keys(fx.question, fx.t.labels.select(F.col("doc_id").alias("question_id")), "question_id")


@query("k4_deactivate", """
select l.learner_id, l.parent_id,
       cast(case when l.parent_id is null then 0 else l.is_active end as int) as is_active
from fx_learner l""")
def k4_deactivate(fx):
    """K4: the root learners are discarded."""
    roots = fx.learner.filter(F.col("parent_id").isNull()).select("learner_id")
    return R.deactivate(fx.learner, roots)


@query("s1_load_since", """
select * from fx_question
where created_on >= (select coalesce(max(created_on), timestamp '1970-01-01') from fx_question
                     where created_on < (select min(created_on) from fx_question) + interval 12 hour)
                    + interval 1 second
  and created_on < timestamp '2100-01-01 00:00:00'""")
def s1_load_since(fx):
    """Questions newer than the high-water mark + 1 s of a sink holding the first 12 hours."""
    from tagstream.sources.loads import load_since

    q = fx.question
    sink = q.filter(F.col("created_on") < q.agg(F.min("created_on")).scalar() + F.expr("INTERVAL 12 HOURS"))
    return load_since(q, sink, "created_on", "2100-01-01 00:00:00")


@query("a6_max_created", "select coalesce(max(created_on), timestamp '1970-01-01 00:00:00') as max_created from fx_question")
def a6_max_created(fx):
    return max_created(fx.question)


@query("a5_total_count", "select count(*) as n from fx_question")
def a5_total_count(fx):
    from tagstream.operators.aggregates import total_count

    return total_count(fx.question)


@query("s3_next_page", """
select question_id, title, created_on from fx_question order by created_on, question_id offset 200 limit 100""")
def s3_next_page(fx):
    """S3: skip the 200 stored rows, take the next 100, oldest first."""
    from tagstream.sources.loads import next_page

    return next_page(fx.question.select("question_id", "title", "created_on"), 200, 100)


@query("s4_read_through", """
with keys as (select distinct question_id from fx_prediction),
local as (select question_id, title from fx_question where question_id in (select doc_id from labels))
select question_id, title, 'local' as origin from local where question_id in (select question_id from keys)
union all
select question_id, title, 'remote' from fx_question
where question_id in (select question_id from keys) and question_id not in (select question_id from local)""")
def s4_read_through(fx):
    """Labelled questions are stored locally, the rest is read from the full question table."""
    from tagstream.sources.loads import read_through

    q = fx.question.select("question_id", "title")
    local = q.join(fx.t.labels.select(F.col("doc_id").alias("question_id")), "question_id", "left_semi")
    keys = fx.prediction.select("question_id").distinct()
    return read_through(local, q, keys, "question_id")


@query("s13_retain_latest", """
with r as (select *, row_number() over (partition by learner order by created_on desc, question_id desc) as rn
           from fx_result where learner <> 'L3')
select learner, question_id, created_on from r where rn <= 20""")
def s13_retain_latest(fx):
    """The newest 20 model versions per learner; a discarded learner (L3) loses all."""
    from tagstream.sources.snapshots import retain_latest

    snaps = fx.result.select("learner", "question_id", "created_on")
    discarded = fx.result.filter(F.col("learner") == "L3").select("learner").distinct()
    return retain_latest(snaps, "learner", "created_on", 20, discarded, tiebreak="question_id")


@query("w8_newest_n", """
with r as (select *, row_number() over (partition by learner, is_prequential order by created_on desc, question_id desc) as rn
           from fx_result)
select learner, is_prequential, question_id, created_on from r where rn <= 5""")
def w8_newest_n(fx):
    d = fx.result.select("learner", "is_prequential", "question_id", "created_on")
    return newest_n(d, ["learner", "is_prequential"], "created_on", 5, tiebreak="question_id")


@query("t7_dedupe", """
with u as (select question_id, title, created_on from fx_question
           union all
           select question_id, title, created_on + interval 1 second from fx_question
           where question_id in (select doc_id from labels)),
r as (select *, row_number() over (partition by question_id order by created_on) as rn from u)
select question_id, title, created_on from r where rn = 1""")
def t7_dedupe(fx):
    """T7 batch form: labelled questions are fetched twice (overlapping slices, one second apart);
    the first arrival is kept."""
    from tagstream.streaming.ops import dedupe

    q = fx.question.select("question_id", "title", "created_on")
    again = q.join(fx.t.labels.select(F.col("doc_id").alias("question_id")), "question_id", "left_semi").withColumn(
        "created_on", F.col("created_on") + F.expr("INTERVAL 1 SECOND"))
    return dedupe(q.unionByName(again), "question_id", "created_on")


@query("t8_daily_counts", """
select date_trunc('day', created_on) as day_start, date_trunc('day', created_on) + interval 1 day as day_end,
       count(*) as n
from fx_question group by date_trunc('day', created_on)""")
def t8_daily_counts(fx):
    from tagstream.streaming.ops import daily_counts

    return daily_counts(fx.question, "created_on")


@query("t9_drop_custom", """
with r as (select *, case when question_id in (select question_id from fx_question) then 0 else 1 end as is_custom
           from fx_log)
select learner, question_id, is_topk, units from r where is_custom = 0""")
def t9_drop_custom(fx):
    """Instances with no stored question are ad hoc and never logged."""
    from tagstream.streaming.ops import drop_custom

    known = fx.question.select("question_id").withColumn("_known", F.lit(1))
    d = fx.log.join(known, "question_id", "left").withColumn("is_custom", F.col("_known").isNull().cast("int"))
    return drop_custom(d).select("learner", "question_id", "is_topk", "units")


@query("a7_batch_dims", """
select max(case when attr_index > 0 and attr_index < 17 then attr_index end) + 1 as n_features,
       max(case when attr_index >= 17 then attr_index - 17 end) + 1 as n_labels
from fx_sparse""")
def a7_batch_dims(fx):
    from tagstream.operators.aggregates import batch_dims

    return batch_dims(fx.sparse, 17)


@query("a8_dataset_dims", """
select (select count(*) from fx_header where starts_with(name, 'L_')) as n_labels,
       (select count(*) from fx_header) - (select count(*) from fx_header where starts_with(name, 'L_')) - 1 as n_features,
       (select count(distinct question_id) from fx_sparse) as n_instances""")
def a8_dataset_dims(fx):
    from tagstream.operators.aggregates import dataset_dims

    return dataset_dims(fx.header, fx.sparse, "L_")
