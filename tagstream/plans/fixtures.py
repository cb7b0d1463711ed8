"""Fixture views (FIXTURES.md §3) derived from the driver tables.

The Spark side builds each view with the DataFrame API; ``FIXTURE_SQL`` holds the same view as
DuckDB SQL for the oracle, where it is inlined as a CTE.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagstream.functions.text import combined_text
from tagstream.operators.indexing import assign_index
from tagstream.session import dimension, maybe_broadcast, text_partitions
from tagstream.sources.tables import Tables


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.t = Tables(spark, sf_dir)

    @cached_property
    def question(self) -> DataFrame:
        # texts come in partitions of bounded size: whatever counts their words works on these
        d, e = self.t.documents, self.t.events
        d = d.repartition(text_partitions(d, "text"), "doc_id")
        return d.join(e, e.event_id == d.doc_id).select(
            d.doc_id.alias("question_id"),
            F.split_part(d.text, F.lit("\n"), F.lit(1)).alias("title"),
            d.text.alias("body"),
            e.ts.alias("created_on"),
        )

    @cached_property
    def feature_text(self) -> DataFrame:
        """The text that a question's features are made from (title and visible body)."""
        return self.question.select("question_id", combined_text("title", "body").alias("text"))

    @cached_property
    def question_tag(self) -> DataFrame:
        d, lab = self.t.documents, self.t.labels
        parts = [
            d.select(F.col("doc_id").alias("question_id"), F.concat(F.lit("lang:"), "lang").alias("tag")),
            d.select(F.col("doc_id").alias("question_id"), F.concat(F.lit("src:"), "source").alias("tag")),
            lab.select(F.col("doc_id").alias("question_id"),
                       F.concat(F.lit("quality:"), F.col("quality").cast("string")).alias("tag")),
            lab.select(F.col("doc_id").alias("question_id"),
                       F.concat(F.lit("toxic:"), F.col("toxic").cast("string")).alias("tag")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.distinct()

    @cached_property
    def tag(self) -> DataFrame:
        names = self.question_tag.select(F.col("tag").alias("name")).distinct()
        return dimension(assign_index(names, "name", 0, out="tag_index").select("tag_index", "name"), "fx-tag")

    @cached_property
    def result(self) -> DataFrame:
        e = self.t.events
        fm = F.round(F.col("value") * 100).cast("bigint")
        k = F.trim(F.replace(F.replace(F.col("props"), F.lit('{"k":'), F.lit("")), F.lit("}"), F.lit("")))
        return e.select(
            F.concat(F.lit("L"), (F.col("user_id") % 4).cast("string")).alias("learner"),
            F.col("event_id").alias("question_id"),
            F.col("ts").alias("created_on"),
            fm.alias("fm_units"),
            (k.cast("bigint") * 500).alias("topk_units"),
            (fm % 997).alias("duration_us"),
            F.col("event_type").isin("click", "view").cast("int").alias("is_prequential"),
            (F.col("event_type") == "error").cast("int").alias("is_test"),
        )

    @cached_property
    def log(self) -> DataFrame:
        """Long metric log (T2): two rows per scored instance (derived view, not in FIXTURES.md)."""
        from tagstream.operators.aggregates import metric_events

        return metric_events(self.result)

    @cached_property
    def prediction(self) -> DataFrame:
        q, t = self.question, self.question_tag
        return q.join(t, t.question_id == q.question_id + 1).select(q.question_id, t.tag)

    @cached_property
    def vote(self) -> DataFrame:
        q = self.question.select("question_id").withColumn("member", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])))
        t = self.question_tag.withColumnRenamed("question_id", "tq")
        return q.join(t, t.tq == q.question_id + q.member).select("question_id", "member", "tag")

    @cached_property
    def score(self) -> DataFrame:
        lab, d = self.t.labels, self.t.documents
        return lab.join(d, "doc_id").select(
            F.col("doc_id").alias("question_id"),
            (F.col("n_chars") % 1000).cast("int").alias("score_milli"),
            F.col("quality").alias("y"),
        )

    @cached_property
    def label_score(self) -> DataFrame:
        # candidate labels of a question: its own tags and those of the next two questions
        near = self.question.select("question_id", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("_d"))
        tags = self.question_tag.select(F.col("question_id").alias("_of"), "tag")
        c = near.join(tags, F.col("_of") == F.col("question_id") + F.col("_d")).join(maybe_broadcast(self.tag), F.col("name") == F.col("tag"))
        return c.select("question_id", "tag_index").distinct().select(
            "question_id",
            "tag_index",
            ((F.col("question_id") * 7919 + F.col("tag_index") * 104729) % 1000).cast("int").alias("score_milli"),
        )

    @cached_property
    def learner(self) -> DataFrame:
        u = self.t.events.select("user_id").distinct()
        p = u.select(F.col("user_id").alias("p_user"))
        j = u.join(
            p,
            (p.p_user == F.floor(u.user_id / F.lit(4.0)).cast("bigint")) & (p.p_user != u.user_id),
            "left",
        )
        return j.select(
            F.concat(F.lit("L"), F.col("user_id").cast("string")).alias("learner_id"),
            F.when(F.col("p_user").isNull(), F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("L"), F.col("p_user").cast("string")))
            .alias("parent_id"),
            F.when(F.col("user_id") % 10 == 0, 0).otherwise(1).cast("int").alias("is_active"),
        )

    @cached_property
    def header(self) -> DataFrame:
        d = self.t.documents
        idv = self.spark.range(1).select(F.lit(0).alias("attr_index"), F.lit("QuestionId").alias("name"))
        feats = d.select(
            (F.lit(1) + F.col("n_chars") % 16).cast("int").alias("attr_index"),
            F.concat(F.lit("f"), (F.lit(1) + F.col("n_chars") % 16).cast("string")).alias("name"),
        ).distinct()
        labs = self.tag.select((F.lit(17) + F.col("tag_index")).cast("int").alias("attr_index"),
                               F.concat(F.lit("L_"), F.col("name")).alias("name"))
        return idv.unionByName(feats).unionByName(labs)

    @cached_property
    def sparse(self) -> DataFrame:
        d = self.t.documents
        feats = d.select(
            F.col("doc_id").alias("question_id"),
            (F.lit(1) + F.col("n_chars") % 16).cast("int").alias("attr_index"),
            F.col("n_chars").alias("val"),
        )
        labs = self.question_tag.join(maybe_broadcast(self.tag), F.col("name") == F.col("tag")).select(
            "question_id", (F.lit(17) + F.col("tag_index")).cast("int").alias("attr_index"), F.lit(1).cast("bigint").alias("val")
        )
        return feats.unionByName(labs)


# --- the same views as DuckDB SQL (fixed text from FIXTURES.md §3) --------------------------------
FIXTURE_SQL: dict[str, str] = {
    "fx_question": """select d.doc_id as question_id, split_part(d.text, chr(10), 1) as title, d.text as body, e.ts as created_on
from documents d join events e on e.event_id = d.doc_id""",
    "fx_question_tag": """select doc_id as question_id, concat('lang:', lang) as tag from documents
union select doc_id, concat('src:', source) from documents
union select doc_id, concat('quality:', cast(quality as varchar(4))) from labels
union select doc_id, concat('toxic:', cast(toxic as varchar(4))) from labels""",
    "fx_tag": """select cast(row_number() over (order by tag) - 1 as int) as tag_index, tag as name
from (select distinct tag from fx_question_tag) t""",
    "fx_result": """select concat('L', cast(user_id % 4 as varchar(4))) as learner, event_id as question_id, ts as created_on,
       cast(round(value*100) as bigint) as fm_units,
       cast(trim(replace(replace(props, '{"k":', ''), '}', '')) as bigint) * 500 as topk_units,
       cast(round(value*100) as bigint) % 997 as duration_us,
       cast(case when event_type in ('click','view') then 1 else 0 end as int) as is_prequential,
       cast(case when event_type = 'error' then 1 else 0 end as int) as is_test
from events""",
    "fx_log": """select learner, question_id, created_on, is_prequential, is_test, duration_us, 0 as is_topk, fm_units as units from fx_result
union all select learner, question_id, created_on, is_prequential, is_test, duration_us, 1, topk_units from fx_result""",
    "fx_prediction": """select q.question_id, t.tag from fx_question q join fx_question_tag t on t.question_id = q.question_id + 1""",
    "fx_vote": """select q.question_id, m.member, t.tag from fx_question q
cross join (select 1 as member union all select 2 union all select 3) m
join fx_question_tag t on t.question_id = q.question_id + m.member""",
    "fx_score": """select l.doc_id as question_id, cast(d.n_chars % 1000 as int) as score_milli, l.quality as y
from labels l join documents d on d.doc_id = l.doc_id""",
    "fx_label_score": """select distinct q.question_id, t.tag_index, cast((q.question_id * 7919 + t.tag_index * 104729) % 1000 as int) as score_milli
from fx_question q cross join (select 0 as d union all select 1 union all select 2) n
join fx_question_tag qt on qt.question_id = q.question_id + n.d join fx_tag t on t.name = qt.tag""",
    "fx_learner": """select concat('L', cast(u.user_id as varchar(8))) as learner_id,
       case when p.user_id is null then null else concat('L', cast(p.user_id as varchar(8))) end as parent_id,
       cast(case when u.user_id % 10 = 0 then 0 else 1 end as int) as is_active
from (select distinct user_id from events) u
left join (select distinct user_id from events) p
  on p.user_id = cast(floor(u.user_id / 4.0) as bigint) and p.user_id <> u.user_id""",
    "fx_header": """select 0 as attr_index, 'QuestionId' as name
union all select distinct cast(1 + n_chars % 16 as int), concat('f', cast(1 + n_chars % 16 as varchar(4))) from documents
union all select cast(17 + tag_index as int), concat('L_', name) from fx_tag""",
    "fx_sparse": """select doc_id as question_id, cast(1 + n_chars % 16 as int) as attr_index, n_chars as val from documents
union all select qt.question_id, cast(17 + t.tag_index as int), cast(1 as bigint)
from fx_question_tag qt join fx_tag t on t.name = qt.tag""",
}

_FX_NAME = re.compile(r"\bfx_[a-z_]+\b")


def with_fixtures(sql: str) -> str:
    """Prefix ``sql`` with the CTEs of every fixture view it uses (dependencies first)."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in sorted(set(_FX_NAME.findall(FIXTURE_SQL[name]))):
            if dep != name:
                visit(dep)
        order.append(name)

    for n in sorted(set(_FX_NAME.findall(sql))):
        if n in FIXTURE_SQL:
            visit(n)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} as (\n{FIXTURE_SQL[n]}\n)" for n in order)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
