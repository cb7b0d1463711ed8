"""Label-tree queries: tree, node examples, training, scoring, prediction."""

from pyspark.sql import functions as F

from tagstream.operators import aggregates as A
from tagstream.operators import multilabel as ML
from tagstream.operators import packed as PK
from tagstream.operators import quality as Q
from tagstream.operators import relational as R
from tagstream.plans.q_text import TF_SQL
from tagstream.plans.registry import query
from tagstream.session import dimension

HD = 16384  # hashed dimension (the reference's smaller grid value)
K = 2  # branching factor of the single-tree setting
M14_BITS = 10  # rows of a block (as a power of two): the candidate scores of a question are few

_TREE_SQL = """params as (select count(*) as m from fx_tag),
lab as (select qt.question_id, t.tag_index + (select m - 1 from params) as node
        from fx_question_tag qt join fx_tag t on t.name = qt.tag),
anc(question_id, node) as (select question_id, node from lab
        union select question_id, (node - 1) // 2 from anc where node > 0),
kids as (select question_id, node * 2 + c as node from anc, (select 1 as c union all select 2) cc
         where node < (select m - 1 from params) and node * 2 + c < (select 2 * m - 1 from params)),
reached as (select question_id, node from kids union select question_id, 0 from fx_question),
ex as (select r.question_id, r.node, case when a.node is null then 0 else 1 end as y
       from reached r left join anc a on a.question_id = r.question_id and a.node = r.node)"""


def _labels(fx):
    return R.encode(fx.question_tag, fx.tag, "tag", name="name", index="tag_index", out="tag_index").select(
        "question_id", "tag_index")


def _features(fx, hd=HD):
    return ML.hash_features(A.term_frequencies(fx.feature_text, "text"), hd)


@query("m4_label_tree", """
with params as (select count(*) as m from fx_tag),
nodes as (select unnest(range(0, (select 2 * m - 1 from params))) as node)
select node, case when node = 0 then null else (node - 1) // 2 end as parent,
       cast(floor(log2(node + 1)) as int) as depth,
       cast(case when node >= (select m - 1 from params) then node - (select m - 1 from params) end as int) as tag_index
from nodes""")
def m4_label_tree(fx):
    """M4: complete binary tree over the tag vocabulary (k = 2: depth = ⌊log2(node + 1)⌋)."""
    return ML.label_tree(fx.tag, K)


@query("m5_node_examples", f"with recursive {_TREE_SQL} select question_id, node, y from ex")
def m5_node_examples(fx):
    tree = ML.label_tree(fx.tag, K)
    return ML.node_examples(_labels(fx), fx.question, tree, K)


_FEAT_SQL = f"""{TF_SQL},
feat as (select question_id, cast(cast(('0x' || substr(md5(term), 1, 8)) as bigint) % {HD} as int) as bucket,
                cast(sum(freq) as bigint) as value from tf group by question_id, bucket
         union all select question_id, -1, 1 from fx_question)"""


def _first_step_sql(rate: float) -> str:
    """w1: the weights after one step of this size from zero."""
    return f"""{_FEAT_SQL},
g as (select question_id, node, 0.5 - y as g from ex),
nn as (select node, count(*) as n_node from ex group by node),
gw as (select g.node, f.bucket, sum(g.g * f.value) as s from g join feat f on f.question_id = g.question_id
       group by g.node, f.bucket),
w1 as (select gw.node, gw.bucket, 0.0 - cast({rate!r} as double) * (gw.s / nn.n_node) as w from gw join nn on nn.node = gw.node)"""


def _examples(fx):
    """(tree, examples)."""
    tree = ML.label_tree(fx.tag, K)
    return tree, dimension(ML.node_examples(_labels(fx), fx.question, tree, K), "examples")


def _one_step(fx, rate: float):
    """(tree, packed questions, rows of each node, nodes, width, weights after one step from zero)."""
    tree, ex = _examples(fx)
    rows, n_node = PK.pack(_features(fx), fx.question, ex), dimension(ML.node_counts(ex), "node-counts")
    _, nodes, _ = ML.tree_params(tree)
    width = PK.width_of(rows)
    return tree, rows, n_node, nodes, width, PK.step(rows, n_node, None, nodes, rate, width)


@query("m6_gradient_step", f"with recursive {_TREE_SQL}, {_first_step_sql(1.0)} select node, bucket, w from w1")
def m6_gradient_step(fx):
    """M6, one epoch from zero weights (step size γ/(1 + λ·0) = 1): the SQL-checkable step
    (bucket −1 is the node bias)."""
    return _one_step(fx, 1.0)[-1]


#: Step size of the models that are checked beyond the first step: margins stay where σ is not flat.
RATE = 1e-5


@query("m6_second_step", f"""with recursive {_TREE_SQL}, {_first_step_sql(RATE)},
z as (select e.question_id, e.node, sum(w1.w * f.value) as z from ex e join feat f on f.question_id = e.question_id
      join w1 on w1.node = e.node and w1.bucket = f.bucket group by e.question_id, e.node),
g2 as (select e.question_id, e.node, 1 / (1 + exp(-coalesce(z.z, 0))) - e.y as g from ex e left join z on z.question_id = e.question_id and z.node = e.node),
d as (select g2.node, f.bucket, sum(g2.g * f.value) / any_value(nn.n_node) as d from g2 join feat f on f.question_id = g2.question_id
      join nn on nn.node = g2.node group by g2.node, f.bucket)
select w1.node, w1.bucket, round(1e5 * (w1.w - cast({RATE!r} as double) / 2 * d.d), 5) as w from w1 join d on d.node = w1.node and d.bucket = w1.bucket""")
def m6_second_step(fx):
    """M6, the second epoch (step size γ/(1 + λ·1)) from the weights of the first; w in units of 1e-5."""
    _, rows, n_node, nodes, width, w1 = _one_step(fx, RATE)
    w = PK.step(rows, n_node, dimension(w1, "weights"), nodes, RATE / 2, width)
    return w.select("node", "bucket", F.round(F.col("w") * 1e5, 5).alias("w"))


@query("m6_train_nodes")
def m6_train_nodes(fx):
    """M6: 30 epochs (the reference's fixed setting); rows-only (weights of every node)."""
    _, ex = _examples(fx)
    return ML.train_nodes(ex, _features(fx), fx.question, epochs=30)


_SCORES_SQL = f"""with recursive {_TREE_SQL}, {_first_step_sql(RATE)},
z as (select f.question_id, w1.node, sum(w1.w * f.value) as z from feat f join w1 on w1.bucket = f.bucket group by f.question_id, w1.node),
nodes as (select unnest(range(0, (select 2 * m - 1 from params))) as node),
lp as (select q.question_id, n.node, ln(greatest(1 / (1 + exp(-coalesce(z.z, 0))), 1e-300)) as lp
       from fx_question q cross join nodes n left join z on z.question_id = q.question_id and z.node = n.node),
path(question_id, node, lp) as (select question_id, node, lp from lp where node = 0
       union all select l.question_id, l.node, p.lp + l.lp from path p join lp l on l.question_id = p.question_id
       and l.node in (2 * p.node + 1, 2 * p.node + 2)),
scores as (select question_id, cast(node - (select m - 1 from params) as int) as tag_index, exp(lp) as prob
           from path where node >= (select m - 1 from params))"""
#: Probability from which m9 returns labels.
CUT = 0.02


@query("m9_score_labels", f"{_SCORES_SQL} select question_id, tag_index, round(prob, 6) as prob from scores where prob >= {CUT}")
def m9_score_labels(fx):
    """M9: the labels of every question with a path probability of at least ``CUT``, by the model of one step."""
    tree, rows, _, nodes, width, w = _one_step(fx, RATE)
    internal, _, _ = ML.tree_params(tree)
    found = PK.search_labels(rows, dimension(w, "weights"), internal, nodes, K, 0, CUT, width)
    return found.select("question_id", "tag_index", F.round("prob", 6).alias("prob"))


@query("m20_predict", f"""{_SCORES_SQL},
ranked as (select s.question_id, t.name, s.prob, row_number() over (partition by s.question_id order by s.prob desc, s.tag_index) as r
           from scores s join fx_tag t on t.tag_index = s.tag_index)
select question_id, coalesce(list(name order by name) filter (prob >= 0.5), []) as general, list(name order by r) filter (r <= 5) as topk
from ranked group by question_id""")
def m20_predict(fx):
    """General set (probability ≥ 0.5) and ranked top-5 set per question, decoded, by the model of one step."""
    tree, _, _, _, _, w = _one_step(fx, RATE)
    return ML.predict(fx.question, _features(fx), dimension(w, "weights"), tree, fx.tag, K, k=5, threshold=0.5)


THRESHOLD_SQL = """with recursive s as (
  select ls.tag_index, ls.question_id, ls.score_milli / cast(1000 as double) as score, case when qt.tag is null then 0 else 1 end as y,
         row_number() over (partition by ls.tag_index order by ls.question_id) as i
  from fx_label_score ls join fx_tag t on t.tag_index = ls.tag_index
  left join fx_question_tag qt on qt.question_id = ls.question_id and qt.tag = t.name),
steps(tag_index, i, a, b, question_id, score, y, threshold, y_hat) as (
  select distinct tag_index, cast(0 as bigint), cast(1 as bigint), cast(2 as bigint), cast(null as bigint), cast(null as double), 0, cast(null as double), 0 from s
  union all
  select tag_index, i, a + y * y_hat, b + y + y_hat, question_id, score, y, threshold, y_hat
  from (select s.tag_index, s.i, p.a, p.b, s.question_id, s.score, s.y, cast(p.a as double) / p.b as threshold,
          case when s.score >= cast(p.a as double) / p.b then 1 else 0 end as y_hat
        from steps p join s on s.tag_index = p.tag_index and s.i = p.i + 1) x)
select tag_index, question_id, score, y, threshold, y_hat from steps where i > 0"""


def scored_labels(fx):
    """(tag_index, question_id, score, y) of every candidate label."""
    truth = fx.question_tag.join(fx.tag, F.col("name") == F.col("tag")).select("question_id", "tag_index", F.lit(1).alias("y"))
    return fx.label_score.join(truth, ["question_id", "tag_index"], "left").select(
        "tag_index", "question_id", (F.col("score_milli") / F.lit(1000.0)).alias("score"), F.coalesce("y", F.lit(0)).alias("y"))


@query("m14_online_thresholds", THRESHOLD_SQL)
def m14_online_thresholds(fx):
    """M14 batch replay over every (label, question) score in question order, by blocks."""
    from tagstream.operators.thresholds import thresholds

    return thresholds(scored_labels(fx), bits=M14_BITS)


@query("m17_prequential")
def m17_prequential(fx):
    """Prequential replay of every question in batches of 500, one epoch per batch
    (rows-only: two phases × two kinds per question)."""
    from tagstream.session import scratch_path
    from tagstream.streaming.prequential import prequential_replay

    tree = ML.label_tree(fx.tag, K)
    root = scratch_path(fx.spark, "prequential")
    return prequential_replay(fx.question.join(fx.feature_text, "question_id"), _labels(fx), tree, root, "PLT", 500, hd=HD, k_tree=K, epochs=1)
