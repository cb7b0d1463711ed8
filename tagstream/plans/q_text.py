"""Text → features queries (F1–F5, P1, P2, A1, A2, J3, M1–M3) over whole texts."""

from pyspark.sql import functions as F

from tagstream.functions import porter as PS
from tagstream.functions import text as TX
from tagstream.functions.scalar import hash_bucket
from tagstream.operators import aggregates as A
from tagstream.operators import relational as R
from tagstream.operators.indexing import assign_index
from tagstream.plans.fixtures import FIXTURE_SQL
from tagstream.plans.registry import query
from tagstream.session import dimension

_STOP = ", ".join(f"'{w}'" for w in TX.ENGLISH_STOP_WORDS)
_STRIPPED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({x},
      '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'),
      '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'),
      '(?s)<!--.*?-->', ' ', 'g'),
      '<[^>]*>', ' ', 'g')"""
_NAMES = "map {" + ", ".join(f"'{n}': " + (f"'{c}'" if c != "'" else "chr(39)") for n, c in TX.entity_table().items()) + "}"
_REF = TX.REFERENCE
_NUMBER = f"""case when not regexp_matches(p, '{_REF}') or p[1] <> '#' then null
  when lower(p[2]) = 'x' then ('0x' || regexp_extract(p, '^#[xX]([0-9a-fA-F]+)', 1))::bigint else regexp_extract(p, '^#([0-9]+)', 1)::bigint end"""
_CHARS = f"""case when not regexp_matches(r.p, '{_REF}') then null when r.n is null then {_NAMES}[regexp_extract(r.p, '{_REF}', 1)]
  when r.n = 0 or r.n > 1114111 or r.n between 55296 and 57343 then chr(65533) when r.n = 160 then ' ' else chr(r.n::int) end"""
_DECODED = f"""list_transform(list_transform(string_split(s, '&')[2:], lambda p: {{'p': p, 'n': {_NUMBER}}}),
  lambda r: coalesce({_CHARS} || substr(r.p, strpos(r.p, ';') + 1), '&' || r.p))"""


def html_sql(x: str) -> str:
    """F1 of a column, character references by the same table as in Spark."""
    return f"""(select trim(regexp_replace(case when contains(s, '&') then string_split(s, '&')[1] || array_to_string({_DECODED}, '') else s end, '\\s+', ' ', 'g'))
  from (select {_STRIPPED.replace('{x}', x)} as s) one)"""


_TOKENS = r"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
_TERMS = "list_filter(" + _TOKENS + ", lambda t: not list_contains([" + _STOP.replace("{", "{{").replace("}", "}}") + "], t))"


def tokens_sql(x: str) -> str:
    return _TOKENS.format(x=x)


def terms_sql(x: str) -> str:
    return _TERMS.format(x=x)


FIXTURE_SQL["fx_feature_text"] = f"select question_id, concat_ws(' ', title, {html_sql('body')}) as text from fx_question"
TF_SQL = f"""tf as (select question_id, term, cast(count(*) as int) as freq
  from (select question_id, unnest({terms_sql('text')}) as term from fx_feature_text) x
  group by question_id, term)"""


@query("f1_html_text", f"select page_id, {html_sql('html')} as text from pages")
def f1_html_text(fx):
    return fx.t.pages.select("page_id", TX.html_text("html").alias("text"))


@query("f2_lower_text", "select question_id, lower(title) as title from fx_question")
def f2_lower_text(fx):
    return fx.question.select("question_id", TX.lower_text("title").alias("title"))


@query("f3_tokens", f"select question_id, {tokens_sql('body')} as tokens from fx_question")
def f3_tokens(fx):
    return fx.question.select("question_id", TX.tokens("body").alias("tokens"))


@query("f4_drop_stop", f"select question_id, {terms_sql('body')} as terms from fx_question")
def f4_drop_stop(fx):
    return fx.question.select("question_id", TX.drop_stop(TX.tokens("body")).alias("terms"))


@query("p1_combined", "select question_id, concat_ws(' ', title, body) as text from fx_question")
def p1_combined(fx):
    return fx.question.select("question_id", TX.combined("title", "body").alias("text"))


@query("p2_combined_text", f"select question_id, concat_ws(' ', title, {html_sql('body')}) as text from fx_question")
def p2_combined_text(fx):
    return fx.question.select("question_id", TX.combined_text("title", "body").alias("text"))


@query("a1_term_frequencies", f"with {TF_SQL} select * from tf")
def a1_term_frequencies(fx):
    return A.term_frequencies(fx.feature_text, "text")


@query("a2_vocabulary", f"with {TF_SQL} select distinct term as name from tf")
def a2_vocabulary(fx):
    t = A.term_tokens(fx.feature_text, "text")
    return A.vocabulary(t, "term")


@query("a2_tag_vocabulary", "select distinct tag as name from fx_question_tag")
def a2_tag_vocabulary(fx):
    return A.vocabulary(fx.question_tag, "tag")


def _term_index(fx):
    # stored features (the reference materialises them too): tokenise once, reuse for the
    # vocabulary and the encoding join
    tf = A.term_frequencies(fx.feature_text, "text").checkpoint(eager=True)
    terms = assign_index(tf.select(F.col("term").alias("name")).distinct(), "name", 0, out="term_index")
    return tf, dimension(terms, "terms")  # joined by its measured size


@query("j3_stored_features", f"""
with {TF_SQL},
terms as (select cast(row_number() over (order by term) - 1 as int) as term_index, term as name
          from (select distinct term from tf) t)
select tf.question_id,
       list(struct_pack(index := t.term_index, freq := tf.freq) order by t.term_index) as features
from tf join terms t on t.name = tf.term group by tf.question_id""")
def j3_stored_features(fx):
    """Stored (index, frequency) vectors of every question."""
    tf, terms = _term_index(fx)
    return R.stored_features(tf, terms)


@query("m1_feature_vectors", f"""
with {TF_SQL},
terms as (select cast(row_number() over (order by term) - 1 as int) as term_index, term as name
          from (select distinct term from tf) t)
select tf.question_id, t.term_index as index, tf.freq from tf join terms t on t.name = tf.term""")
def m1_feature_vectors(fx):
    """M1 long form (kept for training): (question, term index, frequency)."""
    tf, terms = _term_index(fx)
    return R.encode(tf, terms, "term", name="name", index="term_index", out="index").select(
        "question_id", "index", "freq")


@query("m2_hash_features", f"""
with {TF_SQL}
select question_id, cast(cast(('0x' || substr(md5(term), 1, 8)) as bigint) % 16384 as int) as bucket,
       cast(sum(freq) as bigint) as value
from tf group by question_id, bucket""")
def m2_hash_features(fx):
    from tagstream.operators.multilabel import hash_features

    return hash_features(A.term_frequencies(fx.feature_text, "text"), 16384)


@query("m3_label_vectors", """
select qt.question_id, list_sort(list(distinct t.tag_index)) as labels
from fx_question_tag qt join fx_tag t on t.name = qt.tag group by qt.question_id""")
def m3_label_vectors(fx):
    from tagstream.operators.multilabel import label_vectors

    return label_vectors(R.encode(fx.question_tag, fx.tag, "tag", name="name", index="tag_index", out="tag_index"))


def _marked(w: str) -> str:
    (first, y), (run, yy) = PS.MARKS
    return f"regexp_replace(regexp_replace({w}, '{first}', '\\1{y}', 'g'), '{run}', '{yy}', 'g')"


def _is(w: str, pattern: str) -> str:
    return f"regexp_matches({w}, '{pattern}')"


def _cut(n) -> str:
    return f"substr(w, 1, len(w) - {n})"


def _suffix_step(rules: list[tuple[str, str]], measure: str, guard: str = "true") -> str:
    """The longest suffix of the rules, replaced if its stem has the measure."""
    whens = " ".join(f"when suf = '{a}' then '{b}'" for a, b in rules)
    return f"""case when suf <> '' and {_is(_marked(_cut('len(suf)')), measure)} and {guard} then {_cut('len(suf)')} || case {whens} end else w end"""


_ED = f"case when w like '%ed' then {_cut(2)} when w like '%ing' then {_cut(3)} end"
_STEM_STEPS = [
    ("null", f"case when {_is('w', '(sses|ies)$')} then {_cut(2)} when w like '%s' and w not like '%ss' then {_cut(1)} else w end"),
    (_ED, f"""case when w like '%eed' then case when {_is(_marked(_cut(3)), PS.ONCE)} then {_cut(1)} else w end
      when suf is null or not {_is(_marked('suf'), PS.VOWEL)} then w
      when {_is('suf', '(at|bl|iz)$')} then suf || 'e'
      when len(suf) > 1 and right(suf, 1) = left(right(suf, 2), 1) and {_is(_marked('suf'), '[^aeiouylsz]$')} then left(suf, len(suf) - 1)
      when {_is(_marked('suf'), PS.ONCE)} and not {_is(_marked('suf'), PS.TWICE)} and {_is(_marked('suf'), PS.SHORT)} then suf || 'e' else suf end"""),
    ("null", f"case when w like '%y' and {_is(_marked(_cut(1)), PS.VOWEL)} then {_cut(1)} || 'i' else w end"),
    (f"regexp_extract(w, '{PS.ending([a for a, _ in PS._STEP2])}', 1)", _suffix_step(PS._STEP2, PS.ONCE)),
    (f"regexp_extract(w, '{PS.ending([a for a, _ in PS._STEP3])}', 1)", _suffix_step(PS._STEP3, PS.ONCE)),
    (f"regexp_extract(w, '{PS.ending(PS._STEP4)}', 1)",
     _suffix_step([(a, "") for a in PS._STEP4], PS.TWICE, f"(suf <> 'ion' or {_is(_cut('len(suf)'), '[st]$')})")),
    (_marked(_cut(1)), f"case when w like '%e' and ({_is('suf', PS.TWICE)} or ({_is('suf', PS.ONCE)} and not {_is('suf', PS.SHORT)})) then {_cut(1)} else w end"),
    ("null", f"case when w like '%ll' and {_is(_marked('w'), PS.TWICE)} then {_cut(1)} else w end"),
]
STEMS_SQL = "stem0 as (select distinct term, term as w from tf),\n" + ",\n".join(
    f"stem{k} as (select term, {step} as w from (select term, w, {suf} as suf from stem{k - 1}) x)" for k, (suf, step) in enumerate(_STEM_STEPS, 1))


@query("f5_stemmed_frequencies", f"""
with {TF_SQL},
{STEMS_SQL}
select question_id, case when len(term) <= 2 then term else w end as term, cast(sum(freq) as int) as freq
from tf join stem{len(_STEM_STEPS)} using (term) group by 1, 2""")
def f5_stemmed_frequencies(fx):
    """F5 (X1) + A1: stemmed term frequencies; the distinct vocabulary is stemmed by column expressions."""
    return A.term_frequencies(fx.feature_text, "text", stem=True)
