"""Scalar column functions (F6–F21).  All are built-in Spark expressions, so they stay inside
whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TS_TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"  # fixed value: result-file timestamp format


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def config_label(*cols, sep: str = "-") -> Column:
    """join values with a separator, e.g. ``hd-size-epochs-strategy``."""
    return F.concat_ws(sep, *[_c(c).cast("string") for c in cols])


def name_matches(c, prefix: str | None = None, suffix: str | None = None, text: str | None = None,
                 after_pos: int = 0) -> Column:
    """starts-with / ends-with / contains ``text`` at a 1-based position > ``after_pos``."""
    col = _c(c)
    cond = F.lit(True)
    if prefix is not None:
        cond = cond & col.startswith(prefix)
    if suffix is not None:
        cond = cond & col.endswith(suffix)
    if text is not None:
        cond = cond & (F.instr(col, text) > after_pos)
    return cond


def part_int(c, sep: str = "-", n: int = 2) -> Column:
    """F8: the n-th part (1-based) of ``c`` split on ``sep``, parsed as a base-10 int (null if not)."""
    return F.split_part(_c(c), F.lit(sep), F.lit(n)).try_cast("int")


def digits_label(c) -> Column:
    """remove letters and dots, case-insensitive."""
    return F.regexp_replace(_c(c), r"(?i)[a-z.]", "")


def add_seconds(ts, n: int) -> Column:
    return _c(ts) + F.make_dt_interval(secs=F.lit(n))


def end_of_day(ts) -> Column:
    """23:59:59 of the timestamp's (UTC) day."""
    c = _c(ts)
    return F.date_trunc("day", c).cast("timestamp_ntz") + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")


def day_window(ts, hard_end) -> tuple[Column, Column]:
    """(start, end) of the fetch window starting at ``ts``: end = the earlier of the day's
    23:59:59 and ``hard_end``."""
    return _c(ts), F.least(end_of_day(ts), _c(hard_end))


def month_start(d) -> Column:
    """first instant of the month (timestamp without time zone)."""
    return F.date_trunc("month", _c(d)).cast("timestamp_ntz")


def month_end(d) -> Column:
    return F.last_day(_c(d))


def next_month(d) -> Column:
    return F.add_months(F.to_date(month_start(d)), 1)


def ts_text(ts) -> Column:
    """timestamp → text with milliseconds."""
    return F.date_format(_c(ts), TS_TEXT_FORMAT)


def text_ts(s) -> Column:
    """text with milliseconds → timestamp without time zone."""
    return F.to_timestamp_ntz(_c(s), F.lit(TS_TEXT_FORMAT))


def epoch_s(ts) -> Column:
    """unix seconds (UTC)."""
    return F.unix_seconds(_c(ts).cast("timestamp"))


def percent2(f) -> Column:
    """percent with 2 decimals; null → 0."""
    return F.round(F.coalesce(_c(f), F.lit(0.0)) * 100, 2)


def page_no(total, size) -> Column:
    """F16: ⌊total / size⌋ + 1."""
    return (F.floor(_c(total) / _c(size)) + 1).cast("bigint")


def count_map(arr) -> Column:
    """element → count map of an array (merge of counts)."""
    a = _c(arr)
    keys = F.array_distinct(a)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.size(F.filter(a, lambda x: x == k))))


def rank_in(arr, x) -> Column:
    """1-based position of ``x`` in ``arr`` (0 when absent)."""
    return F.array_position(_c(arr), _c(x))


def row_key(*cols) -> Column:
    """repeatable row identity: md5 of the natural key (replaces random UUIDs)."""
    return F.md5(F.concat_ws("\u0001", *[_c(c).cast("string") for c in cols]))


def hash_bucket(term, hd: int) -> Column:
    """M2: bucket = first 8 hex digits of md5(term) as an unsigned int, mod ``hd``."""
    return F.pmod(F.conv(F.substring(F.md5(_c(term)), 1, 8), 16, 10).cast("bigint"), F.lit(hd)).cast("int")


def md5_fraction(*cols) -> Column:
    """Uniform [0, 1) value from md5 of the key (M18, A20): first 8 hex digits / 2^32."""
    h = F.md5(F.concat_ws("", *[_c(c).cast("string") for c in cols]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def config_value(json_col, path: str) -> Column:
    """value inside type-tagged JSON arrays (``[class, {...}]``), e.g.
    ``$[1].individualPLTConfiguration[1].hd``."""
    return F.get_json_object(_c(json_col), path)


# Known configuration keys per learner class, tried in this order.
CONFIG_CLASSES = (
    ("AdaptivePLT", ("epochs", "hd", "k", "toPreferHighestProbLeaf", "alpha")),
    ("PLTEnsembleBoosted", ("ensembleSize", "maxBranchingFactor", "minEpochs", "toAggregateByMajorityVote",
                            "individualPLTConfiguration")),
    ("PLTEnsembleBoostedWithThreshold", ("ensembleSize", "maxBranchingFactor", "minEpochs",
                                         "toAggregateByMajorityVote", "individualPLTConfiguration",
                                         "toAggregateByLambdaCW")),
    ("PLTAdaptiveEnsemble", ("epsilon", "minTraingInstances", "retainmentFraction", "ageFunction", "a", "c",
                             "individualPLTProperties")),
)


def config_class(json_col) -> Column:
    """the first class whose known keys contain every key of the JSON object (null if none)."""
    keys = F.json_object_keys(_c(json_col))
    expr = F.lit(None).cast("string")
    for name, known in reversed(CONFIG_CLASSES):
        fits = F.size(F.array_except(keys, F.array(*[F.lit(k) for k in known]))) == 0
        expr = F.when(keys.isNotNull() & fits, F.lit(name)).otherwise(expr)
    return expr
