"""Quality rules with risk-controlled thresholds.

Each rule gives a document a score from 0 to 1, the worse the higher, in BUCKETS steps. Labelled documents
are the holdout: in each stratum, for each rule, every cutoff is a hypothesis 'it rejects more than a share
risk of the good documents'. Cutoffs are tested from the most lenient one on, each by the exact binomial
tail of the good documents it rejects (the Clopper-Pearson bound), and testing stops at the first that can't
be rejected; so one level serves all cutoffs of a rule. Bonferroni over rules and strata corrects the rest:
with probability 1 - DELTA no stratum loses more than RISK of its good documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import materialize

#: False rejections of a stratum at most, over all rules together; probability that any stratum has more.
RISK, DELTA = 0.02, 0.05
BUCKETS = 100

#: Score of a text by rule: (Spark SQL, DuckDB SQL); n is the length of the text, never 0.
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("length(regexp_replace(text, '[^#$%&*|<>{}=~^_@]+', '')) / n", "length(regexp_replace(text, '[^#$%&*|<>{}=~^_@]+', '', 'g')) / n"),
    "capitals": ("length(regexp_replace(text, '[^\\\\p{Lu}]+', '')) / n", r"length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) / n"),
    "digits": ("length(regexp_replace(text, '[^0-9]+', '')) / n", "length(regexp_replace(text, '[^0-9]+', '', 'g')) / n"),
    "lines": ("1 - size(array_distinct(split(text, '\\n'))) / size(split(text, '\\n'))", r"1 - len(list_distinct(string_split(text, chr(10)))) / len(string_split(text, chr(10)))"),
    "repeats": ("1 - size(array_distinct(split(lower(text), ' '))) / size(split(text, ' '))", "1 - len(list_distinct(string_split(lower(text), ' '))) / len(string_split(text, ' '))"),
    "marks": ("length(regexp_replace(text, '[^!?]+', '')) / n", "length(regexp_replace(text, '[^!?]+', '', 'g')) / n"),
}


def most_rejections(n: int, risk: float, level: float) -> int:
    """The largest k with P(Binomial(n, risk) <= k) <= level; -1 if there is none."""
    if n <= 0 or not 0 < risk < 1:
        return -1
    log_p, log_q = np.log(risk), np.log1p(-risk)
    term, total, k = n * log_q, -np.inf, -1
    while k + 1 <= n:
        total = np.logaddexp(total, term)
        if total > np.log(level):
            return k
        k += 1
        term += np.log(n - k) - np.log(k + 1) + log_p - log_q if k < n else -np.inf
    return k


def rule_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, stratum, one bucket from 0 to BUCKETS for each rule); an empty or null text has 0 everywhere, a null lang is the stratum ''."""
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("stratum"), docs["text"].alias("text")).withColumn("n", F.length("text"))
    return own.select("doc_id", "stratum", *[F.when(F.col("n") > 0, F.floor(F.expr(s) * BUCKETS)).otherwise(0).cast("int").alias(k) for k, (s, _) in RULES.items()])


def cutoffs(scores: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff, good, rejected): the strictest safe cutoff, rejecting buckets from it on; rules without a safe one don't appear.

    good and rejected count the stratum's holdout. Labels that repeat a doc_id count each; null ones don't.
    """
    own = holdout_cutoffs(scores, labels, risk, delta).where("room >= 0")
    return own.select("stratum", "rule", "cutoff", "good", "rejected")


def holdout_cutoffs(scores: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, good, room, cutoff, rejected): room is how many of the good holdout a safe cutoff may reject, -1 if there are too few for any."""
    names = [c for c in scores.columns if c not in ("doc_id", "stratum")]
    good = labels.where(labels["quality"] == 1).select(labels["doc_id"].cast("long").alias("good_id"))
    held = scores.join(good, scores["doc_id"] == good["good_id"]).select("stratum", F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("bucket")) for c in names])).alias("x")).select("stratum", "x.*")
    counts = held.groupBy("stratum", "rule", "bucket").agg(F.count(F.lit(1)).alias("here"))
    strata = scores.select("stratum").distinct().agg(F.count(F.lit(1)).alias("strata"))
    up = Window.partitionBy("stratum", "rule").orderBy(F.desc("bucket"))  # at most BUCKETS + 1 rows
    tail = counts.select("stratum", "rule", "bucket", F.sum("here").over(up).alias("rejected"), F.sum("here").over(Window.partitionBy("stratum", "rule")).alias("good"))
    totals = tail.groupBy("stratum", "rule").agg(F.first("good").alias("good")).crossJoin(strata)  # strata is one row
    r = risk / len(names)

    @F.pandas_udf("long")
    def room(n: pd.Series, strata: pd.Series) -> pd.Series:
        return pd.Series([most_rejections(int(a), r, delta / (int(b) * len(names))) for a, b in zip(n, strata)], dtype="int64")

    totals = totals.select("stratum", "rule", "good", room("good", "strata").alias("room"))
    # a cutoff just above the first bucket from the top whose tail is too large; BUCKETS + 1 rejects nothing
    over = totals.join(tail.drop("good"), ["stratum", "rule"], "left").groupBy("stratum", "rule", "good", "room").agg(F.max(F.when(F.col("rejected") > F.col("room"), F.col("bucket"))).alias("b"), F.max(F.when(F.col("rejected") <= F.col("room"), F.col("rejected"))).alias("rejected"))
    return over.select("stratum", "rule", "good", "room", (F.coalesce("b", F.lit(-1)) + 1).cast("int").alias("cutoff"), F.coalesce("rejected", F.lit(0)).cast("long").alias("rejected"))


def labels_needed(risk: float, level: float) -> int:
    """The fewest good labels with which a cutoff that rejects none of them is safe."""
    return int(np.ceil(np.log(level) / np.log1p(-risk) - 1e-9))


def cutoff_report(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, good, tail, cutoff, rejected, needed) of every stratum that has a good label, and rule.

    tail: good labels of the highest score; needed: how many good labels a cutoff takes that rejects none; cutoff
    and rejected are null where the stratum has fewer.
    """
    scores = rule_scores(docs)
    own = holdout_cutoffs(scores, labels, risk, delta)
    strata = scores.select("stratum").distinct().agg(F.count(F.lit(1)).alias("strata"))  # one row
    good = labels.where(labels["quality"] == 1).select(labels["doc_id"].cast("long").alias("good_id"))
    tops = scores.join(good, scores["doc_id"] == good["good_id"]).select("stratum", F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("bucket")) for c in RULES])).alias("x")).groupBy("stratum", "x.rule").agg(F.max("x.bucket").alias("top"))
    needed = F.ceil(F.log(F.lit(delta) / (F.col("strata") * len(RULES))) / F.lit(float(np.log1p(-risk / len(RULES)))) - 1e-9).cast("long")
    safe = F.col("room") >= 0
    return own.join(tops, ["stratum", "rule"]).crossJoin(strata).select("stratum", "rule", "good", F.col("top").alias("tail"), F.when(safe, F.col("cutoff")).alias("cutoff"), F.when(safe, F.col("rejected")).alias("rejected"), needed.alias("needed"))


def risk_controlled(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(doc_id, stratum, one bucket for each rule) of the documents that no rule of their stratum rejects.

    Strata are languages. A stratum with too few labelled documents for a rule to be safe keeps all. Rows
    that repeat, with a null doc_id or with a null or empty text are judged like any other; an empty table
    gives no rows, empty labels reject nothing.
    """
    scores = materialize(rule_scores(docs), "scores")
    limits = cutoffs(scores, labels, risk, delta)
    wide = limits.groupBy(F.col("stratum").alias("limit_of")).agg(*[F.min(F.when(F.col("rule") == k, F.col("cutoff"))).alias(f"max_{k}") for k in RULES])
    fails = F.lit(False)
    for k in RULES:
        fails = fails | F.coalesce(F.col(k) >= F.col(f"max_{k}"), F.lit(False))
    # one row for each stratum, so the join adds no rows; the optimizer broadcasts it if it is small
    return scores.join(wide, F.col("stratum") == F.col("limit_of"), "left").where(~fails).select("doc_id", "stratum", *RULES)


def _sql(report: bool) -> str:
    score = ", ".join(f"case when length(text) > 0 then cast(floor(({d}) * {BUCKETS}) as integer) else 0 end as {k}" for k, (_, d) in RULES.items())
    held = " union all ".join(f"select s.stratum, '{k}' as rule, {k} as bucket from s join labels l on l.doc_id = s.doc_id and l.quality = 1" for k in RULES)
    fails = " or ".join(f"coalesce({k} >= (select min(cutoff) from lim where lim.stratum = s.stratum and rule = '{k}'), false)" for k in RULES)
    r = RISK / len(RULES)
    return f"""
with t as (select doc_id, coalesce(lang, '') stratum, text, length(text) n from documents),
s as (select doc_id, stratum, {score} from t),
h as ({held}),
c as (select stratum, rule, bucket, count(*) here from h group by 1, 2, 3),
tail as (select stratum, rule, bucket, cast(sum(here) over (partition by stratum, rule order by bucket desc) as bigint) k, cast(sum(here) over (partition by stratum, rule) as bigint) n from c),
m as (select count(distinct stratum) * {len(RULES)} m from s),
terms as (select *, lgamma(n + 1) lf from tail),
p as (select stratum, rule, bucket, list_sum(list_transform(range(0, k + 1), lambda i: exp(lf - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({r}::double) + (n - i) * ln(1 - {r}::double)))) cdf, pow(1 - {r}::double, n) none from terms),
lim as (select stratum, rule, coalesce(max(case when cdf > {DELTA} / m then bucket end), -1) + 1 as cutoff from p, m where none <= {DELTA} / m group by 1, 2)
""" + (f"""
select c.stratum, c.rule, cast(sum(here) as bigint) as good, max(bucket) as tail, any_value(lim.cutoff) as cutoff,
  case when any_value(lim.cutoff) is not null then cast(coalesce(sum(case when bucket >= lim.cutoff then here end), 0) as bigint) end as rejected, cast(ceil(ln({DELTA} / any_value(m)) / ln(1 - {r}::double) - 1e-9) as bigint) as needed
from c left join lim on lim.stratum = c.stratum and lim.rule = c.rule, m group by 1, 2
""" if report else f"""
select doc_id, stratum, {", ".join(RULES)} from s where not ({fails})
""")


SQL, REPORT_SQL = _sql(False), _sql(True)
