"""Quality classifier with hierarchical empirical Bayes.

Evidence of a document: integer counts over its whole text put it into one bin of each of a few features, and labelled
documents give each bin a log likelihood ratio (add-one counts; grouped sums over all labels, no sample). Sites: the
probabilities of a host's documents give its share of good ones, shrunk toward the global share by as much as hosts vary;
a path's share is shrunk toward its host's. A document's own probability is left out of its sites' sums. Quality is the
posterior from the path's share and the document's ratio.

Edge cases: a null text counts as empty; an empty text has bins of its own; null host and path are the sites ''; a label
without document or with a null quality counts nothing, repeated labels each count; without any label every document has
quality 0.5; repeated rows each count for their sites; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, stored, table

SCALE = 1_000_000
LEAST, MOST = 1.0, 10_000.0

#: Features: a name, the count, what it is a share of, and the bins' lower ends in thousandths.
FEATURES = [
    ("marks", "n_marks", "n_chars", [1, 5, 15, 40, 80]),
    ("upper", "n_upper", "n_chars", [150, 400, 700]),
    ("digits", "n_digits", "n_chars", [1, 10, 50, 200]),
    ("variety", "n_distinct", "n_words", [20, 50, 100, 200, 300, 400, 500, 700]),
    ("words", "n_words", "n_chars", [60, 120, 200, 260]),
]

#: Counts of a text, for Spark and for DuckDB ({g}: its flag for all matches; {split}: its function).
COUNTS = {
    "n_chars": "length(t)",
    "n_marks": "length(t) - length(regexp_replace(t, '[*$%&#!|<>{{}}_=~^]', ''{g}))",
    "n_upper": "length(t) - length(regexp_replace(t, '[A-Z]', ''{g}))",
    "n_digits": "length(t) - length(regexp_replace(t, '[0-9]', ''{g}))",
    "n_words": "{size}({split}(t, ' '))",
    "n_distinct": "{size}({distinct}({split}(t, ' ')))",
}
SPARK = {"g": "", "size": "size", "split": "split", "distinct": "array_distinct"}
DUCK = {"g": ", 'g'", "size": "len", "split": "string_split", "distinct": "list_distinct"}


def bin_sql(count: str, of: str, ends: list[int]) -> str:
    """The bin: -1 for an empty text, else how many ends are reached."""
    return f"CASE WHEN n_chars = 0 THEN -1 ELSE {' + '.join(f'CASE WHEN 1000 * CAST({count} AS bigint) >= {e} * CAST({of} AS bigint) THEN 1 ELSE 0 END' for e in ends)} END"


def features(docs: DataFrame, also: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `also`, host, path and the bin of each feature."""
    base = docs.select(*also, F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("t"))
    counts = base.selectExpr(*also, "host", "path", *(f"{x.format(**SPARK)} AS {k}" for k, x in COUNTS.items()))
    return counts.selectExpr(*also, "host", "path", *(f"{bin_sql(c, of, ends)} AS {name}" for name, c, of, ends in FEATURES))


def _logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


@dataclass
class Model:
    """What labels and sites say: a row's evidence and own probability (from its bins), and the sites' sums."""

    evidence: Column
    own: Column
    sites: DataFrame  # host, path, path_sum, path_n, host_sum, host_n
    mean: float
    host_strength: float
    path_strength: float
    rated: DataFrame  # doc_id, host, path, evidence, own of each row

    def rate(self, rows: DataFrame) -> DataFrame:
        """rows (host, path, evidence, own; others stay) with host_share, path_share and quality. Sites are sent to every task up to
        a checked number; beyond, rows are shuffled, and the engine splits hot sites."""
        own, a, b = F.col("own") / SCALE, self.host_strength, self.path_strength
        host_share = (a * self.mean + F.col("host_sum") / SCALE - own) / (a + F.col("host_n") - 1)
        path_share = (b * F.col("host_share") + F.col("path_sum") / SCALE - own) / (b + F.col("path_n") - 1)
        out = rows.join(few(self.sites), ["host", "path"]).withColumn("host_share", host_share).withColumn("path_share", path_share)
        quality = _sigmoid(F.col("evidence") + _logit(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("path_share")))))
        return out.withColumn("quality", F.round(quality, 6))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id, text, host, path. labels: doc_id, quality (0 or 1)."""
    found = stored(features(docs), "features")
    known = found.join(labels.where("quality is not null and doc_id is not null").select("doc_id", "quality"), "doc_id")
    # a few bins: bounded by FEATURES
    counts = known.select(F.explode(F.array(*[F.struct(F.lit(name).alias("feature"), F.col(name).alias("bin")) for name, *_ in FEATURES])).alias("f"), "quality")
    rows = counts.groupBy("f.feature", "f.bin").agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad")).collect()
    per = {name: {r["bin"]: (r["good"], r["bad"]) for r in rows if r["feature"] == name} for name, *_ in FEATURES}
    first = per[FEATURES[0][0]].values()
    good, bad = sum(x[0] for x in first), sum(x[1] for x in first)
    prior = (good + 1) / (good + bad + 2)

    def ratio(name: str, n: int) -> Column:
        at = {b: math.log((g + 1) / (good + n)) - math.log((d + 1) / (bad + n)) for b, (g, d) in per[name].items()}
        other = math.log(1 / (good + n)) - math.log(1 / (bad + n))
        out = F.lit(other)
        for b, v in at.items():
            out = F.when(F.col(name) == b, F.lit(v)).otherwise(out)
        return out

    evidence = sum((ratio(name, len(ends) + 2) for name, _, _, ends in FEATURES), F.lit(0.0))
    own = F.round(_sigmoid(evidence + math.log(prior / (1 - prior))) * SCALE).cast("long")
    rated = stored(found.select("doc_id", "host", "path", evidence.alias("evidence"), own.alias("own")), "rated")
    paths = rated.groupBy("host", "path").agg(F.sum("own").alias("path_sum"), F.count("*").alias("path_n"))
    hosts = paths.groupBy("host").agg(F.sum("path_sum").alias("host_sum"), F.sum("path_n").alias("host_n"))
    total = hosts.agg(F.sum("host_sum").alias("s"), F.sum("host_n").alias("n"), F.count("*").alias("k")).first()
    mean = total["s"] / SCALE / total["n"] if total["n"] else 0.5

    def strength(sites: DataFrame, s: str, n: str, center: Column) -> float:
        spread = F.pow(F.col(s) / SCALE / F.col(n) - center, 2)
        v = sites.agg((F.sum(F.col(n) * spread) / F.sum(n)).alias("v"), (F.sum(center * (1 - center)) / F.sum(n)).alias("noise"), (F.sum(F.col(n) * center * (1 - center)) / F.sum(n)).alias("w")).first()
        if v["v"] is None:
            return MOST
        between = v["v"] - v["noise"]
        return MOST if between <= 0 else min(MOST, max(LEAST, v["w"] / between - 1))

    a = strength(hosts, "host_sum", "host_n", F.lit(mean))
    hosts = hosts.withColumn("host_mean", (a * mean + F.col("host_sum") / SCALE) / (a + F.col("host_n")))
    both = stored(paths.join(hosts, "host"), "sites")
    b = strength(both, "path_sum", "path_n", F.col("host_mean"))
    return Model(evidence, own, both.drop("host_mean"), mean, a, b, rated)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, evidence (log likelihood ratio), host_share, path_share, quality (0 to 1) and good (quality of a half or more)."""
    model = learn(docs, labels)
    out = model.rate(model.rated)
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("evidence", "host_share", "path_share")], "quality", (F.col("quality") >= 0.5).alias("good"))


def _site(source: str, lang: str) -> tuple[Column, Column]:
    """documents have no address: the source is the host, source and language the path."""
    return F.col(source).alias("host"), F.concat_ws("/", F.coalesce(source, F.lit("")), F.coalesce(lang, F.lit(""))).alias("path")


def _sites(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", *_site("source", "lang"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_sites(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows whose quality is a half or more. Each row is judged by its own text and site, also without a doc_id and
    where rows share one; the texts are read once more and not moved."""
    model = learn(_sites(docs), table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = features(rows.select("row", F.col("row.text").alias("text"), *_site("row.source", "row.lang")), ("row",))
    rated = model.rate(rows.select("row", "host", "path", model.evidence.alias("evidence"), model.own.alias("own")))
    return rated.where("quality >= 0.5").select("row.*")


def oracle() -> str:
    n_bins = {name: len(ends) + 2 for name, _, _, ends in FEATURES}
    ratios = [f"(SELECT name, bin, ln((good + 1) / ((SELECT good FROM total) + n)) - ln((bad + 1) / ((SELECT bad FROM total) + n)) AS r FROM bins WHERE name = '{name}') AS {name}_r" for name in n_bins]
    return f"""
WITH base AS (SELECT doc_id, coalesce(source, '') AS host, concat_ws('/', coalesce(source, ''), coalesce(lang, '')) AS path, coalesce(text, '') AS t FROM documents),
counts AS (SELECT doc_id, host, path, {", ".join(f"{x.format(**DUCK)} AS {k}" for k, x in COUNTS.items())} FROM base),
found AS MATERIALIZED (SELECT doc_id, host, path, {", ".join(f"{bin_sql(c, of, ends)} AS {name}" for name, c, of, ends in FEATURES)} FROM counts),
known AS (SELECT found.*, quality FROM found JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
total AS MATERIALIZED (SELECT CAST(count(*) FILTER (quality = 1) AS double) AS good, CAST(count(*) FILTER (quality = 0) AS double) AS bad FROM known),
bins AS MATERIALIZED ({" UNION ALL ".join(f"SELECT '{name}' AS name, {name} AS bin, {n} AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad FROM known GROUP BY {name}" for name, n in n_bins.items())}),
evidenced AS (SELECT doc_id, host, path, {" + ".join(f"coalesce({name}_r.r, ln(1 / ((SELECT good FROM total) + {n})) - ln(1 / ((SELECT bad FROM total) + {n})))" for name, n in n_bins.items())} AS evidence
  FROM found {" ".join(f"LEFT JOIN {r} ON {name}_r.bin = found.{name}" for (name, _), r in zip(n_bins.items(), ratios, strict=True))}),
prior AS (SELECT (good + 1) / (good + bad + 2) AS p FROM total),
rated AS MATERIALIZED (SELECT doc_id, host, path, evidence, CAST(round(1 / (1 + exp(-(evidence + ln((SELECT p / (1 - p) FROM prior))))) * {SCALE}) AS bigint) AS own FROM evidenced),
paths AS (SELECT host, path, sum(own) / {SCALE} AS path_sum, count(*) AS path_n FROM rated GROUP BY host, path),
hosts AS (SELECT host, sum(own) / {SCALE} AS host_sum, count(*) AS host_n FROM rated GROUP BY host),
m AS (SELECT sum(host_sum) / sum(host_n) AS mean FROM hosts),
va AS (SELECT sum(host_n * power(host_sum / host_n - mean, 2)) / sum(host_n) - sum(mean * (1 - mean)) / sum(host_n) AS between_v, any_value(mean) * (1 - any_value(mean)) AS w FROM hosts, m),
sa AS (SELECT CASE WHEN between_v <= 0 THEN {MOST} ELSE least({MOST}, greatest({LEAST}, w / between_v - 1)) END AS a FROM va),
hm AS (SELECT hosts.*, (a * mean + host_sum) / (a + host_n) AS host_mean FROM hosts, m, sa),
both_levels AS (SELECT * FROM paths JOIN hm USING (host)),
vb AS (SELECT sum(path_n * power(path_sum / path_n - host_mean, 2)) / sum(path_n) - sum(host_mean * (1 - host_mean)) / sum(path_n) AS between_v, sum(path_n * host_mean * (1 - host_mean)) / sum(path_n) AS w FROM both_levels),
sb AS (SELECT CASE WHEN between_v <= 0 THEN {MOST} ELSE least({MOST}, greatest({LEAST}, w / between_v - 1)) END AS b FROM vb),
h AS (SELECT doc_id, evidence, own / {SCALE} AS p, path_sum, path_n, (a * mean + host_sum - own / {SCALE}) / (a + host_n - 1) AS host_share FROM rated JOIN both_levels USING (host, path), m, sa),
s AS (SELECT doc_id, evidence, host_share, (b * host_share + path_sum - p) / (b + path_n - 1) AS path_share FROM h, sb),
q AS (SELECT doc_id, evidence, host_share, path_share, round(1 / (1 + exp(-(evidence + ln(greatest(1e-6, least(1 - 1e-6, path_share)) / (1 - greatest(1e-6, least(1 - 1e-6, path_share))))))), 6) AS quality FROM s)
SELECT doc_id, round(evidence, 6) AS evidence, round(host_share, 6) AS host_share, round(path_share, 6) AS path_share, quality, quality >= 0.5 AS good FROM q
"""
