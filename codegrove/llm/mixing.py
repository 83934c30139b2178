r"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed into cells of source, language and topic. Raking scales the cells to one dimension's target marginals
after the other, round by round. A cell's ratio is its raked over its own tokens; documents are sampled by the ratio times
a factor, at most 1, that meets the token budget in expectation. What a cap at 1 leaves open is in the weight, so that
weighted tokens of the kept documents meet the targets in expectation.

Up to MAX_CELLS cells are raked on the driver, more by the same steps on tables.

Edge cases: a null text counts as empty; every document has one token, its end, besides its words; null source and
language are the value ''; targets default to the shares of the tokens raised to a power below 1; a target value without
documents is left out and the others are scaled; repeated rows are drawn alike; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, stored, table

MAX_CELLS = 200_000
ROUNDS = 12
BUDGET = 0.6
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
SEED = "mix"

SPACE = r"[ \t\n\x0B\f\r]+"
WORD = r"[^ \t\n\x0B\f\r]+"
#: A document's topic is its genre, told by shares of signs and by length.
TOPIC = """CASE WHEN 100 * n_bars >= n_words AND n_bars > 0 THEN 'table' WHEN 20 * n_digits >= n_words AND n_digits > 0 THEN 'figures'
 WHEN n_lines >= 5 AND n_words <= 12 * n_lines THEN 'list' WHEN n_words < 100 THEN 'note' WHEN n_words < 1000 THEN 'article' ELSE 'book' END"""


def _counts(g: str, esc: str) -> dict[str, str]:
    s, w = (x.replace("\\", esc) for x in (SPACE, WORD))
    return {
        "n_words": f"length(regexp_replace(regexp_replace(t, '{w}', 'x'{g}), '{s}', ''{g}))",
        "n_bars": "length(t) - length(replace(t, '|', ''))",
        "n_digits": f"length(t) - length(regexp_replace(t, '[0-9]', ''{g}))",
        "n_lines": "length(t) - length(replace(t, chr(10), ''))",
    }


def described(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns `also`, source, lang, topic and n_tokens of each row."""
    base = docs.select("doc_id", *also, F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("t"))
    counts = base.selectExpr("doc_id", *also, "source", "lang", *(f"{x} AS {k}" for k, x in _counts("", "\\\\").items()))
    return counts.selectExpr("doc_id", *also, "source", "lang", f"{TOPIC} AS topic", "CAST(n_words + 1 AS bigint) AS n_tokens")


def _targets(values: np.ndarray, tokens: np.ndarray, power: float, given: dict[str, float] | None) -> np.ndarray:
    """The target share of each value."""
    names, at = np.unique(values, return_inverse=True)
    sums = np.bincount(at, tokens)
    share = np.array([given.get(x, 0.0) for x in names]) if given else (sums / sums.sum()) ** power
    return (share / share.sum())[at]


def rake(cells: DataFrame, *, rounds: int = ROUNDS, powers: dict[str, float] = POWERS, targets: dict[str, dict[str, float]] | None = None, max_cells: int = MAX_CELLS) -> DataFrame:
    """Cells (the dimensions in `powers`, and tokens) with raked tokens w, whose sum is that of the tokens."""
    spark, dims, targets = cells.sparkSession, list(powers), targets or {}
    few = cells.limit(max_cells + 1).count() <= max_cells
    if few:
        got = cells.toPandas().sort_values(dims, ignore_index=True)
        tokens = got["tokens"].to_numpy(float)
        w, total = tokens.copy(), tokens.sum()
        aims = {d: _targets(got[d].to_numpy(str), tokens, powers[d], targets.get(d)) * total for d in dims if len(got)}
        groups = {d: np.unique(got[d].to_numpy(str), return_inverse=True)[1] for d in aims}
        for _ in range(rounds if len(got) else 0):
            for d in dims:
                w *= aims[d] / np.maximum(np.bincount(groups[d], w)[groups[d]], 1e-300)
        rows = [(*map(str, r), int(t), float(x)) for *r, t, x in zip(*(got[d] for d in dims), got["tokens"], w, strict=True)]
        return F.broadcast(spark.createDataFrame(rows, ", ".join(f"{d} string" for d in dims) + ", tokens long, w double"))
    total = float(cells.agg(F.sum("tokens")).first()[0])
    out = cells.withColumn("w", F.col("tokens").cast("double"))
    for d in dims:
        share = cells.groupBy(d).agg(F.sum("tokens").alias("s"))
        if d in targets:
            given = spark.createDataFrame([(k, float(v)) for k, v in targets[d].items()], f"{d} string, aim double")
            share = share.join(given, d, "left").select(d, F.coalesce("aim", F.lit(0.0)).alias("aim"))
        else:
            share = share.select(d, F.pow(F.col("s") / total, F.lit(powers[d])).alias("aim"))
        whole = share.agg(F.sum("aim")).first()[0]
        out = out.join(share.select(d, (F.col("aim") / whole * total).alias(f"_{d}")), d)
    out = stored(out, "cells")
    for _ in range(rounds):
        new = out
        for d in dims:
            sums = new.groupBy(d).agg(F.sum("w").alias("_s"))
            new = new.join(sums, d).withColumn("w", F.col("w") * F.col(f"_{d}") / F.greatest("_s", F.lit(1e-300))).drop("_s")
        new = stored(new, "cells")
        forget(out)
        out = new
    return out.select(*dims, "tokens", "w")


def _factor(cells: DataFrame, budget: float) -> float:
    """The factor f for which the sum of tokens * min(1, f * w / tokens) is the budget's share of all tokens, by bisection on sums over the cells."""
    total = cells.agg(F.sum("tokens").alias("t"), F.max(F.col("tokens") / F.col("w")).alias("m")).first()
    if not total["t"]:
        return 0.0
    low, high = 0.0, float(total["m"])
    if budget >= 1:
        return high
    for _ in range(8):
        steps = [low + (high - low) * k / 64 for k in range(65)]
        sums = cells.agg(*[F.sum(F.least(F.col("tokens").cast("double"), f * F.col("w"))).alias(f"f{k}") for k, f in enumerate(steps)]).first()
        k = next(k for k in range(64, -1, -1) if k == 0 or sums[k] <= budget * total["t"])
        low, high = steps[k], steps[min(k + 1, 64)]
    return low


def sampling(found: DataFrame, *, budget: float = BUDGET, rounds: int = ROUNDS, powers: dict[str, float] = POWERS, targets: dict[str, dict[str, float]] | None = None, max_cells: int = MAX_CELLS) -> DataFrame:
    """The probability and weight of each cell of found (stored, as in described())."""
    dims = list(powers)
    cells = rake(found.groupBy(dims).agg(F.sum("n_tokens").alias("tokens")), rounds=rounds, powers=powers, targets=targets, max_cells=max_cells)
    f = _factor(cells, budget)
    ratio = F.col("w") / F.col("tokens")
    p = F.round(F.least(F.lit(1.0), f * ratio), 6)
    return cells.select(*dims, p.alias("probability"), F.when(p > 0, F.round(ratio / p, 4)).otherwise(0.0).alias("weight"))


def draw() -> Column:
    """A number from 0 to 1 of a row's doc_id."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":" + SEED))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def mix(docs: DataFrame, *, budget: float = BUDGET, rounds: int = ROUNDS, powers: dict[str, float] = POWERS, targets: dict[str, dict[str, float]] | None = None, max_cells: int = MAX_CELLS) -> DataFrame:
    """Documents as in described(), each with its probability, weight and whether it is kept."""
    found = stored(docs, "described")
    dims = list(powers)
    cells = sampling(found, budget=budget, rounds=rounds, powers=powers, targets=targets, max_cells=max_cells)
    return found.join(cells, dims).select("doc_id", *dims, "n_tokens", "probability", "weight", (draw() < F.col("probability")).alias("kept"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(described(table(spark, sf_dir, "documents")))


#: The pipeline's stage keeps more than a mix from raw sources would.
STAGE_BUDGET = 0.9


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the sampled rows. Each row has the probability of its own cell; rows of one doc_id, or without one, share a draw.
    The texts are read once more and not moved, unless there are too many cells to be sent to every task."""
    cells = sampling(stored(described(docs), "described"), budget=STAGE_BUDGET)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).select("row", *[F.col(f"row.{c}").alias(c) for c in ("doc_id", "source", "lang", "text")])
    mixed = described(rows, ("row",)).join(cells, list(POWERS))
    return mixed.where(draw() < F.col("probability")).select("row.*")


def oracle(budget: float = BUDGET) -> str:
    dims = list(POWERS)
    steps, last = [], "c0"
    for r in range(ROUNDS):
        for k, d in enumerate(dims):
            name = f"c{r * len(dims) + k + 1}"
            steps.append(f"{name} AS MATERIALIZED (SELECT source, lang, topic, tokens, a_source, a_lang, a_topic, w * a_{d} / sum(w) OVER (PARTITION BY {d}) AS w FROM {last})")
            last = name
    aims = ", ".join(f"a{d} AS (SELECT {d}, power(sum(tokens) / (SELECT sum(tokens) FROM cells), {p}) AS x FROM cells GROUP BY {d})" for d, p in POWERS.items())
    scaled = ", ".join(f"x{d}.x / (SELECT sum(x) FROM a{d}) * (SELECT sum(tokens) FROM cells) AS a_{d}" for d in dims)
    joins = " ".join(f"JOIN a{d} AS x{d} USING ({d})" for d in dims)
    return f"""
WITH base AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
counts AS (SELECT doc_id, source, lang, {", ".join(f"{x} AS {k}" for k, x in _counts(", 'g'", chr(92)).items())} FROM base),
found AS MATERIALIZED (SELECT doc_id, source, lang, {TOPIC} AS topic, CAST(n_words + 1 AS bigint) AS n_tokens FROM counts),
cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS double) AS tokens FROM found GROUP BY ALL),
{aims},
c0 AS MATERIALIZED (SELECT cells.*, {scaled}, tokens AS w FROM cells {joins}),
{", ".join(steps)},
sorted AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY w / tokens DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(w) OVER (ORDER BY w / tokens DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {last}),
tried AS (SELECT ({budget} * (SELECT sum(tokens) FROM cells) - capped) / rest AS f, w / tokens AS ratio FROM sorted),
factor AS (SELECT max(f) FILTER (f * ratio <= 1) AS f FROM tried),
drawn AS (SELECT source, lang, topic, round(least(1.0, f * w / tokens), 6) AS probability, w / tokens AS ratio FROM {last}, factor)
SELECT doc_id, source, lang, topic, n_tokens, probability, CASE WHEN probability > 0 THEN round(ratio / probability, 4) ELSE 0 END AS weight,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS varchar), '') || ':{SEED}'), 1, 8) AS bigint) / 4294967296.0 < probability AS kept
FROM found JOIN drawn USING (source, lang, topic)
"""
