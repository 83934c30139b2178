"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A document is a bag of weighted terms: its words, each weighing its count times its length. For each of K samples a term
gets a rate r and a level c, both Gamma(2, 1), and a shift b, uniform on [0, 1), all three from hashes of the term and the
sample's number. With t = floor(ln(weight) / r + b) the term's draw is ln(c) - r * (t - b + 1), and the sample is the
smallest draw, a number that tells the term and t. Two documents agree on a sample with a probability equal to their
generalised Jaccard similarity, the sum of the smaller over the sum of the larger weights. A fingerprint is 16 bits of each
sample's hash.

Most terms are the same few words as often in most documents. The draws of the commonest terms, a table of fixed size, are
worked out once and broadcast; those of all others are worked out where they occur, by the same expressions.

Rows with their next row's text are dealt once, by ranges of doc_id, finer than other shuffles; words are counted and a sample's
smallest draw is aggregated inside the parts, without another exchange.

Edge cases: null and wordless texts have the same fingerprint, that of an empty bag, and agree with each other only;
rows with the same doc_id follow each other by text; a null doc_id comes last; one row alone is its own next; a term is 48 bits
of a word's hash and the word's length, of which up to 65,535 count; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

SAMPLES = 64
#: Samples that a row of a term works out: few enough that the generated code is compiled.
BLOCK = 16
#: Terms whose draws are broadcast, at most (some 20 MB), and documents, about, in which they are counted. Neither changes a result.
COMMON, SAMPLE = 16_384, 10_000
SPACE = r"[\x20\x09-\x0D]+"


def _uniform(bits: str, low: int, n: int) -> str:
    """n bits of a hash as a number between 0 and 1."""
    return f"((shiftrightunsigned({bits}, {low}) & {(1 << n) - 1}L) + 0.5D) * {2.0**-n!r}D"


def rate(k: int) -> str:
    """The rate r of sample k of a row, in SQL, from g (hash of the term and the block)."""
    u = f"xxhash64(g ^ {2 * k}L)"
    return f"-ln({_uniform(u, 0, 32)} * {_uniform(u, 32, 32)})"


def draw(k: int) -> str:
    """A term's draw for sample k of a row, in SQL, from the row's r{k}, v{k} (a hash) and lw (ln of the weight)."""
    c, b = f"-ln({_uniform(f'v{k}', 0, 21)} * {_uniform(f'v{k}', 21, 21)})", f"{_uniform(f'v{k}', 42, 22)}"
    return f"ln({c}) - r{k} * (floor(lw / r{k} + {b}) - {b} + 1)"


def _blocks(terms: DataFrame, keys: list[str], samples: int) -> DataFrame:
    """Each term with each block of samples, g, and term, a hash of the three."""
    each = terms.select(*keys, "h", "n", F.explode(F.array(*map(F.lit, range(-(-samples // BLOCK))))).alias("block"))
    return each.select("*", F.xxhash64("h", "block").alias("g"), F.xxhash64("h", "n", "block").alias("term"))


_LW = "ln(n * (h & 65535L))"


def common_draws(terms: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """term, own (h, told apart from others of the same hash), and the draws m0, m1, ... of the commonest of the terms (h, n), by blocks."""
    counts = stored(terms.groupBy("h", "n").agg(F.count("*").alias("often")).where("often > 1"), "terms")
    # as many numbers of occurrences as there are: a few thousand rows
    rows = counts.groupBy("often").agg(F.count("*").alias("terms")).orderBy(F.desc("often")).collect()
    least, sum_ = None, 0
    for r in rows:
        sum_ += r["terms"]
        if sum_ > COMMON:
            break
        least = r["often"]
    few = counts.where(F.col("often") >= least if least is not None else F.lit(False))
    base = _blocks(few, [], samples).selectExpr("h", "n", "term", f"{_LW} AS lw", *(f"{rate(k)} AS r{k}" for k in range(BLOCK)), *(f"xxhash64(g ^ {2 * k + 1}L) AS v{k}" for k in range(BLOCK)))
    return base.selectExpr("term AS common", "h ^ n AS own", *(f"{draw(k)} AS m{k}" for k in range(BLOCK)))


#: Whose terms a row is: of a document's text, of its edited text, or of both.
OWN, EDITED, BOTH = 0, 1, 2


def prints(terms: DataFrame, keys: list[str], common: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """keys and the fingerprints print0 and print1 of the terms of texts (OWN and BOTH) and of edited ones (EDITED and BOTH): 4 hexadecimal digits a
    sample, null without words. From rows (keys, which, h, n); n is null in the one row of a document without words."""
    blocks, by, ks = -(-samples // BLOCK), [*keys, "which", "block"], range(BLOCK)
    rows = _blocks(terms, by[:-1], samples)
    # an inequality, lest it becomes a key of the join: one number is looked up faster
    apart = F.col("h").bitwiseXOR(F.col("n")).bitwiseXOR(F.col("own"))
    rows = rows.join(F.broadcast(common), (F.col("term") == F.col("common")) & (apart <= 0) & (apart >= 0), "left")
    new = "common IS NULL"
    rates = [f"CASE WHEN {new} THEN {rate(k)} ELSE 1.0D END AS r{k}" for k in ks]
    hashes = [f"CASE WHEN {new} THEN xxhash64(g ^ {2 * k + 1}L) ELSE 0L END AS v{k}" for k in ks]
    rows = rows.selectExpr(*by, "common", *(f"m{k}" for k in ks), f"CASE WHEN {new} THEN {_LW} END AS lw", *rates, *hashes)
    found = rows.groupBy(*by).agg(*[F.expr(f"min(CASE WHEN {new} THEN {draw(k)} ELSE m{k} END) AS s{k}") for k in ks])
    sides = ((0, OWN), (1, EDITED))
    found = found.groupBy(*keys, "block").agg(*[F.expr(f"min(CASE WHEN which IN ({w}, {BOTH}) THEN s{k} END) AS s{side}_{k}") for side, w in sides for k in ks])
    # 16 bits a sample, four samples a number
    code = lambda side, k: f"shiftleft(xxhash64(s{side}_{k}) & 65535L, {48 - 16 * (k % 4)})"
    parts = found.selectExpr(*keys, "block", *(f"CASE WHEN s{side}_{g} IS NOT NULL THEN {' | '.join(code(side, k) for k in range(g, g + 4))} END AS p{side}_{g // 4}" for side, _ in sides for g in range(0, BLOCK, 4)))
    each = [(b, g) for b in range(blocks) for g in range(BLOCK // 4)]
    whole = parts.groupBy(*keys).agg(*[F.expr(f"max(CASE WHEN block = {b} THEN p{side}_{g} END) AS d{side}_{b}_{g}") for side, _ in sides for b, g in each])
    text = lambda side: F.substring(F.lower(F.concat(*[F.lpad(F.hex(f"d{side}_{b}_{g}"), 16, "0") for b, g in each])), 1, 4 * samples)
    return whole.select(*keys, *[text(side).alias(f"print{side}") for side, _ in sides])


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """The share of samples that agree."""
    same = " + ".join(f"CASE WHEN substring({a}, {4 * k + 1}, 4) = substring({b}, {4 * k + 1}, 4) THEN 1 ELSE 0 END" for k in range(samples))
    return F.expr(f"({same}) / {samples}.0D")


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """part, row (its place in the part), lent, doc_id, text and next_text: the next row's by descending doc_id, the first one's for the last.

    Parts are ranges of doc_id. Each part is also lent the first row of the part behind it (of the first part for the
    last), so that one window over a part serves all its rows.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ends = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 100 * parts)).first()[0] or []
    ends = sorted(set(ends))
    step = max(1, math.isqrt(len(ends) or 1))
    lists = [ends[i : i + step] for i in range(0, len(ends), step)]
    array = lambda x: f"array({', '.join(f'{v}L' for v in x)})"
    # how many ends are below, found among every so many and then between two of them
    block = f"greatest(size(filter({array(x[0] for x in lists)}, x -> x < doc_id)) - 1, 0)"
    near = f"element_at(array({', '.join(map(array, lists))}), {block} + 1)"
    own = F.expr(f"CASE WHEN doc_id IS NULL THEN -1 ELSE {f'{block} * {step} + size(filter({near}, x -> x < doc_id))' if ends else 0} END")
    dealt = base.withColumn("part", own)
    # one row a part: bounded by their number
    tops = docs.select("doc_id", own.alias("part")).groupBy("part").agg(F.max("doc_id").alias("top")).orderBy(F.desc("part")).collect()
    before = {b["top"]: a["part"] for a, b in zip([*tops[-1:], *tops], tops, strict=False)}
    known = F.col("doc_id").isin([k for k in before if k is not None])
    heads = base.where(known | F.col("doc_id").isNull() if None in before else known).groupBy("doc_id").agg(F.min("text").alias("text"))
    places = {k: v for k, v in before.items() if k is not None}
    lookup = f"element_at(map_from_arrays(array({', '.join(f'{k}L' for k in places)}), array({', '.join(map(str, places.values()))})), doc_id)" if places else "NULL"
    to = F.expr(f"CASE WHEN doc_id IS NULL THEN {before.get(None, 'NULL')} ELSE {lookup} END")
    both = dealt.withColumn("lent", F.lit(False)).unionByName(heads.withColumn("part", to).withColumn("lent", F.lit(True))).repartition(-(-parts // 2), "part")
    order = Window.partitionBy("part").orderBy("lent", F.desc_nulls_last("doc_id"), "text")
    return both.select("part", F.row_number().over(order).alias("row"), "lent", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def terms(texts: DataFrame, keys: list[str], text: str, edited: str | None = None) -> DataFrame:
    """keys, which, h and n: the words of each text and its edited one as 48 bits of their hash and 16 of their length, and how often it has
    them: once if both have it as often (BOTH). A row without words has one row with a null n."""
    split = lambda c: F.split(c, SPACE)
    if edited is None:
        each = texts.select(*keys, F.lit(0).alias("tag"), F.explode(split(text)).alias("w"))
    else:
        each = texts.select(*keys, F.posexplode(F.array(text, edited)).alias("tag", "t")).select(*keys, "tag", F.explode(split("t")).alias("w"))
    # an empty word, which texts without words have, too, has the hash zero and does not count
    each = each.selectExpr(*keys, "CASE WHEN w = '' THEN 0L ELSE xxhash64(w) & -65536L | least(length(w), 65535) END AS h", "CASE WHEN tag = 0 AND w != '' THEN 1L ELSE 0L END AS own", "CASE WHEN tag = 1 AND w != '' THEN 1L ELSE 0L END AS edited")
    counts = each.groupBy(*keys, "h").agg(F.sum("own").alias("n0"), F.sum("edited").alias("n1"))
    first = f"CASE WHEN n0 = n1 THEN named_struct('which', {BOTH}, 'n', nullif(n0, 0L)) WHEN n0 > 0 THEN named_struct('which', {OWN}, 'n', n0) END"
    second = f"CASE WHEN n0 != n1 AND n1 > 0 THEN named_struct('which', {EDITED}, 'n', n1) END"
    return counts.select(*keys, "h", F.expr(f"explode(array({first}, {second}))").alias("x")).where("x IS NOT NULL").select(*keys, F.col("x.which").alias("which"), "h", F.col("x.n").alias("n"))


def _common(docs: DataFrame, samples: int) -> DataFrame:
    every = max(1, docs.count() // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select(F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    return common_draws(terms(some, ["row"], "text").where("n IS NOT NULL"), samples)


def fingerprint(docs: DataFrame, *, samples: int = SAMPLES) -> DataFrame:
    """doc_id (distinct) and fingerprint of whole texts."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = prints(terms(base, ["doc_id"], "text"), ["doc_id"], _common(docs, samples), samples)
    return found.select("doc_id", F.coalesce("print0", F.lit("0" * 4 * samples)).alias("fingerprint"))


def fingerprint_edits(docs: DataFrame, *, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, the hash of each row's edited text, both fingerprints, and their likeness to each other and to the next row's."""
    spark = docs.sparkSession
    rows = with_next(docs, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    edited = F.expr("CASE WHEN lent THEN '' ELSE concat(substring(text, 1, CAST(length(text) - length(text) div 3 AS int)), substring(next_text, 1, CAST(length(text) div 3 AS int))) END")
    rows = rows.withColumn("edited", edited)
    found = prints(terms(rows, ["part", "row"], "text", "edited"), ["part", "row"], _common(docs, samples), samples)
    empty = F.lit("0" * 4 * samples)
    found = found.select("part", "row", F.coalesce("print0", empty).alias("fingerprint"), F.coalesce("print1", empty).alias("edited_fingerprint"))
    found = found.withColumn("next", F.lead("fingerprint").over(Window.partitionBy("part").orderBy("row")))
    about = rows.where("NOT lent").select("part", "row", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    both = about.join(found, ["part", "row"])
    return both.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint", samples).alias("near_edited"), likeness("fingerprint", "next", samples).alias("near_next"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
