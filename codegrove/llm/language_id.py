"""Language identification by rank-order profiles.

A profile is a list of the most frequent letter n-grams (1 to 3 letters, word ends marked by a space), most frequent
first. A document gets the language whose profile has the smallest out-of-place distance to the document's own.

Edge cases: null and letterless texts are `und` with score 0; a text shorter than a profile is compared by the n-grams
that it has; ties between n-grams go by code point, between languages by name; repeated rows get the same prediction;
without any labelled row every document is `und`; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table

PROFILE = 300
SAMPLE = 2000
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the letter n-grams of a text and their counts. A code is its code points, 21 bits each."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    a = np.where(_letters()[a], a, 32).astype(np.int64)
    a = np.concatenate(([32], a, [32]))
    a = a[np.concatenate(([True], (a[1:] != 32) | (a[:-1] != 32)))]
    if len(a) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    two = (a[:-1] << 21) | a[1:]
    three = ((two[:-1] << 21) | a[2:])[a[1:-1] != 32]
    return np.unique(np.concatenate((a[a != 32], two, three)), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, ties by code."""
    return codes[np.lexsort((codes, -counts))[:size]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, dict[int, int]] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if text:
                own = seen.setdefault(lang, {})
                for k, n in zip(*(x.tolist() for x in grams(text)), strict=True):
                    own[k] = own.get(k, 0) + n
    for lang, own in seen.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], ["lang", "gram", "n"])


def learn(labelled: DataFrame, *, size: int = PROFILE, sample: int = SAMPLE) -> dict[str, list[int]]:
    """Profiles from the rows (doc_id, text, lang) whose lang is not null.

    Of each language about `sample` rows are read, chosen by a hash of doc_id; counts are summed over executors, and only
    `size` n-grams a language reach the driver.
    """
    rows = labelled.where("lang is not null and text is not null")
    share = {r["lang"]: min(1.0, sample / r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return {}
    prepare(labelled.sparkSession)
    limit = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, int(v * 1_000_000))])[F.col("lang")]
    read = rows.where(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1))), F.lit(1_000_000)) < limit).select("lang", "text")
    sums = read.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = sums.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "gram"))), 1, size)["gram"].alias("grams"))
    return {r["lang"]: list(r["grams"]) for r in sorted(top.collect(), key=lambda r: r["lang"])}


class Matcher:
    """Out-of-place distance of a text to each profile."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.langs, self.size = sorted(profiles), size
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        self.rank = np.full((len(self.codes) + 1, len(self.langs)), size, np.int64)
        for k, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.codes, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        own = ranked(*grams(text), self.size) if text else ()
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, own)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != own] = len(self.codes)
        there = self.rank[at]
        apart = np.where(there == self.size, self.size, np.abs(there - np.arange(len(own))[:, None])).sum(0)
        best = int(apart.argmin())
        return self.langs[best], 1 - float(apart[best]) / (len(own) * self.size)


def identify(docs: DataFrame, profiles: dict[str, list[int]], *, size: int = PROFILE, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with each row's language and score, from the whole text alone, in columns of the given names; these replace columns of the same name."""
    prepare(docs.sparkSession)
    out = [n for n in docs.columns if n not in names]
    schema = ", ".join([*(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in out), f"`{names[0]}` string", f"`{names[1]}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(profiles, size)
        for b in batches:
            found = [match(x) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in out), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*out, *names])

    return docs.select(*out).mapInArrow(run, schema)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn(docs.where(~held_out()).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: Documents below this likeness to every profile are in none of the languages.
LEAST = 0.15


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that are in some language; a null lang becomes the predicted one."""
    found, score = "__found_lang", "__found_score"
    kept = identify(docs, learn(docs.select("doc_id", "text", "lang")), names=(found, score)).where((F.col(found) != UNKNOWN) & (F.col(score) >= LEAST))
    return kept.withColumn("lang", F.coalesce("lang", found)).select(docs.columns)
