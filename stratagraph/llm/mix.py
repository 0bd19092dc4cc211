"""Mixing sources to target weights.

Every source named for a mix gets ``target_share`` of ``size_ratio`` times the corpus, in tokens. The rate of a
document of t tokens is the entropy-balanced one, ``min(max_repeats, exp(lambda * t / mean))``: among all rates
that give the source its tokens, the ones closest to using every document once. The lambdas, one per mix and source,
solve the convex dual by Newton steps; each step is one aggregation over the table of (source, tokens) -> documents.
Rates then become whole copies by systematic rounding along the token counts, so a source misses its target by about
one document at most, and no document passes its cap.

Defined results: sources are compared without case and surrounding blanks; documents with null or empty text or
without source count zero tokens or belong to no named source, and are never chosen; a repeated doc_id counts once, a document without one not at all; a target without source is
left out, a missing share or ratio is 0 and a missing cap 1;
a share of zero, or a source without documents, gives a row of the report with zero tokens; a target out of reach
takes every document max_repeats times and is reported as not reached.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import cut, trim_blank

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-tokenizer pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STEPS, TOLERANCE = 40, 1e-7
BUCKETS = 64
BROADCAST_STRATA = 100_000


@cache
def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of every document; the tokenizer's file must be readable by the executors."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(tokenizer).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id, "source": batch.source, "tokens": [len(encode(t)) for t in batch.text]})

    source = F.lower(trim_blank(F.col("source")))
    texts = documents.where("doc_id is not null").select("doc_id", source.alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(count, "doc_id long, source string, tokens long").dropDuplicates(["doc_id"])


def _solve(histogram: DataFrame, targets: DataFrame) -> list[tuple]:
    """Newton iterations on the dual; the state on the driver is one number per row of the targets."""
    spark = histogram.sparkSession
    totals = {r.source: r for r in histogram.where("source is not null").join(targets.select("source").distinct(), "source").groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("t"), F.sum("n").alias("n")).collect()}
    rows = []
    for r in targets.collect():
        total = totals.get(r.source)
        full = total.t if total else 0
        low, high = -60.0, 60.0
        if not full or r.target <= 0:
            rows.append([r.mix_id, r.source, r.target, r.max_repeats, full, 1.0, None, low, high, True])
        elif r.target >= full * r.max_repeats:
            rows.append([r.mix_id, r.source, r.target, r.max_repeats, full, total.t / total.n, math.inf, low, high, True])
        else:
            rows.append([r.mix_id, r.source, r.target, r.max_repeats, full, total.t / total.n, 0.0, low, high, False])
    for _ in range(STEPS):
        live = [(i, x) for i, x in enumerate(rows) if not x[9]]
        if not live:
            break
        asked = spark.createDataFrame([(i, x[1], float(x[3]), x[5], x[6]) for i, x in live], "i int, source string, cap double, mean double, lam double")
        x = F.col("tokens") / F.col("mean")
        rate = F.least(F.col("cap"), F.exp(F.least(F.lit(700.0), F.col("lam") * x)))
        weight = F.col("n") * F.col("tokens")
        got = histogram.join(asked, "source").groupBy("i").agg(F.sum(weight * rate).alias("value"), F.sum(F.when(rate < F.col("cap"), weight * rate * x).otherwise(0.0)).alias("slope"))
        for g in got.collect():
            r = rows[g.i]
            gap = g.value - r[2]
            if abs(gap) <= TOLERANCE * max(1.0, r[2]):
                r[9] = True
                continue
            if gap < 0:
                r[7] = r[6]
            else:
                r[8] = r[6]
            step = r[6] - gap / g.slope if g.slope > 0 else math.nan
            r[6] = step if r[7] < step < r[8] else (r[7] + r[8]) / 2
    return rows


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(chosen documents with their copies, report of target and actual shares)."""
    spark = documents.sparkSession
    docs = cut(with_tokens(documents, tokenizer))
    histogram = cut(docs.groupBy("source", "tokens").agg(F.count("*").alias("n")))
    corpus = histogram.agg(F.sum(F.col("tokens") * F.col("n"))).first()[0] or 0
    share, ratio = F.coalesce("target_share", F.lit(0.0)), F.coalesce("size_ratio", F.lit(0.0))
    wanted = targets.where("source is not null").select(
        "mix_id", F.lower(trim_blank(F.col("source"))).alias("source"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"), (share * ratio * F.lit(float(corpus))).alias("target"),
    ).distinct()
    solved = _solve(histogram, wanted)

    plan = spark.createDataFrame(
        [(m, s, float(c), mean, lam) for m, s, _, c, _, mean, lam, *_ in solved if lam is not None],
        "mix_id string, source string, cap double, mean double, lam double",
    )
    x = F.col("tokens") / F.col("mean")
    rate = F.when(F.col("lam") == math.inf, F.col("cap")).otherwise(F.least(F.col("cap"), F.exp(F.least(F.lit(700.0), F.col("lam") * x))))
    strata = histogram.where("tokens > 0").join(plan, "source").withColumn("rate", rate)
    strata = strata.withColumn("base", F.floor("rate")).withColumn("part", F.col("n") * (F.col("rate") - F.col("base")))
    # systematic rounding: the running sum of tokens that are still owed decides how many documents of a stratum get one copy more
    along = Window.partitionBy("mix_id", "source").orderBy("tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owed = F.sum("part").over(along)
    strata = strata.withColumn("extra", F.floor(owed + 0.5) - F.floor(owed - F.col("part") + 0.5))
    strata = cut(strata.where("base > 0 or extra > 0").select("mix_id", "source", "tokens", "base", "extra"))

    # rank of a document among those of equal source and length, in two levels so that no group is ordered by one task
    named = docs.where("tokens > 0").join(plan.select("source").distinct(), "source", "left_semi").withColumn("h", F.xxhash64("doc_id"))
    named = named.withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    sizes = named.groupBy("source", "tokens", "bucket").agg(F.count("*").alias("size"))
    before = Window.partitionBy("source", "tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("source", "tokens", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "tokens", "bucket").orderBy("h", "doc_id")
    ranked = named.withColumn("in_bucket", F.row_number().over(inside)).join(sizes, ["source", "tokens", "bucket"])
    ranked = ranked.select("doc_id", "source", "tokens", (F.col("before") + F.col("in_bucket")).alias("place"))
    few = strata.count() <= BROADCAST_STRATA  # beyond that, a shuffle join which adaptive execution splits where it is skewed
    chosen = ranked.join(F.broadcast(strata) if few else strata, ["source", "tokens"])
    copies = F.col("base") + F.when(F.col("place") <= F.col("extra"), 1).otherwise(0)
    chosen = chosen.select("mix_id", "doc_id", "source", "tokens", copies.cast("int").alias("copies")).where("copies > 0")

    used = F.col("base") * F.col("n") + F.col("extra")
    given = strata.join(histogram, ["source", "tokens"]).groupBy("mix_id", "source").agg(F.sum(used * F.col("tokens")).alias("actual_tokens"))
    every = Window.partitionBy("mix_id")
    goal = spark.createDataFrame([(m, s, float(t), int(c), int(full)) for m, s, t, c, full, *_ in solved], "mix_id string, source string, target_tokens double, max_repeats int, available_tokens long")
    report = goal.join(given, ["mix_id", "source"], "left").withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0)).cast("long"))
    report = report.withColumn("actual_share", F.col("actual_tokens") / F.greatest(F.sum("actual_tokens").over(every), F.lit(1)))
    report = report.withColumn("target_share", F.col("target_tokens") / F.greatest(F.sum("target_tokens").over(every), F.lit(1e-9)))
    reached = F.col("target_tokens") <= F.col("available_tokens") * F.col("max_repeats")
    return chosen, report.select("mix_id", "source", "target_share", F.round("actual_share", 6).alias("actual_share"), F.round("target_tokens", 3).alias("target_tokens"), "actual_tokens", "available_tokens", "max_repeats", reached.alias("reached"))
