"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0..1, given as knots between which the weight
runs straight. Its integral, times the token budget, is the source's cumulative token demand; a
document whose source has used `c` tokens before it stands where the demand reaches `c` - the
inverse of the integral. Sorting all documents by that position,
by range, gives the training order; repeats of a source are further passes over its documents.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fotolake.runtime import cut, slots

#: Folder of public tokenizer vocabularies and the one used.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Documents aimed at per bucket of the running token sums.
BUCKET_DOCS = 20_000
#: How far a source's weight moves from its target over training, relative, at most.
RAMP = 0.5
# Fixed value: the pre-tokenisation pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _encoding(folder: str, name: str):
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def source_key(col: str | Column) -> Column:
    """Source as compared: lower case, no outer white space; blank counts as absent."""
    c = F.regexp_replace(F.lower(F.col(col) if isinstance(col, str) else col), r"^\s+|\s+$", "")
    return F.when(c != "", c)


def token_counts(docs: DataFrame, *, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, tokens of every document with an id; a null text has none."""

    def run(batches):
        enc = _encoding(folder, vocabulary)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": np.array(n, np.int64)})

    d = docs.select("doc_id", source_key("source").alias("source"), "text").where("doc_id is not null")
    return d.mapInPandas(run, "doc_id long, source string, tokens long")


def targets_of(targets: DataFrame) -> DataFrame:
    """source, share, max_repeats: one row per source as compared; shares of the same source add up and are scaled to sum to 1."""
    t = targets.select(source_key("source").alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats > 0")
    t = t.groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("max_repeats"))
    return t.withColumn("share", F.col("share") / F.sum("share").over(Window.partitionBy(F.lit(1))))  # a row per source


def ramp_schedule(plan: DataFrame, ramp: float = RAMP) -> DataFrame:
    """A schedule for `plan(source, share, max_repeats)`: source, at, weight. The weight at time t is share + slope (t - 1/2).

    Sources allowed more repeats (the small ones) gain weight over time, the others lose it. Slopes
    sum to 0, so the weights sum to 1 at any time and each integrates to its share.
    """
    one = Window.partitionBy(F.lit(1))  # a row per source
    p = plan.withColumn("_m", F.col("max_repeats").cast("double") - F.sum(F.col("share") * F.col("max_repeats")).over(one))
    widest = F.max(F.abs("_m")).over(one)
    p = p.withColumn("_s", F.when(widest > 0, F.lit(2 * ramp) * F.col("share") * F.col("_m") / widest).otherwise(0.0))
    return p.select("source", F.explode(F.array(*[F.struct(F.lit(float(t)).alias("at"), (F.col("share") + F.col("_s") * (t - 0.5)).alias("weight")) for t in (0, 1)])).alias("k")).select("source", "k.*")


def curriculum(plan: DataFrame, schedule: DataFrame) -> DataFrame:
    """Add `pieces` to `plan(source, share)`: the schedule as array of (t0, t1, w0, w1, y0), scaled to integrate to the share; y0 is the integral up to t0.

    `schedule(source, at, weight)` gives knots; between them the weight runs straight, before the first
    and after the last it stays. Knots outside 0..1, null or negative ones don't count; of several at
    one time the greatest holds. A source without knots, or with none above 0, has an even weight.
    Knots are a table written by hand: a source's are taken together.
    """
    knots = schedule.select(source_key("source").alias("source"), F.col("at").cast("double").alias("at"), F.col("weight").cast("double").alias("weight")).where("source is not null and at between 0 and 1 and weight >= 0")
    knots = knots.groupBy("source", "at").agg(F.max("weight").alias("weight")).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("at", "weight"))).alias("k"), F.max("weight").alias("_top"))
    p = plan.join(knots.where("_top > 0").drop("_top"), "source", "left").withColumn("k", F.coalesce("k", F.expr("array(struct(0D as at, 1D as weight))")))
    ends = "concat(array(struct(0D as at, k[0].weight as weight)), k, array(struct(1D as at, element_at(k, -1).weight as weight)))"
    p = p.withColumn("k", F.expr(ends)).withColumn("k", F.expr("transform(sequence(1, size(k) - 1), i -> struct(k[i - 1].at as t0, k[i].at as t1, k[i - 1].weight as w0, k[i].weight as w1))"))
    p = p.withColumn("k", F.expr("filter(k, x -> x.t1 > x.t0)"))
    area = "aggregate({}, 0D, (s, x) -> s + (x.t1 - x.t0) * (x.w0 + x.w1) / 2)"
    p = p.withColumn("_f", F.col("share") / F.expr(area.format("k")))
    piece = f"struct(k[i].t0 as t0, k[i].t1 as t1, k[i].w0 * _f as w0, k[i].w1 * _f as w1, {area.format('slice(k, 1, i)')} * _f as y0)"
    return p.withColumn("pieces", F.expr(f"transform(sequence(0, size(k) - 1), i -> {piece})")).drop("k", "_f")


def position(y: Column) -> Column:
    """Where the integral of `pieces` reaches y: within its piece, w0 s + (w1 - w0) s^2 / (2 length) = y - y0 solved for s."""
    # the last piece that begins below y; at y = 0 the first that has weight
    piece = F.coalesce(F.element_at(F.filter("pieces", lambda x: (x["y0"] < y) | ((x["y0"] <= y) & (x["w0"] + x["w1"] > 0))), -1), F.element_at("pieces", 1))
    first = F.element_at(F.filter("pieces", lambda x: x["w0"] + x["w1"] > 0), 1)
    x = F.when(y <= 0, first).otherwise(piece)
    rest, long = F.greatest(y - x["y0"], F.lit(0.0)), x["t1"] - x["t0"]
    root = F.sqrt(F.greatest(x["w0"] * x["w0"] + 2 * (x["w1"] - x["w0"]) / long * rest, F.lit(0.0)))
    return F.least(x["t0"] + F.when(rest > 0, F.least(2 * rest / (x["w0"] + root), long)).otherwise(0.0), F.lit(1.0))


def running_tokens(sized: DataFrame, seed: int) -> DataFrame:
    """Add `before`: tokens of the same source standing earlier in its shuffled order.

    Documents fall into buckets by hash; sums over buckets and sums inside buckets add up. Hashes
    spread any source evenly, so a source with a third of all rows is many buckets, not one task.
    """
    spots = F.xxhash64("doc_id", F.lit(seed))
    n = sized.count()
    buckets = max(1, -(-n // BUCKET_DOCS))
    s = sized.withColumn("_h", spots).withColumn("_b", F.pmod(F.shiftrightunsigned("_h", 40), F.lit(buckets)))
    per = s.groupBy("source", "_b").agg(F.sum("tokens").alias("_t"))
    earlier = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("source", "_b", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("source", "_b").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_in", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    return s.join(per, ["source", "_b"]).withColumn("before", F.col("_base") + F.col("_in")).drop("_h", "_b", "_base", "_in")


def mixture(docs: DataFrame, targets: DataFrame, *, schedule: DataFrame | None = None, total_tokens: int | None = None, ramp: float = RAMP, seed: int = 0, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Documents in training order: doc_id, source, tokens, pass_no, position, source_tokens_before.

    The budget is `total_tokens`, or as much as the caps allow: the least over sources of
    max_repeats x tokens / share. With a larger budget sources at their cap fall short, which
    `shares` then shows. `schedule(source, at, weight)` says when a source's tokens are due (see
    `curriculum`); without it weights run straight (`ramp_schedule`). A document is used while it fits into its source's demand. Left out are
    documents without tokens (null or empty texts), those whose source is null or has no target, and
    the share of a target without documents. Sources are compared without case and outer spaces.
    Documents must have distinct ids; extra columns are ignored. Empty tables give no rows.
    """
    plan = targets_of(targets)
    plan = curriculum(plan, ramp_schedule(plan, ramp) if schedule is None else schedule)
    sized = cut(token_counts(docs, folder=folder, vocabulary=vocabulary).where("tokens > 0"))
    have = sized.groupBy("source").agg(F.sum("tokens").alias("have"))
    plan = plan.join(have, "source")  # both a row per source
    one = Window.partitionBy(F.lit(1))
    budget = F.lit(float(total_tokens)) if total_tokens is not None else F.min(F.col("max_repeats") * F.col("have") / F.col("share")).over(one)
    plan = cut(plan.withColumn("budget", budget).withColumn("demand", F.col("budget") * F.col("share")))
    named = sized.join(F.broadcast(plan.select("source")), "source", "left_semi") if plan.count() <= 100_000 else sized.join(plan.select("source"), "source", "left_semi")
    placed = running_tokens(named, seed).join(plan, "source")
    top = F.least(F.ceil(F.col("demand") / F.col("have")).cast("int"), F.col("max_repeats"))
    used = placed.withColumn("pass_no", F.explode(F.sequence(F.lit(1), F.greatest(top, F.lit(1)))))
    c = F.col("before") + (F.col("pass_no") - 1) * F.col("have")
    used = used.withColumn("source_tokens_before", c).where((c + F.col("tokens") <= F.col("demand") + F.lit(0.5)))
    used = used.withColumn("position", position(c / F.col("budget")))
    keys = ["position", "source", "doc_id", "pass_no"]
    out = used.select("doc_id", "source", "tokens", "pass_no", "position", "source_tokens_before")
    return out.repartitionByRange(slots(out.sparkSession), *keys).sortWithinPartitions(*keys)


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share of each source in a mixture: source, target_share, actual_share, tokens, documents, most_uses."""
    m = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("pass_no").alias("most_uses"))
    t = targets_of(targets).join(m, "source", "left")
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # a row per source
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    return t.select("source", F.col("share").alias("target_share"), F.coalesce(F.col("tokens") / total, F.lit(0.0)).alias("actual_share"), zero("tokens", "long"), zero("documents", "long"), zero("most_uses", "int"))
