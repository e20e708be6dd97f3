"""Mixing sources to target shares of the tokens, with a cap on how often a document may be used.

Weights are tempered: a source's token share to the power of one exponent, times its target share to the power of
what that leaves of 1, normalised (`blended`); exponent 0 of the token shares is the targets, 1 is the sources as they
are. The exponent is bisected

  - to a repetition limit: given a budget, to the nearest to the targets at which no source must be repeated more
    than it may;
  - without a budget, to `tolerance`: to the largest mix whose weights are all within it of the targets that can be met;
  - to an entropy: token shares alone are tempered until they have the entropy that is asked for.

Sources without a token, or that may not be used, can't meet their targets; the others share what they leave.

The weights are realised as budgeted block permutations: a source's quota is whole passes over its documents
and one partial pass, which takes its documents in the order of a seeded hash, block by block, up to the rest
of the quota. Blocks are summed before they are ordered, and only the block in which the quota ends is
ordered by document, so a source of any size is spread over all tasks.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.functions.ids import bare
from tramline.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the rank files' text is split before merging (fixed value, with the files).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCKS = 4096
MAX_SOURCES = 100_000


def normal_source(c: str) -> Column:
    """Small letters, no surrounding blanks, - for _."""
    return F.translate(F.lower(bare(c)), "_", "-")


def count_tokens(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], schema=schema)

    return run


def token_sizes(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of every document; null texts have 0 tokens. The vocabulary file is read by
    the driver and sent to the workers, so its size (under 1 MB) is what is broadcast."""
    with open(tokenizer, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal_source("source").alias("source"), "text")
    return rows.mapInArrow(count_tokens(shared), "doc_id long, source string, tokens long")


def temper(shares: list[float], exponent: float) -> list[float]:
    """Shares to the power of the exponent, normalised; with an infinite one the greatest share it all."""
    most = max(shares, default=0.0)
    x = [(s / most) ** exponent if s > 0 else 0.0 for s in shares]
    total = sum(x)
    return [v / total for v in x] if total else x


def entropy(shares: list[float]) -> float:
    return -sum(s * math.log(s) for s in shares if s > 0)


def bisect(f, lo: float, hi: float) -> float:
    """The largest x in [lo, hi] with f(x), for f true up to some x; lo if it is true nowhere."""
    if f(hi):
        return hi
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) else (lo, mid)
    return lo


def exponent_for_entropy(shares: list[float], target: float) -> float:
    """The exponent at which the entropy of the shares falls to `target` nats: 0 if even equal shares have less, infinite
    if the greatest shares alone, which are equal, still have more."""
    if entropy(temper(shares, math.inf)) > target + 1e-9:
        return math.inf
    hi = 1.0
    while hi < 1e12 and entropy(temper(shares, hi)) >= target:
        hi *= 2
    return bisect(lambda a: entropy(temper(shares, a)) >= target, 0.0, hi)


def blended(natural: list[float], target: list[float], exponent: float) -> list[float]:
    """natural ** exponent * target ** (1 - exponent), normalised: from the targets (0) to the shares as they are (1)."""
    x = [n**exponent * t ** (1 - exponent) if n > 0 and t > 0 else 0.0 for n, t in zip(natural, target, strict=True)]
    total = sum(x)
    return [v / total for v in x] if total else x


@dataclass(frozen=True)
class Plan:
    exponent: float
    budget: float
    weights: list[float]
    quotas: list[float]


def plan(tokens: list[float], targets: list[float], repeats: list[float], budget: float | None = None, entropy_nats: float | None = None, tolerance: float = 0.02) -> Plan:
    """Weights and token quotas of sources; `exponent` is that of the token shares. Every quota is at most repeats * tokens, whatever the budget; a source that may give nothing has none."""
    targets = [g if r * t > 0 else 0.0 for g, r, t in zip(targets, repeats, tokens, strict=True)]
    total = sum(t for t, g in zip(tokens, targets, strict=True) if g > 0)
    if not total:
        return Plan(0.0, 0.0, [0.0] * len(tokens), [0.0] * len(tokens))
    natural = [t / total if g > 0 else 0.0 for t, g in zip(tokens, targets, strict=True)]
    goal = temper(targets, 1.0)
    most = lambda w: min(r * t / x for x, r, t in zip(w, repeats, tokens, strict=True) if x > 0)
    if entropy_nats is not None:
        exponent = exponent_for_entropy(natural, entropy_nats)
        weights = temper(natural, exponent)
        budget = most(weights) if budget is None else budget
    else:
        if budget is None:
            near = lambda w: all(abs(x - g) <= tolerance * g * (1 + 1e-12) for x, g in zip(w, goal, strict=True))
            exponent = bisect(lambda a: near(blended(natural, goal, a)), 0.0, 1.0)
            budget = most(blended(natural, goal, exponent))
        else:
            # the way from the shares as they are, which need the fewest repeats, towards the targets
            exponent = 1.0 - bisect(lambda a: most(blended(natural, goal, 1.0 - a)) >= budget * (1 - 1e-12), 0.0, 1.0)
        weights = blended(natural, goal, exponent)
    # A budget beyond all limits: what a capped source can't give goes to the others by weight.
    quotas, free, left = [0.0] * len(tokens), [x > 0 for x in weights], budget
    while any(free) and left > 1e-9:
        scale = sum(x for x, f in zip(weights, free, strict=True) if f)
        capped = [f and quotas[k] + left * weights[k] / scale >= repeats[k] * tokens[k] for k, f in enumerate(free)]
        if not any(capped):
            quotas = [q + (left * x / scale if f else 0.0) for q, x, f in zip(quotas, weights, free, strict=True)]
            break
        for k, c in enumerate(capped):
            if c:
                left -= repeats[k] * tokens[k] - quotas[k]
                quotas[k], free[k] = repeats[k] * tokens[k], False
    return Plan(exponent, budget, weights, quotas)


@dataclass
class Mix:
    rows: DataFrame  # doc_id, source, tokens, copies
    shares: DataFrame  # one row per target


def mix(docs: DataFrame, targets: DataFrame, budget: float | None = None, tokenizer: str = TOKENIZER, seed: int = 7, budget_share: float | None = None, entropy_of_targets: bool = False, tolerance: float = 0.02) -> Mix:
    """Which documents to use how often, and the shares reached.

    budget is in tokens; budget_share gives it as a multiple of the tokens of all sources that have a target. With
    entropy_of_targets the token shares are tempered to the entropy of the targets that can be met.

    Sources are compared without case, blanks and _ for -. Documents of null or unknown sources aren't used;
    empty ones carry no tokens and are never taken. A source with several target rows counts with the sum of
    their shares and the largest max_repeats; null shares and repeats are 0. doc_id should be unique:
    repeated rows are documents of their own. No documents: no rows, and shares of 0.
    """
    spark: SparkSession = docs.sparkSession
    wanted = targets.groupBy(normal_source("source").alias("source")).agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats"))
    goal = wanted.filter("source is not null").orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(goal) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = cut(token_sizes(docs, tokenizer))
    names = spark.createDataFrame([(r.source,) for r in goal], "source string")
    per = {r.source: r for r in sizes.join(F.broadcast(names), "source").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).collect()}
    have = [float(per[r.source].tokens) if r.source in per else 0.0 for r in goal]
    if budget_share is not None:
        budget = budget_share * sum(x for x, r in zip(have, goal, strict=True) if r.target_share > 0)
    can = [r.target_share if r.max_repeats * x > 0 else 0.0 for r, x in zip(goal, have, strict=True)]
    p = plan(have, [r.target_share for r in goal], [float(r.max_repeats) for r in goal], budget, entropy(temper(can, 1.0)) if entropy_of_targets else None, tolerance)
    passes = [int(q // t) if t else 0 for q, t in zip(p.quotas, have, strict=True)]
    rest = [int(round(q - n * t)) for q, n, t in zip(p.quotas, passes, have, strict=True)]
    quota = spark.createDataFrame([(r.source, n, x) for r, n, x in zip(goal, passes, rest, strict=True)], "source string, _passes int, _rest long")
    own = sizes.join(F.broadcast(quota), "source").filter("tokens > 0 and (_passes > 0 or _rest > 0)").withColumn("_h", F.xxhash64("doc_id", F.lit(seed), "_passes"))
    own = own.withColumn("_block", F.pmod(F.shiftright("_h", 20), F.lit(BLOCKS)))
    blocks = own.groupBy("source", "_block").agg(F.sum("tokens").alias("_t"))
    w = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    base = blocks.withColumn("_base", F.sum("_t").over(w) - F.col("_t")).drop("_t", "_passes")  # at most BLOCKS rows a source
    placed = own.join(base, ["source", "_block"]).join(blocks, ["source", "_block"])
    whole = placed.filter("_base + _t <= _rest or _base >= _rest")
    edge = placed.filter("_base + _t > _rest and _base < _rest")
    v = Window.partitionBy("source", "_block").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    out = whole.select("doc_id", "source", "tokens", (F.col("_passes") + F.when(F.expr("_base + _t <= _rest"), 1).otherwise(0)).alias("copies")).unionByName(
        edge.withColumn("_upto", F.col("_base") + F.sum("tokens").over(v)).select("doc_id", "source", "tokens", (F.col("_passes") + F.when(F.expr("_upto <= _rest"), 1).otherwise(0)).alias("copies"))
    )
    rows = out.filter("copies > 0")
    used = rows.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    facts = spark.createDataFrame(
        [(r.source, float(r.target_share), int(r.max_repeats), int(per[r.source].docs) if r.source in per else 0, int(h), float(x), float(p.exponent)) for r, h, x in zip(goal, have, p.weights, strict=True)],
        "source string, target_share double, max_repeats int, docs long, tokens long, weight double, exponent double",
    )
    joined = facts.join(F.broadcast(used), "source", "left").fillna(0, ["used_tokens", "most_copies"])
    total = F.sum("used_tokens").over(Window.partitionBy())  # one row per target
    shares = joined.withColumn("reached_share", F.coalesce(F.try_divide("used_tokens", total), F.lit(0.0)))
    return Mix(rows, shares.withColumn("met", F.abs(F.col("reached_share") - F.col("target_share")) <= 0.05 * F.col("target_share")))
