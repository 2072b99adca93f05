"""Mixing sources to target weights by temperature, realised as block permutations.

A source's weight is its share of all tokens to a power, normalised. The exponent is bisected
until the weights meet a target entropy (in nats) or until no source is repeated more often
than a limit. Only DataFrame functions run on the executors; the driver sees one row per
exponent tried.

A budget of tokens is divided by the weights; without one, the least budget that uses every
document at least once is taken. Documents fall into blocks of their source by a hash. For
each epoch the source's blocks are permuted; whole epochs take all of them, the last one takes
blocks in order while they fit and, of the next block, documents in the order of their hash
while they fit. So a source gets its quota to within one document.

Null sources form a source of their own. Null and empty texts have no tokens: they come with
their blocks. Sources without any token get no weight and are passed through once. Repeated
rows stand next to each other. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locengine.config import materialise
from locengine.llm.common import free_name, without

FINE = 1 << 16  # blocks of a source at most
_GRID = 32  # exponents tried at once: five halvings
OUTPUTS = ["n_tokens", "weight", "epoch", "block", "position"]


def tokens_of(text: str) -> Column:
    words = F.split(F.col(f"`{text}`"), r"[ \t\n\x0B\f\r]+")
    return F.coalesce(F.size(F.filter(words, lambda w: w != "")), F.lit(0)).cast("long")


@dataclass
class Mix:
    exponent: float
    norm: float  # sum of the powers of all shares
    tokens: float  # of all sources
    budget: float


def _tried(sources: DataFrame, exponents: list[float], total: float) -> list:
    """Per exponent: sum of powers, of powers times logarithm, range of weight by share."""
    log = F.log(F.col("tokens") / F.lit(total))
    power = F.exp(F.col("a") * log)
    ratio = F.exp((F.col("a") - 1) * log)
    return (
        sources.withColumn("a", F.explode(F.array(*(F.lit(a) for a in exponents))))
        .groupBy("a")
        .agg(
            F.sum(power).alias("norm"),
            F.sum(power * log).alias("logs"),
            F.max(ratio).alias("most"),
            F.min(ratio).alias("least"),
        )
        .orderBy("a")
        .collect()
    )


def fit_exponent(
    sources: DataFrame,
    target_entropy: float | None = None,
    max_repeats: float | None = None,
    budget: float | None = None,
    rounds: int = 9,
) -> Mix | None:
    """From rows (source, tokens): the exponent and what the weights need. None without tokens.

    Entropy falls as the exponent grows; an unreachable target gives the nearest end of
    [0, 8]. The repetition limit asks for the least exponent in [0, 1] at which no source is
    used more often; if even the natural shares need more, they are taken. With both, the
    greater exponent wins. With neither the natural shares stay.
    """
    sources = sources.where("tokens > 0")
    total = sources.agg(F.sum("tokens")).first()[0]
    if not total:
        return None
    total = float(total)

    def wanted(row) -> bool:
        """Whether the exponent is large enough."""
        entropy = math.log(row.norm) - row.logs / row.norm
        used = row.most / row.least if budget is None else budget * row.most / (row.norm * total)
        enough = target_entropy is None or entropy <= target_entropy
        return enough and (max_repeats is None or used <= max_repeats)

    low, high = 0.0, 1.0 if target_entropy is None else 8.0
    if target_entropy is None and max_repeats is None:
        low = high
    if high > low and wanted(_tried(sources, [low], total)[0]):
        high = low
    for _ in range(rounds):
        if high <= low:
            break
        grid = [low + (high - low) * i / _GRID for i in range(1, _GRID)]
        good = [r.a for r in _tried(sources, grid, total) if wanted(r)]
        first = min(good, default=high)
        low = max([low, *(a for a in grid if a < first)])
        high = first
    row = _tried(sources, [high], total)[0]
    # Used once each: budget * weight >= tokens for every source.
    least = total * row.norm / row.least
    return Mix(high, row.norm, total, least if budget is None else float(budget))


def mix(
    docs: DataFrame,
    source: str = "source",
    doc_id: str = "doc_id",
    text: str = "text",
    target_entropy: float | None = None,
    max_repeats: float | None = 4.0,
    budget: float | None = None,
    block_tokens: int = 100_000,
    seed: int = 0,
) -> DataFrame:
    """One row per use of a document: its columns, n_tokens, weight (of the source), epoch, block
    and position (of the block in the epoch's order). Such columns of the input are replaced."""
    names = docs.columns
    key = free_name(docs, "mixed_source")
    fine = free_name(docs, "fine_block")
    order = free_name(docs, "order_key")
    docs = without(docs, OUTPUTS)
    kept = docs.columns
    digest = F.md5(
        F.concat_ws("|", F.lit(str(seed)), F.col(f"`{source}`"), F.col(f"`{doc_id}`"))
    )
    keyed = docs.withColumns(
        {
            key: F.col(f"`{source}`").cast("string"),
            "n_tokens": tokens_of(text),
            order: digest,
            fine: F.conv(F.substring(digest, 1, 4), 16, 10).cast("int"),
        }
    )
    stats = materialise(
        keyed.groupBy(F.col(key).alias("s"), F.col(fine).alias("fine")).agg(
            F.sum("n_tokens").alias("tokens")
        ),
        "fine",
    )
    sources = stats.groupBy("s").agg(F.sum("tokens").alias("tokens"))
    sources = materialise(sources, "sources")
    found = fit_exponent(sources, target_entropy, max_repeats, budget)
    plan = materialise(_plan(stats, sources, found, block_tokens, seed), "plan")
    # A small plan is sent to all tasks by Spark's own size check, a larger one is joined by
    # source and block, which no hot source can make one task's work.
    shifts = materialise(plan.select("s", "shift", "weight").distinct(), "shifts")
    blocked = keyed.join(shifts, F.col(key).eqNullSafe(F.col("s")))
    blocked = blocked.withColumn("block", F.expr(f"shiftright(`{fine}`, shift)")).drop("s")
    plan = plan.select(F.col("s"), F.col("block").alias("b"), "uses")
    used = blocked.join(plan, F.col(key).eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    used = used.withColumn("use", F.explode("uses")).select(
        *(F.col(f"`{c}`") for c in kept),
        key,
        order,
        "n_tokens",
        "weight",
        F.col("use.epoch").alias("epoch"),
        "block",
        F.col("use.position").alias("position"),
        F.col("use.room").alias("room"),
    )
    whole = used.where("room is null")
    running = F.sum("n_tokens").over(
        Window.partitionBy(key, "epoch", "block")
        .orderBy(order, "n_tokens")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    part = used.where("room is not null").withColumn("so_far", running)
    part = part.where("so_far <= room").drop("so_far")
    chosen = [*(c for c in names if c in kept), *OUTPUTS]
    return whole.unionByName(part).select(*(F.col(f"`{c}`") for c in chosen))


def _plan(
    stats: DataFrame, sources: DataFrame, found: Mix | None, block_tokens: int, seed: int
) -> DataFrame:
    """(s, block, shift, weight, uses): the epochs in which each block is used, its position and,
    if it does not fit as a whole, the room left for its documents."""
    norm, total, exponent, budget = (
        (found.norm, found.tokens, found.exponent, found.budget) if found else (1.0, 1.0, 1.0, 0.0)
    )
    share = F.col("tokens") / F.lit(total)
    weight = F.when(
        F.col("tokens") > 0, F.exp(F.lit(exponent) * F.log(share)) / F.lit(norm)
    ).otherwise(F.lit(0.0))
    # Rounded, so that a source that is to be used just once is not short of a token.
    quota = F.floor(F.col("weight") * budget + 0.5).cast("long")
    wanted = F.ceil(F.col("tokens") / block_tokens)
    shift = F.greatest(F.lit(0), F.lit(16) - F.ceil(F.log2(F.greatest(wanted, F.lit(1)))))
    each = sources.withColumn("weight", weight).withColumns(
        {"quota": quota, "shift": shift.cast("int")}
    )
    each = each.withColumn(
        "epochs",
        F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1),
    ).withColumn(
        "rest", F.when(F.col("tokens") > 0, F.col("quota") - F.col("epochs") * F.col("tokens"))
    )
    each = each.withColumnRenamed("tokens", "all_tokens").withColumnRenamed("s", "own")
    blocks = (
        stats.join(each, F.col("s").eqNullSafe(F.col("own")))
        .withColumn("block", F.expr("shiftright(fine, shift)"))
        .groupBy("s", "block", "shift", "weight", "epochs", "rest")
        .agg(F.sum("tokens").alias("tokens"))
    )
    last = F.col("epochs") - F.when(F.col("rest") > 0, 0).otherwise(1)
    turns = blocks.where(last >= 0).withColumn(
        "epoch", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long")))
    )
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), "s", "block", "epoch"))
    order = Window.partitionBy("s", "epoch").orderBy(draw, "block")
    so_far = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    before = so_far - F.col("tokens")
    turns = turns.withColumns(
        {"position": F.row_number().over(order), "so_far": so_far, "before": before}
    )
    turns = turns.where("epoch < epochs or before < rest")
    room = F.when(
        (F.col("epoch") == F.col("epochs")) & (F.col("so_far") > F.col("rest")),
        F.col("rest") - F.col("before"),
    )
    return turns.groupBy("s", "block", "shift", "weight").agg(
        F.collect_list(F.struct("epoch", "position", room.alias("room"))).alias("uses")
    )
