"""Mixing sources to time-varying target weights.

Every source has a weight schedule over training time t in [0, 1], piecewise linear between common knots and
normalised over the sources that exist.  Its integral times the token budget is the source's cumulative token
demand; a document's training position is where that demand reaches the tokens of the documents of its source
that come before it.  Documents are then range-sorted by position.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipewright.llm._shared import written


@dataclass(frozen=True)
class Curriculum:
    """``knots``: increasing times from 0 to 1.  ``weights``: source -> integer weight at each knot.
    ``default``: the weights of any other source (a null source is a source like any other)."""

    knots: tuple[float, ...] = (0.0, 0.5, 1.0)
    weights: dict[str, tuple[int, ...]] = field(default_factory=dict)
    default: tuple[int, ...] = (100, 100, 100)

    def __post_init__(self):
        if self.knots[0] != 0 or self.knots[-1] != 1 or any(a >= b for a, b in zip(self.knots, self.knots[1:])):
            raise ValueError("knots must increase from 0 to 1")
        for w in [self.default, *self.weights.values()]:
            if len(w) != len(self.knots) or any(x < 0 or x != int(x) for x in w):
                raise ValueError("one non-negative integer weight per knot is needed")


#: The registered queries' schedule: equal shares overall; the crawl source falls, two curated sources rise.
PRODUCTION = Curriculum(weights={"src0": (140, 100, 60), "src1": (60, 100, 140), "src2": (60, 100, 140)})


def _token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("long")


def _weights(source: Column, c: Curriculum) -> Column:
    """``source`` is "=" and the source's name, or "" for a null source, so that it can be joined on."""
    out = F.array(*[F.lit(int(x)) for x in c.default])
    for name, w in c.weights.items():
        out = F.when(source == "=" + name, F.array(*[F.lit(int(x)) for x in w])).otherwise(out)
    return out


def mix(docs: DataFrame, curriculum: Curriculum = PRODUCTION, budget: int | None = None, source: str = "source", key: str = "doc_id", text: str = "text", salt: str = "mix", rows_per_bucket: int = 20_000, carry: list[str] | None = None, whole: bool = True) -> DataFrame:
    """Documents with ``n_tokens`` and ``position`` in [0, 1], range-sorted by position.

    Within a source, documents come in the order of a salted hash of their key.  ``whole`` takes every document of the
    sources with any weight: the budget is the largest that any of them can fill, max of supply / share, and a scarcer
    source runs out before the end.  With ``whole=False`` the budget is the largest one that no source falls short of,
    min of supply / share, and ``budget`` gives it as a number of training tokens; then a document is used while its
    source's earlier tokens are below the demand, and those beyond it are left out.  A source without weight or without
    a single token has no position in any case.

    ``carry`` names the columns of ``docs`` to return with ``n_tokens`` and ``position`` (default: key and
    source); columns of those two names are replaced.  Tokens are whitespace-separated; a null or empty text has
    0 tokens and takes the position of its turn; null keys and sources are values like others; repeated rows
    follow one another.  An empty table gives an empty result.

    Prefix sums are two-level, per (source, hash bucket) and then within the bucket, so a hot source is spread
    over many tasks.
    """
    spark = docs.sparkSession
    carry = [key, source] if carry is None else carry
    kept = [c for c in carry if c not in ("n_tokens", "position")]
    k, n = curriculum.knots, len(curriculum.knots)
    rows = docs.count()
    buckets = max(1, -(-rows // rows_per_bucket))
    digest = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.lit("|" + salt))), 1, 15), 16, 10).cast("long")
    # Reserved names cannot clash with the carried ones: everything else is packed into one struct.
    base = docs.select(F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("")).alias("__s"), digest.alias("__h"), F.col(f"`{key}`").alias("__k"), _token_count(F.col(f"`{text}`")).alias("__n"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"))
    base = base.withColumn("__b", F.expr(f"cast((__h * {buckets}D) / {float(1 << 60)!r}D as int)"))

    # One row per source and bucket, written: the texts are counted once for it and once for the rows themselves.
    sums = written(base.groupBy("__s", "__b").agg(F.sum("__n").alias("__t")), "mixing-sums")
    before = sums.withColumn("__before", F.sum("__t").over(Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).select("__s", "__b", F.coalesce("__before", F.lit(0)).alias("__before"))
    supply = sums.groupBy("__s").agg(F.sum("__t").alias("__supply")).where("__supply > 0").withColumn("__w", _weights(F.col("__s"), curriculum))
    totals = supply.agg(*[F.sum(F.col("__w")[i]).alias(f"z{i}") for i in range(n)])
    share = supply.crossJoin(F.broadcast(totals))
    for i in range(n):
        share = share.withColumn(f"w{i}", F.when(F.col(f"z{i}") > 0, F.col("__w")[i] / F.col(f"z{i}")).otherwise(F.lit(0.0)))
    for i in range(n):
        share = share.withColumn(f"c{i}", F.lit(0.0) if i == 0 else F.col(f"c{i - 1}") + (F.lit(float(k[i] - k[i - 1])) * (F.col(f"w{i - 1}") + F.col(f"w{i}"))) / F.lit(2.0))
    share = share.select("__s", "__supply", *[f"w{i}" for i in range(n)], *[f"c{i}" for i in range(n)])
    if budget is None:
        total = share.where(f"c{n - 1} > 0").agg((F.max if whole else F.min)(F.col("__supply") / F.col(f"c{n - 1}")).alias("__T"))
    else:
        total = spark.range(1).select(F.lit(float(budget)).alias("__T"))
    plan = before.join(share.crossJoin(F.broadcast(total)), "__s")

    run = Window.partitionBy("__s", "__b").orderBy("__h", "__k", "__n", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    # Only columns that are carried decide between rows that tie in everything else.
    tie = F.xxhash64("__row") if kept else F.lit(0)
    placed = base.withColumn("__tie", tie).withColumn("__in", F.coalesce(F.sum("__n").over(run), F.lit(0)))
    joined = placed.join(plan.drop("__supply"), ["__s", "__b"])
    x = (F.col("__before") + F.col("__in")) / F.col("__T")
    if whole and budget is None:
        # The last texts may be empty: they are at the very end of the demand.
        joined = joined.where(f"c{n - 1} > 0").withColumn("__x", F.least(x, F.col(f"c{n - 1}")))
    else:
        joined = joined.withColumn("__x", x).where(F.col("__x") < F.col(f"c{n - 1}"))
    position = None
    for i in reversed(range(n - 1)):
        width = float(k[i + 1] - k[i])
        d = F.col("__x") - F.col(f"c{i}")
        a, slope = F.col(f"w{i}"), (F.col(f"w{i + 1}") - F.col(f"w{i}")) / F.lit(width)
        # a*u + slope*u^2/2 = d, solved without cancellation.
        root = F.sqrt(F.greatest(a * a + F.lit(2.0) * slope * d, F.lit(0.0)))
        u = F.when(d <= 0, F.lit(0.0)).otherwise((F.lit(2.0) * d) / (a + root))
        here = F.lit(float(k[i])) + u
        position = here if position is None else F.when(F.col("__x") < F.col(f"c{i + 1}"), here).otherwise(position)
    out = joined.select("__row.*", F.col("__n").alias("n_tokens"), F.round(position, 9).alias("position"), "__h", "__k") if kept else joined.select(F.col("__n").alias("n_tokens"), F.round(position, 9).alias("position"), "__h", "__k")
    return out.orderBy("position", "__h", "__k").drop("__h", "__k")
