"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source of n rows and target share w gets the rate  w * total / n.  Each document draws
its copies from a Poisson distribution with that mean by inverting the cumulative
distribution at a number in [0, 1) hashed from (seed, doc_id, text digest), so the draw
does not depend on partitioning, retries or order.  The copies are exploded and dealt
out globally by another hash.

The cumulative tables are one row per source.  They are broadcast only while their number
is at most ``BROADCAST_SOURCES`` (counted first); beyond that documents and tables meet in
a join salted over ``SALTS`` keys, so a source with a third of all rows is spread.

Targets: share of each source in the output; sources not named share ``rest`` in
proportion to n^tempering.  With no targets all sources do: n^0.5 by default.

Cases: null source is a source of its own.  Null doc_id or text hash as "-".  Repeated
rows draw the same number.  A rate above MAX_RATE, where exp(-rate) would lose digits, is
drawn as a sum of independent draws of equal rates below it, each from a hash of its own.
An empty table gives no rows.  Only the added columns copy and mix_key are reserved; a
document column of that name is replaced.  Columns made on the way take names that no
column of ``docs`` has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import stash

BROADCAST_SOURCES = 50_000
SALTS = 64
#: Greatest rate of one draw: exp(-rate) is a normal double up to 708.
MAX_RATE = 700.0
SEED = "mix-1"


def unit(*parts: Column | str) -> Column:
    """A double in [0, 1) from 52 bits of an md5 over the parts."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def _tempered(counts: DataFrame, targets: dict[str, float] | None, tempering: float) -> tuple[DataFrame, int]:
    """(source, n, rate) of a written table (source, n), and the number of sources."""
    named = targets or {}
    if any(w < 0 for w in named.values()) or sum(named.values()) > 1:
        raise ValueError("target shares are not negative and add to at most 1")
    share = F.lit(None).cast("double")
    for name, w in named.items():
        share = F.when(F.col("source") == name, F.lit(float(w))).otherwise(share)
    weight = F.when(F.col("share").isNull(), F.pow(F.col("n").cast("double"), F.lit(tempering)))
    n = counts.withColumn("share", share).withColumn("weight", weight)
    # one row over the sources; rounded, so that the order of summing does not show
    total = n.agg(F.sum("n").alias("total"), F.round(F.sum("weight"), 6).alias("weights"), F.round(F.lit(1.0) - F.coalesce(F.sum("share"), F.lit(0.0)), 9).alias("rest"), F.count("*").alias("sources")).first()
    each = F.coalesce(F.col("share"), F.lit(total.rest) * F.col("weight") / F.lit(total.weights))
    return n.select("source", "n", (each * F.lit(float(total.total or 0)) / F.col("n")).alias("rate")), total.sources


def rates(docs: DataFrame, targets: dict[str, float] | None = None, tempering: float = 0.5) -> DataFrame:
    """source, n, rate: one row per source."""
    return _tempered(stash(docs.groupBy("source").agg(F.count("*").alias("n")), "sources"), targets, tempering)[0]


def _cumulative(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... as an array, up to where it is 1 but for rounding."""
    last = F.ceil(rate + 10 * F.sqrt(rate) + 12).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["all"])


def mix(docs: DataFrame, targets: dict[str, float] | None = None, tempering: float = 0.5, seed: str = SEED, shuffle: bool = True) -> DataFrame:
    """``docs`` replicated: its columns, copy (from 1) and mix_key, in the order of mix_key."""
    columns = [c for c in docs.columns if c.lower() not in ("copy", "mix_key")]
    docs = docs.select(*(F.col(f"`{c}`") for c in columns))
    used = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        while name in used:
            name += "_"
        return name

    text, u, name, parts, below, salt, pick, draws, place = map(free, ("mix_text", "mix_u", "mix_source", "mix_parts", "mix_below", "mix_salt", "mix_pick", "mix_draws", "mix_place"))
    counts = stash(docs.groupBy("source").agg(F.count("*").alias("n")), "sources")
    table, sources = _tempered(counts, targets, tempering)
    table = table.withColumn(parts, F.greatest(F.ceil(F.col("rate") / MAX_RATE), F.lit(1)).cast("int")).select(F.col("source").alias(name), parts, _cumulative(F.col("rate") / F.col(parts)).alias(below))
    # hashed before the join, so that nothing later computes them once per entry of a table
    docs = docs.withColumn(text, F.md5(F.coalesce(F.col("text"), F.lit("-")))).withColumn(u, unit(seed, F.col("doc_id"), F.col(text)))
    same = F.col("source").eqNullSafe(F.col(name))
    if sources <= BROADCAST_SOURCES:
        met = docs.join(F.broadcast(table), same)
    else:
        salted = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = docs.withColumn(pick, F.pmod(F.xxhash64("doc_id", text), F.lit(SALTS)).cast("int")).join(salted, same & (F.col(pick) == F.col(salt)))

    def drawn(at: Column) -> Column:
        """One entry for each copy: the sums of probabilities that ``at`` reaches."""
        return F.filter(below, lambda c: c <= at)

    more = F.transform(F.sequence(F.lit(2), F.col(parts)), lambda k: drawn(unit(seed, F.col("doc_id"), F.col(text), k)))
    copies = F.when(F.col(parts) == 1, drawn(F.col(u))).otherwise(F.concat(drawn(F.col(u)), F.flatten(more)))
    out = met.select(*(F.col(f"`{c}`") for c in columns), text, F.posexplode(copies).alias(place, draws))
    out = out.withColumn("copy", F.col(place) + 1)
    out = out.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col(text), F.col("copy").cast("string")))).drop(text, place, draws)
    if not shuffle:
        return out
    # keys are even, so their ranges are known without a look at them
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lead = F.conv(F.substring("mix_key", 1, 7), 16, 10).cast("bigint")
    return out.repartitionById(n, F.shiftright(lead * F.lit(n), 28).cast("int")).sortWithinPartitions("mix_key")


#: DuckDB: the same replication, without the order.
ORACLE = """
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT sum(n) AS total, round(sum(pow(n::DOUBLE, 0.5)), 6) AS weights FROM n),
r AS (SELECT source, pow(n::DOUBLE, 0.5) / weights * total::DOUBLE / n AS rate FROM n, t),
below(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM r
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM below WHERE k < ceil(rate + 10 * sqrt(rate) + 12)
),
d AS (SELECT *, ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '-') || '|' || md5(coalesce(text, '-'))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents),
m AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.u, count(*) AS n FROM d JOIN below b ON b.source IS NOT DISTINCT FROM d.source AND b.c <= d.u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy,
  md5('mix-1|' || coalesce(doc_id::VARCHAR, '-') || '|' || md5(coalesce(text, '-')) || '|' || copy::VARCHAR) AS mix_key
FROM (SELECT m.*, unnest(range(1, n + 1)) AS copy FROM m)
"""
