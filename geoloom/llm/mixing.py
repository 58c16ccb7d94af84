"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells of (source, language, topic); the cells' token
weights are raked to the target shares of each margin in turn until all margins
hold. ``rate * weight / tokens`` is then the probability with which a cell's
documents are sampled. The rate is the largest at which no probability exceeds
1, so that the sample's expected shares are the targets; a larger one has to be
asked for, and :func:`reached_shares` tells what it misses.

Everything is DataFrame operations. Cells are summed map-side before any shuffle,
so a source that holds a third of all rows costs no more than another.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from geoloom.llm.corpus import table, unused
from geoloom.sources.shared import materialise

MARGINS = ("source", "lang", "topic")
FEW_CELLS = 50_000  # up to so many, cells are raked in one partition and broadcast; beyond, both are shuffled
TOLERANCE = 1e-12  # largest relative miss of a margin at which raking ends
ROUNDS = 4  # raked between two looks at the margins
SIGNS = "#&*%$|!"


def form_topic(text: Column) -> Column:
    """A topic from the form of a text, for corpora without a topic column: its length and its share of signs."""
    text = F.coalesce(text, F.lit(""))
    signs = F.length(text) - F.length(F.translate(text, SIGNS, ""))
    return F.when(signs * 100 > F.length(text), "marked").when(F.length(text) < 600, "note").when(F.length(text) < 6000, "article").otherwise("long")


def n_tokens(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def smoothed_shares(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Target shares of a margin: its token shares to a power, normalised. Power 0 makes them equal."""
    by = cells.groupBy(margin).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("s"))
    return by.select(margin, (F.col("s") / F.lit(by.agg(F.sum("s")).first()[0] or 1.0)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, most_rounds: int = 400) -> DataFrame:
    """Add ``weight`` to ``cells`` (margins and ``tokens``) so that each margin's shares of it are the targets.

    ``targets`` maps a margin to a table of its values and ``share``; shares of values
    that stand in a cell are brought to a sum of 1. A value without a target gets
    weight 0. Cells without tokens have weight 0. Rounds end when every margin holds
    within ``tolerance``; where empty cells make targets contradict each other they
    end at ``most_rounds`` with a warning that names the largest miss, and
    :func:`reached_shares` shows the rest. An empty table stays empty.
    """
    n, total = cells.agg(F.count("*"), F.coalesce(F.sum("tokens").cast("double"), F.lit(0.0))).first()
    few = n <= FEW_CELLS
    out = cells.withColumn("weight", F.col("tokens").cast("double"))
    for margin, target in targets.items():
        known = target.join(cells.select(margin).distinct(), margin)
        share = (F.col("share") / F.lit(known.agg(F.sum("share")).first()[0] or 1.0)).alias(f"share_{margin}")
        out = out.join(known.select(margin, share), margin, "left").fillna(0.0, [f"share_{margin}"])

    def sums(margin: str) -> Column:
        return F.sum("weight").over(Window.partitionBy(margin))

    missed = [F.abs(sums(m) / F.lit(total) - F.col(f"share_{m}")) / F.col(f"share_{m}") for m in targets]
    targeted = reduce(lambda a, b: a & b, [F.col(f"share_{m}") > 0 for m in targets])
    miss = None
    for _ in range(0, most_rounds, ROUNDS):
        out = out.drop("missed")
        out = out.coalesce(1) if few else out  # one partition needs no shuffle for a window
        for _ in range(ROUNDS):
            for margin in targets:
                out = out.withColumn("weight", F.coalesce(F.col("weight") * F.col(f"share_{margin}") * F.lit(total) / F.nullif(sums(margin), F.lit(0.0)), F.lit(0.0)))
        out = materialise(out.withColumn("missed", F.when(targeted, F.greatest(*missed, F.lit(0.0)))), "raked")
        miss = out.agg(F.max("missed")).first()[0]
        if miss is None or miss <= tolerance:
            break
    if miss is not None and miss > tolerance:
        warnings.warn(f"raking ended after {most_rounds} rounds; a margin is missed by {miss:.2%} of its target", stacklevel=2)
    return out.drop("missed")


def feasible_rate(raked: DataFrame) -> float:
    """The largest rate, up to 1, at which every cell's ``rate * weight / tokens`` is a probability."""
    most = raked.where("weight > 0").agg(F.max(F.col("weight") / F.col("tokens"))).first()[0]
    return min(1.0, 1 / most) if most else 1.0


def reached_shares(raked: DataFrame, targets: dict[str, DataFrame], rate: float) -> DataFrame:
    """``margin, value, target, reached``: what sampling at ``rate`` gives of each target, in expectation."""
    got = F.least(F.lit(rate) * F.col("weight"), F.col("tokens").cast("double"))
    every = F.broadcast(raked.agg(F.sum(got).alias("every")))
    parts = [
        target.join(raked.groupBy(m).agg(F.sum(got).alias("got")), m, "left").crossJoin(every)
        .select(F.lit(m).alias("margin"), F.col(m).cast("string").alias("value"), F.col("share").alias("target"), (F.coalesce("got", F.lit(0.0)) / F.col("every")).alias("reached"))
        for m, target in targets.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) from the document's id, or from its text where that is null."""
    name = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), text, F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def has_topic(docs: DataFrame) -> bool:
    """Has ``docs`` a topic column, in any case."""
    return "topic" in {c.lower() for c in docs.columns}


def mix_cells(docs: DataFrame) -> DataFrame:
    """Token sums of the cells of ``docs``; null values of a margin are a value of their own."""
    topic = F.col("topic") if has_topic(docs) else form_topic(F.col("text"))
    margin = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic}
    by = [F.coalesce(c.cast("string"), F.lit("(none)")).alias(m) for m, c in margin.items()]
    return docs.groupBy(*by).agg(F.sum(n_tokens(F.col("text"))).alias("tokens")).where("tokens > 0")


def sample_to_targets(docs: DataFrame, powers: dict[str, float] | None = None, rate: float | None = None, seed: str = "mix") -> DataFrame:
    """The sampled rows of ``docs`` with ``topic, n_tokens, probability`` added.

    ``powers`` has each margin's power for :func:`smoothed_shares`. Without ``rate``
    it is the :func:`feasible_rate`. A ``topic`` column of ``docs``, in any case, is the topic, else
    it is made by :func:`form_topic`. Null values of a margin are a value of their
    own. Texts without tokens (null, empty) have probability 0. Repeated rows are
    kept or left together. Other columns stay as they are; an own ``n_tokens`` or
    ``probability`` column is replaced. An empty table gives no rows.
    """
    powers = powers or {"source": 0.0, "lang": 0.5, "topic": 0.5}
    docs = docs.drop("n_tokens", "probability")
    cells = materialise(mix_cells(docs), "mix_cells")
    raked = rake(cells, {m: smoothed_shares(cells, m, p) for m, p in powers.items()})
    rate = feasible_rate(raked) if rate is None else rate
    few = raked.count() <= FEW_CELLS
    if not has_topic(docs):
        docs = docs.withColumn("topic", form_topic(F.col("text")))
    docs = docs.withColumn("n_tokens", n_tokens(F.col("text")))
    inner = dict(zip(MARGINS, unused(docs, *(f"_{m}" for m in MARGINS))))
    cell = raked.select(*(F.col(m).alias(c) for m, c in inner.items()), F.round(F.least(F.lit(1.0), F.lit(rate) * F.col("weight") / F.col("tokens")), 9).alias("probability"))
    cell = F.broadcast(cell) if few else cell.hint("merge")
    both = docs.join(cell, [F.coalesce(F.col(m).cast("string"), F.lit("(none)")) == F.col(c) for m, c in inner.items()])
    return both.where((F.col("n_tokens") > 0) & (uniform(F.col("doc_id"), F.col("text"), seed) < F.col("probability"))).drop(*inner.values())


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return sample_to_targets(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "n_tokens", "probability")


def _op10_sql(rounds: int = 32) -> str:
    """Raking in SQL, in more rounds than it takes to converge."""
    parts = [r"""
WITH t AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS text,
    CASE WHEN (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#&*%$|!', ''))) * 100 > length(coalesce(text, '')) THEN 'marked'
         WHEN length(coalesce(text, '')) < 600 THEN 'note' WHEN length(coalesce(text, '')) < 6000 THEN 'article' ELSE 'long' END AS topic,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents
), d AS (
  SELECT *, coalesce(source, '(none)') AS s, coalesce(lang, '(none)') AS l FROM t
), cells AS MATERIALIZED (
  SELECT s, l, topic AS p, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0
)"""]
    for m, power in (("s", 0.0), ("l", 0.5), ("p", 0.5)):
        parts.append(f"share_{m} AS (SELECT {m}, pow(sum(tokens), {power}) / sum(pow(sum(tokens), {power})) OVER () AS share_{m} FROM cells GROUP BY {m})")
    parts.append("r0 AS (SELECT *, sum(tokens) OVER () AS total, tokens AS weight FROM cells JOIN share_s USING (s) JOIN share_l USING (l) JOIN share_p USING (p))")
    before = "r0"
    for i in range(rounds):
        for m in "slp":
            now = f"r{i}{m}"
            parts.append(f"{now} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(weight) OVER (PARTITION BY {m}) > 0 THEN weight * share_{m} * total / sum(weight) OVER (PARTITION BY {m}) ELSE 0 END AS weight) FROM {before})")
            before = now
    parts.append(f"c AS (SELECT s, l, p, round(least(1.0, least(1.0, 1 / (SELECT max(weight / tokens) FROM {before} WHERE weight > 0)) * weight / tokens), 9) AS probability FROM {before})")
    return ", ".join(parts) + """
SELECT doc_id, source, lang, topic, n_tokens, probability FROM d JOIN c ON c.s = d.s AND c.l = d.l AND c.p = d.topic
WHERE n_tokens > 0 AND CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), text)), 1, 8) AS BIGINT) / 4294967296.0 < probability
"""


OP10_SQL = _op10_sql()
