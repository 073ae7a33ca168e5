"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Tokens are summed by source, language and topic. Languages and topics are as many as the
target names and one for the rest, so a source is one row with a short list of sums, however
many sources there are. A cycle rakes sources, then languages, then topics: it is one job over
those rows that returns a sum for each pair of language and topic to the driver. The cells'
weights then become probabilities min(1, scale * weight), with the scale that keeps the budget
of tokens in expectation, and a document stays if its hash is below its cell's probability.
Where cells reach 1, that scale keeps the budget but not the marginals. Bounded targets are raked
under the bound instead: a source's factor is solved exactly with its cells capped at 1, those of
languages and topics take what the capped cells leave. A value that has less than its part of the
budget gives all it has, and the others of its marginal share the rest. Cycles go on until the sums settle, by one rule at every number of sources. Either way Mix.shares has
wanted and reached shares, and those that are missed are logged as a warning.

Defined results: tokens are runs of characters other than space and 0x09-0x0D; a null text has
none; a null source or language counts as "". A document's topic is the first whose strings
it holds, else the last. Marginals of values without tokens are left out and the others
scaled to 1. Documents in cells without tokens have probability 0. Rows are kept one for one;
rows of one doc_id fall on the same side of their probabilities, and so do rows without one.
Very long texts are read whole where they lie and never moved. No documents give no rows.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

REST = "other"
LOG = logging.getLogger(__name__)


@dataclass(frozen=True)
class Targets:
    """Shares of tokens. Sources are weighed by their tokens to the power source_power, but for
    those that source_weights names (relative to that). budget: share of all tokens to keep.
    bounded: rake under the bound of 1. topic_column: a column that names the topic of each document, in place
    of signs; values that topics doesn't name count as the last."""

    languages: dict[str, float] = field(default_factory=lambda: {"en": 0.50, "de": 0.17, "fr": 0.17, "es": 0.14, REST: 0.02})
    topics: dict[str, float] = field(default_factory=lambda: {"legal": 0.10, "contact": 0.20, "table": 0.10, "prose": 0.60})
    #: Strings that show a topic, in order; the last topic needs none.
    signs: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"legal": ("icense", "ights reserved"), "contact": ("@", "+"), "table": (" | ",)})
    source_power: float = 0.5
    source_weights: dict[str, float] = field(default_factory=dict)
    budget: float = 0.15
    seed: int = 1
    bounded: bool = False
    topic_column: str | None = None


#: Cycles at most, at any number of sources, and the relative change of the factors at which they end. Marginals that contradict
#: each other near their limit slowly or not at all: then Mix.settled and the result's column settled are false.
CYCLES = 5_000
SETTLED = 1e-9
#: Rounds that the scale of the probabilities takes at most; each caps more cells, or it is the last.
SCALE_ROUNDS = 400
#: Sources up to so many are raked under the bound on the driver, without a job for each cycle: some MB. The cycles, and
#: when they end, are the same.
FEW = 10_000
#: A language's or topic's factor against the median one; those of marginals that contradict each other would grow for ever.
#: A mix with a factor there hasn't settled.
FARTHEST = 1e9
#: Bounded raking ends when the cells' sums change by less than this share of all tokens.
BOUNDED_SETTLED = 1e-13
#: It counts as settled where they change by no more than this when the cycles end.
NEARLY = 1e-9
#: Shares that are further from what was wanted are told.
TOLD = 1e-3


def _index(value: Column, names: list[str]) -> Column:
    """The place of a value in names, or of the last."""
    out = F.lit(len(names) - 1)
    for k in reversed(range(len(names) - 1)):
        out = F.when(value == names[k], k).otherwise(out)
    return out


def _languages(t: Targets) -> list[str]:
    return [x for x in t.languages if x != REST] + [REST]


def topic_of(text: Column, t: Targets) -> Column:
    """The place of a text's topic among t.topics."""
    out = F.lit(len(t.topics) - 1)
    names = list(t.topics)
    for name in reversed(list(t.signs)):
        hit = F.lit(False)
        for s in t.signs[name]:
            hit |= F.contains(text, F.lit(s))
        out = F.when(hit, names.index(name)).otherwise(out)
    return out


def _celled(docs: DataFrame, t: Targets, *more: Column) -> DataFrame:
    """The columns in more, and source_key and cell (language and topic) of every document."""
    text = F.coalesce("text", F.lit(""))
    topic = _index(F.coalesce(F.col(t.topic_column).cast("string"), F.lit("")), list(t.topics)) if t.topic_column else topic_of(text, t)
    cell = _index(F.coalesce("lang", F.lit("")), _languages(t)) * len(t.topics) + topic
    return docs.select(*more, F.coalesce("source", F.lit("")).alias("source_key"), cell.alias("cell"))


def n_tokens() -> Column:
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def _scaled(share: dict[str, float], names: list[str], sums: np.ndarray) -> np.ndarray:
    out = np.where(sums > 0, [max(0.0, share.get(n, 0.0)) for n in names], 0.0)
    return out / out.sum() if out.sum() else np.where(sums > 0, 1.0, 0.0) / max(1, (sums > 0).sum())


def _doubles(values) -> Column:
    """A constant list. As one, it is data to the compiled plan: other values need no new code."""
    return F.array(*(F.lit(float(v)) for v in values))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _where(cells: list[float], scale: float, capped: bool) -> Column:
    """A source's tokens in cells whose probability the scale caps at 1, or the other cells' weighted tokens."""
    a = F.col("a")
    if capped:
        return F.zip_with("t", _doubles(cells), lambda x, c: F.when(a * c * scale >= 1, x).otherwise(0.0))
    return F.zip_with("t", _doubles(cells), lambda x, c: F.when(a * c * scale >= 1, 0.0).otherwise(x * a * c))


def _within(share: np.ndarray, most: np.ndarray, total: float) -> np.ndarray:
    """total dealt by share, but no more than most to each."""
    out, free = np.zeros_like(share), share > 0
    while free.any():
        out[free] = max(0.0, total - out[~free].sum()) * share[free] / share[free].sum()
        over = free & (out > most)
        if not over.any():
            break
        out[over] = most[over]
        free &= ~over
    return out


def _source_factor(f: np.ndarray) -> Column:
    """The factor with which a source's tokens, cells capped at 1, come to its goal. They are the least of
    full + factor * share over all sets of capped cells that hold those of the largest f, so it is the largest of (goal - full) / share."""
    order = [int(c) for c in np.argsort(f, kind="stable") if f[c] > 0]
    if not order:
        return F.lit(0.0)
    by_order = F.transform(F.array(*(F.lit(c + 1) for c in order)), lambda c: F.element_at("t", c))
    cells = F.zip_with(by_order, _doubles(f[order]), lambda x, y: F.struct(x.alias("t"), y.alias("f")))
    start = F.struct(F.lit(0.0).alias("share"), F.col("most").alias("full"), F.lit(0.0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        share, full = s["share"] + x["t"] * x["f"], s["full"] - x["t"]
        return F.struct(share.alias("share"), full.alias("full"), F.when(share > 0, F.greatest(s["best"], (F.col("goal") - full) / share)).otherwise(s["best"]).alias("best"))

    return F.aggregate(cells, start, step, lambda s: s["best"])


def _few_factors(t: np.ndarray, most: np.ndarray, goal: np.ndarray, f: np.ndarray) -> np.ndarray:
    """_source_factor() of rows on the driver."""
    order = [c for c in np.argsort(f, kind="stable") if f[c] > 0]
    share, full = np.cumsum(t[:, order] * f[order], 1), most[:, None] - np.cumsum(t[:, order], 1)
    return np.divide(goal[:, None] - full, share, out=np.zeros_like(share), where=share > 0).max(1, initial=0.0)


def _bounded(sources: DataFrame, by_cell: np.ndarray, lang_share: np.ndarray, topic_share: np.ndarray, budget: float, cycles: int) -> tuple[DataFrame, np.ndarray, bool]:
    """sources: source_key, t, wanted. Returns them with their factors a, the cells' factors, for probabilities min(1, a * f), and whether they settled."""
    used = (lang_share[:, None] > 0) & (topic_share[None, :] > 0)
    have = by_cell * used
    budget = min(budget, have.sum())
    most = _total(F.zip_with("t", _doubles(used.ravel()), lambda x, u: x * u))
    sources = materialize(sources.select("source_key", "t", "wanted", most.alias("most")), "mix-most")
    per, before = 0.0, -1.0
    while per > before * (1 + 1e-12):  # each round caps more sources, or it is the last
        open_ = F.col("most") > F.col("wanted") * per
        full, share = sources.agg(F.sum(F.when(open_, 0.0).otherwise(F.col("most"))), F.sum(F.when(open_, F.col("wanted")).otherwise(0.0))).first()
        before, per = per, max(per, (budget - full) / share) if share else per
    sources = sources.withColumn("goal", F.least("most", F.col("wanted") * per))
    goals = _within(lang_share, have.sum(1), budget), _within(topic_share, have.sum(0), budget)
    few = sources.limit(FEW + 1).select("t", "most", "goal").collect()
    few = [np.array([r[k] for r in few], float) for k in range(3)] if len(few) <= FEW else None

    def held(under: np.ndarray, f: np.ndarray) -> np.ndarray:
        """By cell, with the sources' factors for under: tokens in capped cells, weighted tokens in others."""
        if few:
            x = few[0] * (a := _few_factors(*few, under.ravel()))[:, None] * f.ravel()
            full = a[:, None] * f.ravel() >= 1
            return np.array([np.where(full, few[0], 0.0).sum(0), np.where(full, 0.0, x).sum(0)])
        rows = sources.select("t", _source_factor(under.ravel()).alias("a"))
        rows = rows.select(*(_where(list(f.ravel()), 1.0, capped).alias(name) for name, capped in (("full", True), ("part", False))))
        return np.array(rows.agg(*(F.sum(F.col(name)[k]).alias(f"{name}{k}") for name in ("full", "part") for k in range(f.size))).first(), float).reshape(2, -1)

    factors, last, moved = [np.ones(n) for n in used.shape], None, np.inf
    for _ in range(cycles):
        factors = [x / np.median(x) for x in factors]
        f = under = used * np.outer(*factors)
        for axis, goal in ((1, goals[0]), (0, goals[1])):
            cells = held(under, f).reshape(2, *f.shape)
            full, share = cells[0].sum(axis), cells[1].sum(axis)
            by = np.ones_like(goal)
            for k in range(len(goal)):
                if share[k] > 0 and goal[k] > full[k]:
                    by[k] = (goal[k] - full[k]) / share[k]
                elif full[k] + share[k] > goal[k]:
                    by[k] = goal[k] / (full[k] + share[k])
            factors[1 - axis] = np.clip(factors[1 - axis] * by, 1 / FARTHEST, FARTHEST)
            f = used * np.outer(*factors)
        now = cells[0] + cells[1]
        moved = np.abs(now - last).max() / by_cell.sum() if last is not None else np.inf
        if moved <= BOUNDED_SETTLED:
            break
        last = now
    clipped = any((x * FARTHEST <= 1).any() or (x >= FARTHEST).any() for x in factors)
    return sources.select("source_key", "t", "wanted", _source_factor(under.ravel()).alias("a")), f, bool(moved <= NEARLY and not clipped)


@dataclass(frozen=True)
class Mix:
    """sources: source_key, a (its factor); cells: the factor of each cell; scale of probabilities;
    shares: (marginal, value, wanted share, reached share) of each language and topic and of the source furthest off;
    settled: whether raking and the scale came to an end before their cycles did."""

    sources: DataFrame
    cells: list[float]
    scale: float
    shares: list[tuple[str, str, float, float]]
    settled: bool = True

    def probability(self) -> Column:
        """For rows with a and cell."""
        return F.least(F.lit(1.0), F.coalesce(F.lit(self.scale) * F.col("a") * F.element_at(F.array(*map(F.lit, self.cells)), F.col("cell") + 1), F.lit(0.0)))


def fit(docs: DataFrame, t: Targets = Targets(), cycles: int = CYCLES) -> Mix:
    """Rakes the weights of documents (text, lang, source)."""
    return fit_cells(_celled(docs, t, n_tokens().alias("tokens")), t, cycles)


def fit_cells(celled: DataFrame, t: Targets, cycles: int = CYCLES) -> Mix:
    """celled: source_key, cell, tokens of every document."""
    langs, n_topics = _languages(t), len(t.topics)
    width = len(langs) * n_topics
    sums = celled.groupBy("source_key", "cell").agg(F.sum("tokens").alias("tokens"))
    own = F.array(*(F.coalesce(F.sum(F.when(F.col("cell") == k, F.col("tokens"))), F.lit(0)).cast("double") for k in range(width)))
    sources = sums.groupBy("source_key").agg(own.alias("t"), F.sum("tokens").cast("double").alias("total")).filter("total > 0")
    wanted = F.pow("total", F.lit(t.source_power))
    for name, w in t.source_weights.items():
        wanted = F.when(F.col("source_key") == name, wanted * w).otherwise(wanted)
    sources = materialize(sources.withColumn("wanted", wanted), "mix-sources")

    by_column = [F.sum(F.col("a") * F.col("t")[k]).alias(f"c{k}") for k in range(width)]

    def cell_sums(factor: Column) -> np.ndarray:
        row = sources.select("t", factor.alias("a")).agg(*by_column).first()
        return np.array([x or 0.0 for x in row], float)

    all_wanted, all_tokens = sources.agg(F.sum("wanted"), F.sum("total")).first()
    by_cell = cell_sums(F.lit(1.0)).reshape(len(langs), n_topics)
    lang_share, topic_share = _scaled(t.languages, langs, by_cell.sum(1)), _scaled(t.topics, list(t.topics), by_cell.sum(0))
    f = np.ones((len(langs), n_topics))
    quotient = lambda top, under: np.divide(top, under, out=np.zeros_like(top), where=under > 0)
    factor, settled = F.lit(0.0), True
    for _ in range(cycles if all_tokens and not t.bounded else 0):
        inner = _total(F.zip_with("t", _doubles(f.ravel()), lambda x, y: x * y))
        factor = F.when(inner > 0, F.col("wanted") / F.lit(float(all_wanted)) * F.lit(float(all_tokens)) / inner).otherwise(0.0)
        g = cell_sums(factor).reshape(f.shape)
        before = f
        f = f * quotient(lang_share * all_tokens, (g * f).sum(1))[:, None]
        f = f * quotient(topic_share * all_tokens, (g * f).sum(0))[None, :]
        if np.allclose(f, before, rtol=SETTLED, atol=0):
            break
    else:
        settled = not all_tokens or t.bounded
    made = sources.select("source_key", "t", "wanted", factor.alias("a"))
    if t.bounded and all_tokens:
        made, f, settled = _bounded(sources, by_cell, lang_share, topic_share, t.budget * all_tokens, cycles)
    cells = [float(x) for x in f.ravel()]
    sources = materialize(made, "mix-factors")
    # the scale that keeps the budget: cells at probability 1 give what they have, the others share the rest
    scale, budget = 1.0 if t.bounded else t.budget, t.budget * (all_tokens or 0)
    for _ in range(SCALE_ROUNDS if all_tokens and not t.bounded else 0):
        full, share = sources.agg(F.sum(_total(_where(cells, scale, capped=True))), F.sum(_total(_where(cells, scale, capped=False)))).first()
        new = max(scale, (budget - full) / share) if share else scale
        if abs(new - scale) <= 1e-12 * scale:
            break
        scale = new
    else:
        settled = settled and (not all_tokens or t.bounded)
    if not settled:
        LOG.warning("the mix didn't settle in %d cycles", cycles)
    shares = _shares(sources, cells, scale, all_wanted, {"language": (langs, lang_share), "topic": (list(t.topics), topic_share)}) if all_tokens else []
    for marginal, value, wanted, reached in shares:
        if abs(wanted - reached) > TOLD:
            LOG.warning("the mix misses its target: %s %r has %.4f of the kept tokens, wanted %.4f", marginal, value, reached, wanted)
    return Mix(sources.select("source_key", "a"), cells, float(scale), shares, settled)


def _shares(sources: DataFrame, cells: list[float], scale: float, all_wanted: float, marginals: dict[str, tuple[list[str], np.ndarray]]) -> list[tuple[str, str, float, float]]:
    """Wanted and reached shares of the tokens that are kept in expectation; sources: source_key, t, wanted, a."""
    kept = sources.select("source_key", "wanted", F.zip_with("t", _doubles(cells), lambda x, c: x * F.least(F.lit(1.0), F.col("a") * c * scale)).alias("kept"))
    row = np.array([x or 0.0 for x in kept.agg(*(F.sum(F.col("kept")[k]).alias(f"c{k}") for k in range(len(cells)))).first()], float)
    if not row.sum():
        return []
    by_cell, out = row.reshape([len(names) for names, _ in marginals.values()]) / row.sum(), []
    for axis, (marginal, (names, share)) in zip((1, 0), marginals.items(), strict=True):
        out += [(marginal, n, float(w), float(r)) for n, w, r in zip(names, share, by_cell.sum(axis), strict=True)]
    both = kept.select("source_key", (F.col("wanted") / float(all_wanted)).alias("w"), (_total(F.col("kept")) / float(row.sum())).alias("r"))
    worst = both.agg(F.max_by(F.struct("source_key", "w", "r"), F.abs(F.col("w") - F.col("r"))).alias("x")).first()["x"]
    return [*out, ("source", *worst)]


def uniform(seed: int) -> Column:
    """A number from 0 to below 1 for each doc_id."""
    digits = F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 32))


def mixed_documents(docs: DataFrame, t: Targets = Targets()) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability, sampled of every document, the shares of the kept
    tokens, as wanted and as reached in expectation, of its language and topic, and whether the mix has settled."""
    names = F.array(*map(F.lit, t.topics))
    celled = materialize(_celled(docs, t, F.col("doc_id"), F.col("source"), F.col("lang"), n_tokens().alias("tokens")), "mix-documents")
    mix = fit_cells(celled, t)
    made = celled.join(mix.sources, "source_key", "left").withColumn("probability", mix.probability())
    topic = F.element_at(names, F.col("cell") % len(t.topics) + 1)
    langs, n = _languages(t), len(t.topics)
    of = {(marginal, value): pair for marginal, value, *pair in mix.shares if marginal != "source"}

    def share(marginal: str, values: list[str], place: Column, k: int) -> Column:
        return F.element_at(_doubles([of[marginal, v][k] if of else 0.0 for v in values]), place + 1)

    lang, at = F.floor(F.col("cell") / n).cast("int"), F.col("cell") % n
    shares = [share(m, values, place, k).alias(f"{m}_{name}") for m, values, place in (("language", langs, lang), ("topic", list(t.topics), at)) for k, name in enumerate(("wanted", "reached"))]
    return made.select("doc_id", "source", "lang", topic.alias("topic"), F.col("tokens").alias("n_tokens"), "probability", (uniform(t.seed) < F.col("probability")).alias("sampled"), *shares, F.lit(mix.settled).alias("settled"))


def sample_documents(docs: DataFrame, t: Targets = Targets()) -> DataFrame:
    """The documents that the mix keeps, with their columns."""
    names = docs.columns
    mix = fit(docs, t)
    celled = _celled(docs, t, F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("doc_id"))
    kept = celled.join(mix.sources, "source_key", "left").filter(uniform(t.seed) < mix.probability())
    return kept.select(*(F.col("row")[c].alias(c) for c in names))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixed_documents(table(spark, sf_dir, "documents"), Targets(bounded=True))
    return made.withColumns({"probability": F.round("probability", 6)} | {c: F.round(c, 4) for c in made.columns if c.endswith(("_wanted", "_reached"))})


def _filled(name: str, source: str, key: str, most: str, wanted: str) -> list[str]:
    """SQL of {name}(key, goal): the budget dealt by wanted, but no more than most to each."""
    return [
        f"""{name}_per AS (
          SELECT 0 AS n, 0.0::DOUBLE AS per
          UNION ALL SELECT n + 1, greatest(per, (SELECT (any_value(b.t) - coalesce(sum(x.{most}) FILTER (WHERE x.{most} <= x.{wanted} * r.per), 0)) / nullif(sum(x.{wanted}) FILTER (WHERE x.{most} > x.{wanted} * r.per), 0) FROM {source} x, budget b))
          FROM {name}_per r WHERE n < {SCALE_ROUNDS})""",
        f"{name} AS MATERIALIZED (SELECT {key}, least({most}, {wanted} * (SELECT max(per) FROM {name}_per)) AS goal FROM {source})",
    ]


#: Cycles of the bounded SQL: more than raking takes on the tables to settle.
SQL_CYCLES = 600


def _bounded_parts(t: Targets) -> list[str]:
    """SQL of p(source_key, l, k, p) for bounded targets, of cells, source_wanted, lang_share, topic_share and total."""
    by = lambda full, part, goal: f"CASE WHEN {part} > 0 AND {goal} > {full} THEN ({goal} - {full}) / {part} WHEN {full} + {part} > {goal} THEN {goal} / ({full} + {part}) ELSE 1 END"
    sums = lambda x, key: f"coalesce(sum(t) FILTER (WHERE {x} >= 1) OVER (PARTITION BY {key}), 0) AS full_{key}, coalesce(sum(t * {x}) FILTER (WHERE {x} < 1) OVER (PARTITION BY {key}), 0) AS part_{key}"
    order = "OVER (PARTITION BY source_key ORDER BY f, l, k ROWS UNBOUNDED PRECEDING)"
    return [
        "used AS MATERIALIZED (SELECT c.* FROM cells c JOIN lang_share ls USING (l) JOIN topic_share ts USING (k) WHERE ls.share > 0 AND ts.share > 0)",
        f"budget AS MATERIALIZED (SELECT least({t.budget} * (SELECT t FROM total), (SELECT sum(t) FROM used)) AS t)",
        "source_most AS MATERIALIZED (SELECT source_key, sum(t) AS most, any_value(share) AS wanted FROM used JOIN source_share USING (source_key) GROUP BY source_key)",
        "lang_most AS MATERIALIZED (SELECT l, sum(t) AS most, any_value(share) AS wanted FROM used JOIN lang_share USING (l) GROUP BY l)",
        "topic_most AS MATERIALIZED (SELECT k, sum(t) AS most, any_value(share) AS wanted FROM used JOIN topic_share USING (k) GROUP BY k)",
        *_filled("source_goal", "source_most", "source_key", "most", "wanted"),
        *_filled("lang_goal", "lang_most", "l", "most", "wanted"),
        *_filled("topic_goal", "topic_most", "k", "most", "wanted"),
        f"""raked AS (
          SELECT 0 AS n, source_key, l, k, u.t, most, s.goal, lg.goal AS goal_l, tg.goal AS goal_k, 1.0::DOUBLE AS f, 0.0::DOUBLE AS a
          FROM used u JOIN source_most USING (source_key) JOIN source_goal s USING (source_key) JOIN lang_goal lg USING (l) JOIN topic_goal tg USING (k)
          UNION ALL
          SELECT n + 1, source_key, l, k, t, most, goal, goal_l, goal_k, g * {by("full_k", "part_k", "goal_k")} AS f, a FROM (
            SELECT *, {sums("a * g", "k")} FROM (
              SELECT *, f * {by("full_l", "part_l", "goal_l")} AS g FROM (
                SELECT *, {sums("a * f", "l")} FROM (
                  SELECT * EXCLUDE (a, cum_t, cum_f), greatest(0, max(CASE WHEN cum_f > 0 THEN (goal - (most - cum_t)) / cum_f ELSE 0 END) OVER (PARTITION BY source_key)) AS a FROM (
                    SELECT *, sum(t) {order} AS cum_t, sum(t * f) {order} AS cum_f FROM raked WHERE n < {SQL_CYCLES}))))))""",
        # the last factors of languages and topics with the sources' factors that they were fitted to
        f"p AS MATERIALIZED (SELECT source_key, l, k, least(1.0, a * f) AS p FROM raked WHERE n = {SQL_CYCLES})",
        f"""settled AS (SELECT max(abs(x)) <= {NEARLY} * (SELECT t FROM total) AS settled FROM (
          SELECT sum(t * least(1.0, a * f) * CASE n WHEN {SQL_CYCLES} THEN 1 ELSE -1 END) AS x FROM raked WHERE n >= {SQL_CYCLES} - 1 GROUP BY l, k))""",
    ]


def oracle(documents: str = "documents", t: Targets = Targets(), cycles: int = 30) -> str:
    """SQL that gives every document of a table its topic, tokens, probability, whether it stays, and shares."""
    langs, topics = _languages(t), list(t.topics)
    lang = f"CASE coalesce(lang, '') {' '.join(f'WHEN {n!r} THEN {k}' for k, n in enumerate(langs[:-1]))} ELSE {len(langs) - 1} END"
    signs = " ".join(f"WHEN {' OR '.join(f'contains(text, {s!r})' for s in strings)} THEN {topics.index(n)}" for n, strings in t.signs.items())
    wanted = f"pow(total, {t.source_power})"
    if t.source_weights:
        wanted += f" * CASE source_key {' '.join(f'WHEN {n!r} THEN {w}' for n, w in t.source_weights.items())} ELSE 1 END"
    parts = [
        f"""docs AS (SELECT doc_id, source, lang, coalesce(source, '') AS source_key, {lang} AS l, CASE {signs} ELSE {len(topics) - 1} END AS k, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM {documents})""",
        "cells AS MATERIALIZED (SELECT source_key, l, k, CAST(sum(tokens) AS DOUBLE) AS t FROM docs GROUP BY ALL HAVING sum(tokens) > 0)",
        "total AS (SELECT sum(t) AS t FROM cells)",
        f"source_share AS MATERIALIZED (SELECT source_key, {wanted} / sum({wanted}) OVER () AS share FROM (SELECT source_key, sum(t) AS total FROM cells GROUP BY source_key))",
        *(
            f"{name}_share AS MATERIALIZED (SELECT {key}, w / sum(w) OVER () AS share FROM (SELECT DISTINCT {key} FROM cells) JOIN (VALUES {', '.join(f'({k}, {share.get(n, 0.0)})' for k, n in enumerate(names))}) v({key}, w) USING ({key}))"
            for name, key, names, share in (("lang", "l", langs, t.languages), ("topic", "k", topics, t.topics))
        ),
    ]
    if t.bounded:
        parts += _bounded_parts(t)
    else:
        parts.append("w0 AS (SELECT source_key, l, k, t, 1.0::DOUBLE AS w FROM cells)")
        n = 0
        for _ in range(cycles):
            for name, key in (("source", "source_key"), ("lang", "l"), ("topic", "k")):
                parts.append(f"w{n + 1} AS MATERIALIZED (SELECT source_key, l, k, w.t, w * share * total.t / sum(w.t * w) OVER (PARTITION BY {key}) AS w FROM w{n} w JOIN {name}_share USING ({key}), total)")
                n += 1
        parts.append(f"s0 AS (SELECT {t.budget}::DOUBLE AS s)")
        for r in range(12):
            parts.append(f"s{r + 1} AS MATERIALIZED (SELECT greatest(max(s), coalesce(({t.budget} * max(total.t) - coalesce(sum(c.t) FILTER (WHERE w * s >= 1), 0)) / nullif(sum(c.t * w) FILTER (WHERE w * s < 1), 0), 0)) AS s FROM w{n} c, s{r}, total)")
        parts.append(f"p AS MATERIALIZED (SELECT source_key, l, k, least(1.0, w * s) AS p FROM w{n}, s12)")
    uniform_sql = f"CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{t.seed}'), 1, 8) AS BIGINT) / 4294967296.0"
    names = ", ".join(f"'{x}'" for x in topics)
    for key in "lk":
        parts.append(f"reached_{key} AS MATERIALIZED (SELECT {key}, sum(t * p) / sum(sum(t * p)) OVER () AS reached FROM cells JOIN p USING (source_key, l, k) GROUP BY {key})")
    return f"""
    WITH RECURSIVE {", ".join(parts)}
    SELECT doc_id, source, lang, ([{names}])[docs.k + 1] AS topic, tokens AS n_tokens, round(coalesce(p, 0), 6) AS probability, {uniform_sql} < coalesce(p, 0) AS sampled,
      round(coalesce(ls.share, 0), 4) AS language_wanted, round(coalesce(rl.reached, 0), 4) AS language_reached, round(coalesce(ts.share, 0), 4) AS topic_wanted, round(coalesce(rk.reached, 0), 4) AS topic_reached, {"(SELECT settled FROM settled)" if t.bounded else "true"} AS settled
    FROM docs LEFT JOIN p USING (source_key, l, k) LEFT JOIN lang_share ls ON ls.l = docs.l LEFT JOIN topic_share ts ON ts.k = docs.k LEFT JOIN reached_l rl ON rl.l = docs.l LEFT JOIN reached_k rk ON rk.k = docs.k
    """


ORACLE = oracle(t=Targets(bounded=True))
