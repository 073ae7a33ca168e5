"""Quality rules: a decision list that sequential covering learns from labelled statistics.

Text statistics are made once a text, in numpy over Arrow slices. A bounded sample of labelled
rows (SAMPLE) that the base rules pass teaches the list: each rule is a conjunction of thresholds, grown on two thirds
of the rows by information gain, pruned on the rest, and taken while it is precise there. The
list leaves as one ordered Spark conditional expression, so it is applied inside the plan.

Very long texts are measured whole, one in memory at a time.

Defined results: null text has no words and fails the base rules; rows are kept one for one,
repeated rows and null doc_id included; without labels the list is empty and only the base
rules reject. A doc_id with several labels counts as so many rows of the sample; equal labels of one
doc_id teach once, by the text of the smallest counts where it has several texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, mapped, mixed, slices, table

#: Labelled rows that the list is learned from, at most: those of the smallest hashes.
SAMPLE = 8_000
WINDOW = 8
#: Statistics of a text, as counts.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim", "n_digits", "n_stops", "n_pipes", "n_echoes")
BASE = COUNTS[:5]
#: What rules look at: one count for each unit of another.
FEATURES = {
    "n_words": ("n_words", None),
    "mean_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "pipes_per_word": ("n_pipes", "n_words"),
    "exclaims_per_word": ("n_exclaim", "n_words"),
    "stops_per_word": ("n_stops", "n_words"),
    "digits_per_char": ("n_digits", "word_chars"),
    "upper_per_char": ("n_upper", "word_chars"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "repeats_per_word": ("n_repeat_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "echoes_per_word": ("n_echoes", "n_words"),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#*$%&|<>"]] = True
_BLANKS = b" \t\n\v\f\r"


def _repeated(words: Words, index: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Which words lie in a window of so many words that its text holds twice or more."""
    covered = np.zeros(len(index), bool)
    if len(index) < width:
        return covered
    n = len(index) - width + 1
    doc = np.repeat(np.arange(len(words.n)), words.n)
    at = np.flatnonzero(doc[:n] == doc[width - 1 :])
    step = 0x9E3779B97F4A7C15
    h = mixed(index.astype(np.uint64) + np.uint64(1))
    size = 1
    while size < width:  # width is a power of two
        h = h[:-size] * np.uint64(step) + h[size:]
        step = step * step % 2**64
        size *= 2
    h = mixed(h[at] ^ mixed(doc[at].astype(np.uint64)))
    s = np.sort(h)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return covered
    found = twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h
    at, h = at[found], h[found]
    order = np.argsort(h, kind="stable")
    at, h = at[order], h[order]
    window = index[at[:, None] + np.arange(width)]
    same = (h[1:] == h[:-1]) & (window[1:] == window[:-1]).all(1) & (doc[at[1:]] == doc[at[:-1]])
    if (same != (h[1:] == h[:-1])).any():  # windows that share a hash only
        seen: dict[tuple, list[int]] = {}
        for k, key in zip(at.tolist(), map(tuple, np.column_stack([doc[at], window]).tolist()), strict=True):
            seen.setdefault(key, []).append(k)
        at = np.array([k for ks in seen.values() if len(ks) > 1 for k in ks], np.int64)
    delta = np.zeros(len(index) + 1, np.int64)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + width, -1)
    return np.cumsum(delta[:-1]) > 0


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word; those equal to an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(_BLANKS)]
    return len(lines), len(lines) - len(set(lines))


def statistics(data: np.ndarray, rows: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each text."""

    full = np.flatnonzero(rows[1:] > rows[:-1])

    def per_row(mask: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows) - 1, np.int64)
        if len(full):
            out[full] = np.add.reduceat(mask.view(np.uint8), rows[full], dtype=np.int64)
        return out

    words = Words(data, rows)
    distinct, index = words.coded()
    covered = np.concatenate([[0], np.cumsum(_repeated(words, index))])
    echo = np.zeros(len(index) + 1, np.int64)  # words that the one before them equals
    np.cumsum(index[1:] == index[:-1], out=echo[2:])
    first, last = words.first[:-1], words.first[1:]
    text = data.tobytes()
    lines = np.array([_lines(text[a:b]) for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)], np.int64).reshape(-1, 2)
    blank = (data == 0x20) | ((data >= 9) & (data <= 13))
    return {
        "n_words": words.n.astype(np.int64),
        "word_chars": per_row(~blank & ((data & 0xC0) != 0x80)),
        "n_symbols": per_row(_SYMBOL[data]),
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": covered[words.first[1:]] - covered[words.first[:-1]],
        "n_lines": lines[:, 0],
        "n_upper": per_row((data >= 65) & (data <= 90)),
        "n_exclaim": per_row(data == 33),
        "n_digits": per_row((data >= 48) & (data <= 57)),
        "n_stops": per_row(data == 46),
        "n_pipes": per_row(data == 124),
        "n_echoes": np.where(last > first, echo[last] - echo[np.minimum(first + 1, len(index))], 0),
    }


def with_statistics(docs: DataFrame, carry: list[str], text: str = "text", prefix: str = "") -> DataFrame:
    """The columns named in carry and, under prefix, the COUNTS of the text."""
    schema = docs.select(*carry).schema
    for name in COUNTS:
        schema = schema.add(prefix + name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, rows in slices(batch, text):
                got = statistics(data, rows)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), *(pa.array(got[c], pa.int64()) for c in COUNTS)], names=schema.names)

    return mapped(docs.select(*carry, *[text][text in carry :]), run, schema)


def feature(name: str, prefix: str = "") -> Column:
    top, unit = FEATURES[name]
    top = F.col(prefix + top).cast("double")
    return top if unit is None else top / F.greatest(F.col(prefix + unit), F.lit(1))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self, prefix: str) -> Column:
        side = feature(self.feature, prefix)
        return side > self.threshold if self.above else side <= self.threshold


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    """Adds the condition of most gain until no good row is covered."""
    rule: Rule = ()
    hit = np.ones(len(bad), bool)
    while len(rule) < most and (hit & ~bad).any():
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        best, gain = None, 1e-9
        for name in FEATURES:
            v = x[name][hit]
            cuts = np.unique(np.quantile(v, np.linspace(0.01, 0.99, 99)))
            order = np.sort(v[bad[hit]]), np.sort(v[~bad[hit]])
            below = np.searchsorted(order[0], cuts, "right"), np.searchsorted(order[1], cuts, "right")
            for above in (False, True):
                pp, nn = ((p - below[0], n - below[1]) if above else below)
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - np.log2(p / (p + n))), 0)
                k = int(np.argmax(g))
                if g[k] > gain:
                    best, gain = Condition(name, above, float(cuts[k])), g[k]
        if best is None:
            break
        rule += (best,)
        hit &= best.holds(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule that is worth most on rows it wasn't grown on."""

    def worth(r: Rule) -> float:
        hit = _covers(r, x, len(bad))
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        return (p - n) / max(p + n, 1)

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)


def _centred(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The rule with each threshold halfway from where it was cut to nearly all it is to catch,
    so that rows a little beyond the good ones seen stay."""
    hit = _covers(rule, x, len(bad)) & bad
    edge = lambda c: float(np.quantile(x[c.feature][hit], 0.05 if c.above else 0.95))
    return tuple(Condition(c.feature, c.above, (c.threshold + edge(c)) / 2) for c in rule)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, rules: int = 12, conditions: int = 4, precision: float = 0.95) -> list[Rule]:
    """Ordered rules that each reject. fold: True for the rows that rules are pruned on."""
    found: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(found) < rules:
        grow, prune = left & ~fold, left & fold
        if (grow & bad).sum() < 3:
            break
        part = lambda rows: ({k: v[rows] for k, v in x.items()}, bad[rows])
        rule = _grow(*part(grow), conditions)
        rule = _prune(rule, *part(prune)) if rule else rule
        rule = _centred(rule, *part(grow)) if rule else rule
        hit = left & _covers(rule, x, len(bad))
        if not rule or (hit & bad).sum() < max(3, precision * hit.sum()) or (hit & prune & bad).sum() < precision * (hit & prune).sum():
            break
        found.append(rule)
        left &= ~hit
    return found


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """The number of the first rule that rejects, or 0."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        hit = F.lit(True)
        for c in rules[k - 1]:
            hit &= c.column(prefix)
        out = F.when(hit, F.lit(k)).otherwise(out)
    return out


def base_failed(prefix: str = "") -> Column:
    words = F.col(f"{prefix}n_words")
    return (words < 20) | (100 * F.col(f"{prefix}n_repeat_words") > 30 * words)


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """The list for docs (doc_id, text) by labels (doc_id, quality: 0 is bad), for what the base rules leave."""
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("quality")]
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", "quality").orderBy(*order).limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    made = with_statistics(rows, ["doc_id", "quality"]).filter(~base_failed())
    once = made.groupBy("doc_id", "quality").agg(F.min(F.struct(*COUNTS)).alias("x")).select("doc_id", "quality", "x.*").orderBy(*order)
    got = once.select("doc_id", F.col("quality").cast("int").alias("quality"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)).alias("fold"), *(feature(f).alias(f"f_{f}") for f in FEATURES)).toPandas()
    x = {f: got[f"f_{f}"].to_numpy() for f in FEATURES}
    return learn(x, got["quality"].to_numpy() == 0, got["fold"].to_numpy() == 0)


def judged(docs: DataFrame, labels: DataFrame, carry: list[str], prefix: str = "", sample: int = SAMPLE) -> DataFrame:
    """carry, the statistics, base_failed, kept and rule (the rejecting rule's number, or 0)."""
    rules = learned(docs, labels, sample)
    made = with_statistics(docs, carry, prefix=prefix).withColumn(f"{prefix}base_failed", base_failed(prefix)).withColumn(f"{prefix}rule", verdict(rules, prefix))
    return made.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & (F.col(f"{prefix}rule") == 0))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return made.select("doc_id", *BASE, "base_failed", "kept", "rule")
