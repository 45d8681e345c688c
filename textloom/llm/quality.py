"""Quality rules (operator 8): base rules, then minimum-covariance-determinant outliers per language and source.

``text_stats`` reads every whole text once and gives integer counts. ``robust_verdict`` works on that narrow table only:

1. each document gets a vector of transformed statistics, rounded to integers (``GRID`` steps a unit), so that every sum
   below is exact and does not depend on the order of rows or on partitions. Length is among them and variety falls with
   it, so there is a second vector, where a text of more than ``SPAN`` words counts as one of ``SPAN`` words with the mean
   variety of all its runs of so many;
2. rows are summed up in cells of their group, for both vectors: one grouped aggregation of integer moments, partial sums
   before the shuffle, so a hot source costs no more than its rows. A cell is as wide as ``FLOOR``, below which differences
   do not count, so a group has no more cells than that grid, however many rows it has;
3. per (lang, source) the ``COVER`` share of rows whose covariance has the least determinant is sought over these cells from
   several deterministic starts: medians with quartile ranges, all rows, the rows near the medians in every coordinate,
   the half nearest by the sum of coordinates, and the fullest cell. From each, concentration steps follow until the
   subset stays the same: the cells nearest by the last fit give the next mean and covariance; the last cell counts in
   part, so that each subset has the same size. Of all starts the least determinant is kept;
4. the covariance is scaled so that the median distance is that of a chi-square, and rows whose squared Mahalanobis
   distance exceeds ``CUTOFF`` by both fits are rejected: ``distance2`` is the lesser one, so great length alone rejects none.

Groups with fewer than ``MIN_ROWS`` rows take the fit of their language, and languages with fewer the fit of all rows.
Variances have a floor: a statistic that is constant in a group does not make every other value an outlier.
Nulls: a null text has no words (base_failed); null lang or source form a group of their own. Copies of a row each get
the same verdict. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import words as W
from textloom.llm.common import free, sent, written

MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
GRID, COVER, MIN_ROWS = 256, 0.75, 200
#: Concentration steps at most, and robust deviations of each coordinate that are near the medians.
MOST_STEPS, NEAR = 200, 2.0
#: Beyond the upper 1e-12 quantile of a chi-square with six degrees of freedom (68): only gross outliers go.
CUTOFF, MEDIAN = 72.0, 5.348
#: Least standard deviation of each statistic, and the width of a cell.
FLOOR = (0.5, 0.2, 0.05, 0.05, 0.05, 0.05)
#: A text of n words has noisy shares: its squared distance counts n / (n + NOISE).
NOISE = 40
#: Words of a run; in the second vector longer texts count as so long.
SPAN = 512
NAMES = ("v_words", "v_variety", "v_length", "v_symbols", "v_upper", "v_marks")
#: The same with the length and the variety of the average run.
RUN_NAMES = ("r_words", "r_variety", *NAMES[2:])
#: Both vectors by a letter that begins their groups' names.
VECTORS = {"W": NAMES, "R": RUN_NAMES}
P = len(NAMES)
#: What a row of a fit takes in memory at most, with names of some length.
FIT_BYTES = 1024

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_marks")
#: Distinct words summed over all runs of SPAN words; n_distinct of a text that is no longer.
RUNS = "n_run_distinct"
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
MARK = np.zeros(256, bool)
MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "#*$%&|<>"]] = True


def repeated(h: np.ndarray, doc: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """True for each word inside a window of so many words that its row holds twice or more."""
    n = len(h)
    out = np.zeros(n, bool)
    if n < window:
        return out
    key = np.zeros(n - window + 1, np.uint64)
    for k in range(window):
        key = W.mix(key * W.M3 + h[k : n - window + 1 + k])
    whole = doc[: n - window + 1] == doc[window - 1 :]
    at = np.flatnonzero(whole)
    key = W.mix(key[at] ^ (doc[at].astype(np.uint64) * W.M1))
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    hit = np.zeros(len(s), bool)
    hit[1:] |= same
    hit[:-1] |= same
    delta = np.zeros(n + 1, np.int32)
    begin = at[order[hit]]
    np.add.at(delta, begin, 1)
    np.add.at(delta, begin + window, -1)
    return np.cumsum(delta[:n]) > 0


def run_distinct(before: np.ndarray, first: np.ndarray, span: int = SPAN) -> np.ndarray:
    """For each word, the runs of so many words (one run, the whole row, where it has fewer) that hold no equal word earlier in them.

    ``before`` has the index of the last equal word of the row, -1 where there is none.
    """
    n = np.diff(first)
    begin, size = np.repeat(first[:-1], n), np.repeat(n, n)
    at = np.arange(len(before)) - begin
    last, width = np.where(before < 0, -1, before - begin), np.minimum(size, span)
    return np.maximum(np.minimum(at, size - width) - np.maximum(last + 1, at - width + 1) + 1, 0)


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def count(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS and RUNS of each text of a column."""
    parts: list[list[np.ndarray]] = []
    for a, b, data, offsets in W.slices(column):
        starts, ends, first = W.spans(data, offsets)
        h = W.hashes(data, starts, ends)
        doc = W.doc_of(first)
        row = np.repeat(np.arange(b - a), np.diff(offsets))
        chars = np.bincount(row, ((data & 0xC0) != 0x80) & ~W.SPACE[data], b - a)
        pair = W.mix(h ^ (doc.astype(np.uint64) * W.M1))
        order = np.argsort(pair, kind="stable")
        same = pair[order[1:]] == pair[order[:-1]]
        before = np.full(len(h), -1)
        before[order[1:][same]] = order[:-1][same]
        text = data.tobytes()
        lines = [dup_lines(text[offsets[i] : offsets[i + 1]].decode()) for i in range(b - a)]
        parts.append([
            np.diff(first), chars, np.bincount(row, SYMBOL[data], b - a), np.array(lines), W.per_row(repeated(h, doc, first), first),
            W.per_row(before < 0, first), np.bincount(row, UPPER[data], b - a), np.bincount(row, MARK[data], b - a), W.per_row(run_distinct(before, first), first),
        ])
    return {k: np.concatenate(x).astype(np.int64) if parts else np.zeros(0, np.int64) for k, x in zip((*COUNTS, RUNS), list(zip(*parts, strict=True)) or [()] * (len(COUNTS) + 1), strict=True)}


def text_stats(docs: DataFrame, keys: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """keys, COUNTS and RUNS of each row of docs; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(x) for x in count(batch.column("text")).values())], names=[*keys, *COUNTS, RUNS])

    kinds = dict(docs.dtypes)
    return docs.select(*keys, "text").mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{k} long" for k in (*COUNTS, RUNS))]))


def vectors(stats: DataFrame) -> DataFrame:
    """Adds the transformed statistics as integers."""
    n, c = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    span = F.least(n, F.lit(SPAN))
    share = lambda k: F.sqrt(F.col(k) / c)
    forms = (F.log(n), F.log(F.greatest(F.col("n_distinct"), F.lit(1)) / n), F.log(c / n), share("n_symbols"), share("n_upper"), share("n_marks"))
    runs = (F.log(span), F.log(F.greatest(F.col(RUNS), F.lit(1)) / (n - span + 1) / span))
    return stats.withColumns({k: F.round(f * GRID).cast("long") for k, f in zip((*NAMES, *RUN_NAMES[:2]), (*forms, *runs), strict=True)})


def _distance(names: tuple[str, ...] = NAMES, mean: str = "mean", inverse: str = "inverse") -> F.Column:
    """Squared Mahalanobis distance of the row's vector, from the fit's arrays in the same row."""
    d = [F.col(k) / F.lit(float(GRID)) - F.col(mean)[i] for i, k in enumerate(names)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(i, P):
            total = total + d[i] * d[j] * F.col(inverse)[i * P + j] * F.lit(1.0 if i == j else 2.0)
    return total


FIT = "grp string, mean array<double>, inverse array<double>, scale double, logdets array<double>"


def cells(rows: DataFrame) -> DataFrame:
    """Counts, sums and sums of products of each cell (c...) of each group, from rows of grp and NAMES."""
    pairs = [(i, j) for i in range(P) for j in range(i, P)]
    at = [F.floor(F.col(k) / (FLOOR[i] * GRID)).alias(f"c{i}") for i, k in enumerate(NAMES)]
    sums = [*(F.sum(k).alias(f"s{i}") for i, k in enumerate(NAMES)), *(F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"q{i}_{j}") for i, j in pairs)]
    return rows.groupBy("grp", *at).agg(F.count(F.lit(1)).alias("n"), *sums)


class Cells:
    """The cells of a group, in the order of their coordinates."""

    def __init__(self, n: np.ndarray, s: np.ndarray, q: np.ndarray):
        self.n, self.s, self.q = n.astype(np.float64), s.astype(np.float64), q.astype(np.float64)
        self.at = self.s / self.n[:, None] / GRID

    def moments(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Mean, inverse covariance and log determinant of the rows, each cell's with a weight."""
        n = (weight * self.n).sum()
        mean = weight @ self.s / n
        cov = np.empty((P, P))
        cov[np.triu_indices(P)] = weight @ self.q / n
        cov = np.triu(cov) + np.triu(cov, 1).T - np.outer(mean, mean)
        cov = cov / GRID**2 + np.diag(np.square(FLOOR))
        return mean / GRID, np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])

    def nearest(self, distance: np.ndarray, share: float) -> np.ndarray:
        """Weights of the nearest cells that together hold the share of the rows; the last one counts in part."""
        order = np.argsort(distance, kind="stable")
        before = np.cumsum(self.n[order]) - self.n[order]
        out = np.empty(len(order))
        out[order] = np.clip((share * self.n.sum() - before) / self.n[order], 0, 1)
        return out

    def distance(self, mean: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        d = self.at - mean
        return np.einsum("ni,ij,nj->n", d, inverse, d)

    def quantile(self, x: np.ndarray, share: float) -> float:
        order = np.argsort(x, kind="stable")
        return float(x[order][np.searchsorted(np.cumsum(self.n[order]), share * self.n.sum())])

    def starts(self) -> list[np.ndarray]:
        """The first subset of each start, as weights."""
        low, middle, high = (np.array([self.quantile(x, share) for x in self.at.T]) for share in (0.25, 0.5, 0.75))
        spread = np.square((high - low) / 1.349) + np.square(FLOOR)
        z = np.abs(self.at - middle) / np.sqrt(spread)
        full = self.at[np.argmax(self.n)]
        near = (z <= NEAR).all(axis=1)
        return [
            self.nearest(self.distance(middle, np.diag(1 / spread)), COVER), np.ones(len(self.n)), near.astype(np.float64) if near.any() else np.ones(len(self.n)),
            self.nearest(z.sum(axis=1), 0.5), self.nearest(self.distance(full, np.diag(1 / spread)), 0.5),
        ]

    def settled(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """The fit at which concentration steps from a subset end."""
        fit = self.moments(weight)
        for _ in range(MOST_STEPS):
            after = self.nearest(self.distance(*fit[:2]), COVER)
            if (after == weight).all():
                break
            weight, fit = after, self.moments(after)
        return fit

    def fit(self) -> dict:
        """The fit of the least determinant, with its scale and the log determinants of all starts."""
        fits = [self.settled(w) for w in self.starts()]
        mean, inverse, _ = min(fits, key=lambda f: f[2])
        scale = max(self.quantile(self.distance(mean, inverse), 0.5) / MEDIAN, 0.2)
        return {"mean": mean.tolist(), "inverse": inverse.ravel().tolist(), "scale": scale, "logdets": [f[2] for f in fits]}


def fits(rows: DataFrame) -> DataFrame:
    """FIT of each group, from rows of grp and NAMES. A task holds a group's cells, never its rows."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([f"c{i}" for i in range(P)])
        made = Cells(group["n"].to_numpy(), group[[f"s{i}" for i in range(P)]].to_numpy(), group[[f"q{i}_{j}" for i in range(P) for j in range(i, P)]].to_numpy())
        return pd.DataFrame([{"grp": group["grp"].iloc[0], **made.fit()}])

    return cells(rows).groupBy("grp").applyInPandas(run, FIT)


def _with_fit(rows: DataFrame, fit: DataFrame) -> DataFrame:
    return rows.join(sent(fit, FIT_BYTES), "grp")


def robust_verdict(stats: DataFrame, cutoff: float = CUTOFF, min_rows: int = MIN_ROWS) -> DataFrame:
    """Adds ``distance2`` and ``outlier`` to a table of text_stats (best already written: it is read four times)."""
    lang, source = F.coalesce("lang", F.lit("\x00")), F.coalesce("source", F.lit("\x00"))
    sizes = stats.groupBy(lang.alias("l"), source.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    by_lang = sizes.groupBy("l").agg(F.sum("n").alias("nl"))
    sizes = sizes.join(by_lang, "l").select(
        "l", "s", F.when(F.col("n") >= min_rows, F.concat_ws("\x01", F.lit("s"), "l", "s")).when(F.col("nl") >= min_rows, F.concat_ws("\x01", F.lit("l"), "l")).otherwise(F.lit("all")).alias("grp")
    )
    sizes = written(sizes, "quality-groups")
    # a row counts for its own group, and for those wider ones that some group needs
    wide = written(sizes.filter(~F.startswith("grp", F.lit("s"))).select(F.col("grp").alias("g")).distinct(), "quality-groups")
    all_rows = vectors(stats).withColumns({"l": lang, "s": source})
    own = all_rows.join(sent(sizes, FIT_BYTES), ["l", "s"])
    both = tuple(dict.fromkeys((*NAMES, *RUN_NAMES)))
    fitting = own.select(*both, F.explode(F.array(F.concat_ws("\x01", F.lit("l"), "l"), F.lit("all"))).alias("g")).join(sent(wide, FIT_BYTES), "g", "left_semi")
    fitting = fitting.unionByName(own.filter(F.startswith("grp", F.lit("s"))).select(*both, F.col("grp").alias("g")))
    # both vectors are fitted in one go: a group of each
    fitting = fitting.select(F.explode(F.array(*(F.struct(F.concat(F.lit(v), "g").alias("grp"), *(F.col(k).alias(n) for k, n in zip(names, NAMES, strict=True))) for v, names in VECTORS.items()))).alias("x")).select("x.*")
    fit, out = written(fits(fitting), "quality-fit"), own
    for v, names in VECTORS.items():
        mine = fit.filter(F.startswith("grp", F.lit(v))).withColumn("grp", F.substring("grp", F.lit(2), F.length("grp")))
        out = _with_fit(out, mine).withColumn(v, _distance(names) / F.col("scale") * F.col("n_words") / (F.col("n_words") + NOISE)).drop("mean", "inverse", "scale", "logdets")
    out = out.withColumn("distance2", F.least(*VECTORS))
    return out.select(*stats.columns, "distance2", (F.col("distance2") > cutoff).alias("outlier"))


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def quality(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and distance2, one row per row of docs."""
    stats = written(text_stats(docs), "quality-stats")
    rated = robust_verdict(stats, cutoff).withColumn("base_failed", base_failed())
    return rated.select("doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & ~F.col("outlier")).alias("kept"), "distance2")


def keep_good(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs that pass, with all their columns.

    Rows are judged by content: texts are not joined by id, so rows that share an id cannot take each other's verdict.
    Rejects are keyed by doc_id and a SHA-256 of language, source and text.
    """
    id_, hash_ = free(docs, "_id", "_hash")
    key = F.sha2(F.concat_ws("\x01", *(F.coalesce(c, F.lit("\x00")) for c in ("lang", "source", "text"))), 256)
    keyed = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("string"), F.lit("")), hash_: key})
    stats = written(text_stats(keyed, (id_, hash_, "lang", "source")), "quality-stats")
    bad = written(robust_verdict(stats, cutoff).filter(base_failed() | F.col("outlier")).select(id_, hash_).distinct(), "quality-rejects")
    return keyed.join(sent(bad, 200), [id_, hash_], "left_anti").select(*docs.columns)
