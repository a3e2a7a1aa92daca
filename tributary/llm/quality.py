"""A quality classifier as a sparse rule ensemble.

Shallow boosted trees are grown on statistics of labelled texts; each path from a root to a node is a rule, a
conjunction of comparisons. Lasso logistic regression picks and weighs rules, and the few that remain become
one Spark column expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Workspace, hinted, raw, slices, span_hashes, words

FEATURES = ["log_words", "word_bytes", "symbols", "exclaims", "uppers", "pipes", "digits", "stops", "high_bytes", "new_lines", "again", "longest_run", "distinct", "top_share"]
FIT_ROWS = 20_000
TREES, DEPTH, BINS, LEAST, RATE = 30, 3, 32, 10, 0.3
LASSO, STEPS = 2e-4, 400
KEEP_AT = 0.7


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[list(chars)] = 1
    return t


_CLASSES = [_table(b"#$%&*@^~<>{}[]\\_=+`"), _table(b"!"), _table(bytes(range(65, 91))), _table(b"|"), _table(b"0123456789"), _table(b".,;:?"), _table(bytes(range(128, 256))), _table(b"\n")]
_LETTERS = _table(bytes(range(65, 91)) + bytes(range(97, 123)))


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """FEATURES of each text (row); of an empty text all are 0."""
    n = len(at) - 1
    out = np.zeros((n, len(FEATURES)))
    starts, ends, first = words(data, at)
    count = np.diff(first).astype(float)
    some = np.maximum(count, 1)
    out[:, 0] = np.log1p(count)

    def per_text(x: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
        return (c[at[1:]] - c[at[:-1]]).astype(float)

    solid = per_text(~SPACE[data])
    out[:, 1] = solid / some
    letters = per_text(_LETTERS[data])
    for j, t in enumerate(_CLASSES):
        c = per_text(t[data])
        by = {2: np.maximum(letters, 1), 6: np.maximum(solid, 1)}.get(j, some)
        out[:, 2 + j] = c / by
    h = span_hashes(data, starts, ends)
    for i in np.flatnonzero(count).tolist():
        w = h[first[i] : first[i + 1]]
        change = np.flatnonzero(w[1:] != w[:-1])
        edges = np.concatenate([[-1], change, [len(w) - 1]])
        s = np.sort(w)
        new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        out[i, 10] = 1 - (len(change) + 1) / len(w)
        out[i, 11] = np.diff(edges).max()
        out[i, 12] = len(new) / len(w)
        out[i, 13] = np.diff(np.append(new, len(w))).max() / len(w)
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        x = statistics(*raw(b.column("text")))
        yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(c) for c in x.T]], ["id", *FEATURES])


Rule = tuple[tuple[int, bool, float], ...]  # feature, whether it must be greater, than what


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, greater, t in rule:
        out &= (x[:, f] > t) if greater else (x[:, f] <= t)
    return out


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """All paths of boosted trees on logistic loss; splits are tried at quantiles of each feature."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = [np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)]
    base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    score = np.full(len(y), np.log(base / (1 - base)))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        level: list[tuple[Rule, np.ndarray]] = [((), np.arange(len(y)))]
        for d in range(depth + 1):
            following = []
            for rule, rows in level:
                best = (1e-6, None, None)
                if d < depth and len(rows) >= 2 * LEAST:
                    whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
                    for f, c in enumerate(cuts):
                        if not len(c):
                            continue
                        k = bins[f][rows]
                        n, gs, hs = (np.cumsum(np.bincount(k, w, len(c) + 1))[:-1] for w in (None, g[rows], h[rows]))
                        gain = gs**2 / (hs + 1) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1) - whole
                        gain[(n < LEAST) | (len(rows) - n < LEAST)] = 0
                        j = int(gain.argmax())
                        if gain[j] > best[0]:
                            best = (gain[j], f, j)
                if best[1] is None:
                    score[rows] += RATE * g[rows].sum() / (h[rows].sum() + 1)
                    continue
                _, f, j = best
                for greater in (False, True):
                    part = rows[(bins[f][rows] > j) == greater]
                    path = (*rule, (f, greater, float(cuts[f][j])))
                    rules[path] = None
                    following.append((path, part))
            level = following
    return list(rules)


@dataclass
class RuleModel:
    """intercept + the sum of weights of the rules that hold is the log odds of label 1."""

    intercept: float
    rules: list[tuple[Rule, float]]

    def column(self) -> Column:
        odds = F.lit(self.intercept)
        for rule, w in self.rules:
            cond = F.lit(True)
            for f, greater, t in rule:
                cond = cond & ((F.col(FEATURES[f]) > t) if greater else (F.col(FEATURES[f]) <= t))
            odds = odds + F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-odds))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + sum((w * holds(r, x) for r, w in self.rules), np.zeros(len(x))))))


def fit(x: np.ndarray, y: np.ndarray, lasso: float = LASSO) -> RuleModel:
    """The model of labelled rows. With no rows it gives 0.5 to all; with one label only, that label's smoothed share."""
    n = len(y)
    if not n or y.min() == y.max():
        p = (y.sum() + 1) / (n + 2)
        return RuleModel(float(np.log(p / (1 - p))), [])
    rules = grow_rules(x, y)
    a = np.stack([holds(r, x) for r in rules], 1).astype(np.float64)
    scale = np.maximum(a.std(0), 0.02)
    a = a / scale
    w, b = np.zeros(a.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    v = np.ones(a.shape[1])
    for _ in range(12):  # the largest singular value bounds the step
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / float(v @ (a.T @ (a @ v)) * 1.1 + n)
    z, zb, t = w.copy(), b, 1.0
    for _ in range(STEPS):
        r = (y - 1 / (1 + np.exp(-(a @ z + zb)))) / n
        w2, b2 = z + step * (a.T @ r), zb + step * r.sum()
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * lasso, 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, zb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return RuleModel(float(b), [(r, float(k / s)) for r, k, s in zip(rules, w, scale) if abs(k) > 1e-6])


def is_held_out(id_: Column) -> Column:
    """Whether a document's labels are kept from learning: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, fit_rows: int | None = FIT_ROWS, threshold: float = KEEP_AT, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Every whole text's quality: id, held_out, score (0 to 1) and predicted (1 from the threshold on).

    The model is fitted on labelled rows that are not held out, on `fit_rows` of them at most (None: all), picked by a hash
    of the id; that bound is what the driver holds. Only statistics of the text are inputs. Null and empty texts
    have statistics of 0 and a score like others; null ids are never held out and have no label; rows with one
    id are scored each, and learned from as one if their statistics agree. Null labels and labels of documents
    that are not there are ignored; without any label every score is 0.5. Other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "quality")
    slim = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    stats = ws.keep(slim.mapInArrow(_measure, "id long, " + ", ".join(f"{f} double" for f in FEATURES)), "statistics")
    known = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("y")).where("y in (0, 1) and id is not null").where(~is_held_out(F.col("id")))
    sample = known if fit_rows is None else known.orderBy(F.xxhash64("id"), "id", "y").limit(fit_rows)
    rows = sample.join(stats, "id").dropDuplicates().orderBy("id", "y", *FEATURES)
    rows = (rows if fit_rows is None else rows.limit(2 * fit_rows)).select("y", *FEATURES).toPandas()
    model = fit(rows[FEATURES].to_numpy(float), rows["y"].to_numpy(float))
    out = stats.select(F.col("id").alias(id_col), is_held_out(F.col("id")).alias("held_out"), F.least(F.greatest(model.column(), F.lit(0.0)), F.lit(1.0)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those whose predicted label is 0."""
    bad = score_quality(docs, labels, id_col=id_col, text_col=text_col).where("predicted = 0").select(F.col(id_col).alias("_bad")).distinct()
    bad = hinted(Workspace(docs.sparkSession, "rejected").keep(bad, "rejected"))
    return docs.join(bad, docs[id_col] == bad["_bad"], "left_anti")
