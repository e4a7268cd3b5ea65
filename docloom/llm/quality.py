"""Quality classifier by hierarchical empirical Bayes.

A logistic model over figures of the text gives each document's log odds of being good. The documents of a
path (within a host) give the path's rate, the paths of a host the host's, the hosts the global one; each
rate is shrunk to the one above by a strength estimated from the spread of the rates (method of moments), so
a sparse site takes its prior from above. A document's posterior log odds are its own evidence plus the
site's prior log odds less the global ones; its own share is left out of the site's rate.

Only the fit looks at a sample: at most ``fit_rows`` labelled rows, those of least id hash. Counts and rates
cover every document. Sites are grouped with partial sums, so a host with a third of the rows is no burden.

Defined cases: a null or empty text has figures 0 and so the model's base rate; a null host or path is a
site of its own; labels that are null or not 0 or 1 are ignored; with no labels of both kinds every document
has log odds 0 and is kept; repeated rows count each time; an empty table gives an empty result. ``keep_rows``
returns all columns of docs, even if named like this module's own.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, written

# The figures of a text, in order.
FIGURES = ["upper", "symbols", "digits", "distinct_words", "word_length", "length", "repeated_lines", "top_word", "line_ends"]
#: Labelled rows that the model is fitted on, at most.
FIT_ROWS = 20_000
#: A document is kept from this posterior on.
THRESHOLD = 0.5

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_SYMBOL = b"!#$%&*+/<=>@[\\]^_`{|}~"


def figures_of(text: str | None) -> list[float]:
    """Shares between 0 and 1, or logarithms scaled to about that."""
    raw = (text or "").encode()
    if not raw.strip():
        return [0.0] * len(FIGURES)
    n = len(raw)
    count = lambda chars: n - len(raw.translate(None, chars))
    upper, lower, words = count(_UPPER), count(_LOWER), raw.split()
    distinct = Counter(words)
    top = max(distinct.values())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        upper / max(1, upper + lower),
        count(_SYMBOL) / n,
        count(_DIGIT) / n,
        math.log(1 + len(distinct)) / math.log(1 + len(words)),
        min(1.0, n / len(words) / 20),
        math.log(1 + len(words)) / 10,
        1 - len(set(lines)) / len(lines),
        top / len(words),
        sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def figures(texts: pd.Series) -> pd.Series:
    give_back()
    return pd.Series([figures_of(t) for t in texts], dtype=object)


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    bias: float

    def log_odds(self, x: Column) -> Column:
        total = F.lit(self.bias)
        for i, w in enumerate(self.weights):
            total = total + F.get(x, F.lit(i)) * F.lit(w)
        return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Logistic regression, each figure scaled, on the labelled documents of least id hash."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    known = labels.filter(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    chosen = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows), "fit-ids")
    if chosen.select("label").distinct().count() < 2:
        return Model((0.0,) * len(FIGURES), 0.0)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", figures("text").alias("x"))
    rows = written(rows, "fit").select("label", array_to_vector("x").alias("features"))
    if rows.select("label").distinct().count() < 2:
        return Model((0.0,) * len(FIGURES), 0.0)
    fitted = LogisticRegression(maxIter=60, regParam=1e-4, standardization=True, aggregationDepth=2).fit(rows)
    return Model(tuple(np.asarray(fitted.coefficients, float).tolist()), float(fitted.intercept))


def _site(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit("n"))


def _odds(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _strength(rates: DataFrame, rate: str, mean: Column) -> float:
    """Prior strength of the level above, by moments: mean (1 - mean) over the rates' spread, less what sampling adds."""
    spread = F.greatest(F.avg((F.col(rate) - mean) ** 2) - F.avg(mean * (1 - mean) / F.col("n")), F.lit(1e-6))
    k = rates.agg((F.avg(mean * (1 - mean)) / spread - 1).alias("k")).first()["k"]
    return float(min(1e4, max(1.0, k if k is not None else 1.0)))


def site_rates(scored: DataFrame) -> tuple[DataFrame, float, float]:
    """scored: (host, path, z). Returns the paths (host, path, n, s, prior: the host's shrunk rate), the paths' strength, and the global rate."""
    p = 1 / (1 + F.exp(-F.col("z")))
    paths = written(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("rate", F.col("s") / F.col("n"))
    total = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = float(total["s"] / total["n"]) if total["n"] else 0.5
    k = _strength(hosts, "rate", F.lit(mean))
    shrunk = hosts.select("host", ((F.col("s") + k * mean) / (F.col("n") + k)).alias("prior"))
    priors = written(paths.join(shrunk, "host"), "priors")
    return priors, _strength(priors.withColumn("rate", F.col("s") / F.col("n")), "rate", F.col("prior")), mean


def judged(scored: DataFrame, rates: tuple[DataFrame, float, float], threshold: float = THRESHOLD) -> DataFrame:
    """Adds document (the classifier's probability), site (the path's rate without the document), posterior and kept. Paths join by Spark's own choice, which broadcasts them only when small."""
    priors, k, mean = rates
    p = 1 / (1 + F.exp(-F.col("z")))
    site = (F.col("s") - p + k * F.col("prior")) / (F.col("n") - 1 + k)
    joined = scored.join(priors, ["host", "path"]).withColumn("document", p).withColumn("site", site)
    posterior = 1 / (1 + F.exp(-(F.col("z") + _odds(F.col("site")) - _odds(F.lit(mean)))))
    return joined.withColumn("posterior", posterior).withColumn("kept", F.col("posterior") >= threshold).drop("n", "s", "prior")


def _scored(docs: DataFrame, model: Model, host: str, path: str, *more: Column) -> DataFrame:
    return docs.select(_site(F.col(host)).alias("host"), _site(F.col(path)).alias("path"), model.log_odds(figures("text")).alias("z"), *more)


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, host, path, document, site, posterior, kept."""
    model = fit(docs, labels)
    scored = written(_scored(docs, model, host, path, F.col("doc_id")), "scored")
    return judged(scored, site_rates(scored), threshold).select("doc_id", "host", "path", "document", "site", "posterior", "kept")


def keep_rows(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """The documents kept, with all their columns; the text is read once for the sites' rates and once for the rows."""
    model = fit(docs, labels)
    rates = site_rates(written(_scored(docs, model, host, path), "scored"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return judged(_scored(docs, model, host, path, whole), rates, threshold).filter("kept").select("row.*")
