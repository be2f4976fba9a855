"""Mixing sources to target weights by soft membership.

A classifier learned from the ``labels`` table gives every document a posterior over three
domains: ``toxic`` (toxic = 1), else ``good`` (quality = 1) or ``poor`` (quality = 0). Rates
r >= 0 are fitted so that the expected tokens of each domain, the sum of r * tokens * p,
match target weights times a budget: least squares by projected gradient from r = 1. The
errors are weighted by the inverse of the sum of tokens * p * p' over the documents whose
rate is above zero, so a step of 1 solves the problem at once while no further rate meets
zero, and a few steps do when some are held there. A step needs one aggregate over the
documents, which gives the totals and the next curvature; a document's rate is its own fold
over the steps so far, so nothing but the sums moves. The tolerance ends the fit, no count.

Classifier: naive Bayes over the presence of words and of a few word shapes. It counts
features in at most ``MAX_LABELLED`` labelled documents (the smallest hashes of doc_id) and
keeps markers: features that one domain has more often than chance gives, by ``MIN_CHANCE``
times the deviation that the largest of as many features has by chance alone, and
``MIN_RATIO`` times as often as either other domain. No threshold is a number of documents, so
rare domains and small label tables have markers as well. A marker tells its domain from the
two others only, and its absence tells nothing: there are many kinds of junk, and the markers
of one would speak against all others. The best ``MAX_FEATURES`` are kept, so the table has a
bounded size. Tokens are words: runs without blanks.

* Null texts have no tokens; their posterior is the prior and their rate is that of any
  other document with it. Very long texts are read whole.
* A label row with a null id or both labels null is dropped; repeated label rows of a
  document count once, by their largest values.
* A domain without any mass cannot reach its target; the others still do. Without labelled
  rows every document is ``good`` with probability 1 by definition.
* Repeated documents are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import gives_back, raw, settle

DOMAINS = ("good", "poor", "toxic")
#: Labelled documents that the classifier may read; labelled features it may keep.
MAX_LABELLED, MAX_FEATURES = 20_000, 4096
MIN_CHANCE, MIN_RATIO = 0.75, 2.5
#: Documents that every domain is thought to have besides its own, with features as often as in all.
PSEUDO = 1.0
#: Softens the posteriors: log odds are divided by this.
TEMPERATURE = 2.0
TARGETS = {"good": 0.80, "poor": 0.15, "toxic": 0.05}
#: Length of the weighted errors, by that of the weighted targets, at which the fit ends.
TOLERANCE = 1e-5
#: Shares of a step that are tried, and the least progress of a plain step.
SHARES, PROGRESS = (1.0, 0.25, 0.0625), 1e-4

_UPPER, _LOWER = bytes(range(65, 91)), bytes([*range(97, 123), *range(128, 256)])
_OUTER = b".,;:!?()"
#: Words that a worker remembers.
_REMEMBERED = 1 << 16


def plain(word: bytes) -> bytes:
    """The word in ASCII lower case without outer punctuation."""
    return word.lower().strip(_OUTER)


def shapes(text: bytes, words: int, distinct: int) -> set[bytes]:
    """Marks of junk: tenths of capitals, of what is no letter and of different words, and the size."""
    if not words:
        return set()
    upper, lower = len(text) - len(text.translate(None, _UPPER)), len(text) - len(text.translate(None, _LOWER))
    letters = upper + lower
    return {b"\x00upper%d" % min(9, 10 * upper // max(1, letters)), b"\x00other%d" % min(9, 10 * (len(text) - letters) // len(text)),
            b"\x00vary%d" % min(9, 10 * distinct // words), b"\x00size%d" % words.bit_length()}


def features(text: bytes) -> set[bytes]:
    words = text.split()
    distinct = set(words)
    return ({plain(w) for w in distinct} | shapes(text, len(words), len(distinct))) - {b""}


class Classifier:
    """Log prior, and for each feature what its presence adds, by domain."""

    def __init__(self, prior: np.ndarray, added: dict[bytes, np.ndarray], temperature: float = TEMPERATURE) -> None:
        self.prior, self.temperature = prior, temperature
        self.number = {f: i for i, f in enumerate(added)}
        self.table = np.array(list(added.values())).reshape(-1, len(DOMAINS)) / temperature
        self.known: dict[bytes, int] = {}

    def posterior(self, text: bytes) -> tuple[int, np.ndarray]:
        """Number of words, and the posterior of the text."""
        words = text.split()
        distinct = set(words)
        known, number = self.known, self.number
        if len(known) > _REMEMBERED:
            known.clear()
        for word in distinct:
            if word not in known:
                known[word] = number.get(plain(word), -1)
        present = {known[w] for w in distinct}
        present.update(number.get(f, -1) for f in shapes(text, len(words), len(distinct)))
        present.discard(-1)
        logit = self.prior + self.table[list(present)].sum(axis=0)
        weight = np.exp(logit - logit.max())
        return len(words), weight / weight.sum()


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Classifier:
    per_doc = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    chosen = per_doc.select("doc_id", domain.alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)

    @gives_back
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for domain, text in zip(batch.column("domain").to_pylist(), batch.column("text")):
                found = [*features(text.as_py()), b"\x00all"]
                yield pa.RecordBatch.from_arrays([pa.array([domain] * len(found), pa.int32()), pa.array(found, pa.binary())], ["domain", "feature"])

    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("domain", raw("text").alias("text"))  # at most max_labelled ids
    seen = sample.mapInArrow(words, "domain int, feature binary")
    counted = seen.groupBy("feature").agg(*[F.sum((F.col("domain") == k).cast("long")).alias(f"n{k}") for k in range(3)])
    counted = settle(counted.withColumn("n", F.col("n0") + F.col("n1") + F.col("n2")), "features")
    whole = counted.where(F.col("feature") == F.lit(b"\x00all")).first()
    if whole is None:
        return Classifier(np.array([0.0, -700.0, -700.0]), {})
    sizes = np.array([whole.n0, whole.n1, whole.n2], float)
    total = float(whole.n)
    chance = MIN_CHANCE * np.sqrt(2 * np.log(max(2, counted.count() - 1)))
    z = []
    for k in range(3):  # half a document off, for counts are whole; half a document more variance, for rare features
        expected = F.col("n") * float(sizes[k] / total)
        z.append((F.col(f"n{k}") - expected - 0.5) / F.sqrt(expected * float(1 - sizes[k] / total) + 0.5))
    share = [(F.col(f"n{k}") + F.col("n") * (PSEUDO / total)) / float(sizes[k] + PSEUDO) for k in range(3)]
    ordered = F.sort_array(F.array(*share), asc=False)
    best = counted.where(F.col("feature") != F.lit(b"\x00all")).withColumn("z", F.greatest(*z))
    best = best.where((F.col("z") >= float(chance)) & (ordered[0] >= MIN_RATIO * ordered[1])).withColumn("domain", F.array_position(F.array(*z), F.col("z")))
    added = {}
    for r in best.orderBy(F.col("z").desc(), "feature").limit(MAX_FEATURES).collect():
        k = r.domain - 1
        own, like = (r.n0, r.n1, r.n2)[k], PSEUDO * r.n / total
        row = np.zeros(len(DOMAINS))
        row[k] = np.log((own + like) / (sizes[k] + PSEUDO)) - np.log((r.n - own + like) / (total - sizes[k] + PSEUDO))
        added[bytes(r.feature)] = row
    return Classifier(np.log((sizes + 0.5) / (total + 1.5)), added)


def memberships(text: Column, model: Classifier) -> Column:
    """A struct of ``tokens`` and ``p``, the posterior in the order of ``DOMAINS``."""

    @F.pandas_udf("struct<tokens:long,p:array<double>>")
    @gives_back
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [model.posterior(t) for t in texts]
            yield pd.DataFrame({"tokens": [n for n, _ in found], "p": [p.tolist() for _, p in found]})

    return run(raw(text))


def walk(p: np.ndarray, steps: list[list[float]]) -> np.ndarray:
    """Rates of rows of posteriors after the steps."""
    rates = np.ones(len(p))
    for step in steps:
        rates = np.maximum(0.0, rates - p @ np.array(step))
    return rates


def rate(p: Column, steps: list[list[float]]) -> Column:
    """The rate of a document after the steps: a fold of its own posterior over them."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(walk(np.array(rows.tolist()).reshape(-1, len(DOMAINS)), steps))

    return run(p)


def fit(members: DataFrame, targets: dict[str, float], budget: float | None = None, protect: str | None = None, margin: float = 1.0,
        tolerance: float = TOLERANCE) -> list[list[float]]:
    """Steps of the projected gradient over ``members`` (``tokens``, ``p``).

    The budget in tokens is the documents' total unless given; ``protect`` sets it so that
    this domain's target is ``margin`` times its present tokens. A step is the gradient in the
    curvature of the documents whose rate is above zero, found by the same sums; where that
    does not lower the errors enough, in shares of it, and then in the curvature of all
    documents, which always lowers them. The fit ends at the tolerance, or with a warning
    where even that step lowers them by less than ``PROGRESS``: then no rates meet the
    targets, and these are the nearest.
    """
    weight = np.array([targets.get(d, 0.0) for d in DOMAINS])
    weight = weight / weight.sum()

    n = len(DOMAINS)
    fields = [f"s{j}" for j in range(n + n * n)]

    def totals(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """The domains' expected tokens, and their change with a step on the rates above zero."""

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tokens = batch.column("tokens").to_numpy(zero_copy_only=False)
                p = batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                rates = walk(p, steps)
                curved = (p * (tokens * (rates > 0))[:, None]).T @ p
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*((rates * tokens) @ p), *curved.ravel())], fields)

        parts = members.select("tokens", "p").mapInArrow(sums, ", ".join(f"{f} double" for f in fields))
        found = np.array([v or 0.0 for v in parts.agg(*[F.sum(f) for f in fields]).first()])
        return found[:n], found[n:].reshape(n, n)

    now, curve = totals([])
    start = now
    if protect is not None:
        budget = margin * start[DOMAINS.index(protect)] / weight[DOMAINS.index(protect)]
    target = weight * (start.sum() if budget is None else budget)
    # makes every curvature 1 at most; a domain without mass does not count
    weights = np.linalg.pinv(curve, rcond=tolerance**2, hermitian=True)

    def error(of: np.ndarray) -> float:
        return float((of - target) @ weights @ (of - target))

    steps: list[list[float]] = []
    while (before := error(now)) > tolerance**2 * float(target @ weights @ target):
        newton = np.linalg.pinv(curve, rcond=tolerance**2, hermitian=True) @ (now - target)
        tried = [(newton * share, 1 - share / 4) for share in SHARES] + [(weights @ (now - target), 1 - PROGRESS)]
        for step, enough in tried:
            now, curve = totals([*steps, step.tolist()])
            if error(now) < enough * before:
                steps.append(step.tolist())
                break
        else:  # the plain gradient cannot fail while it is not zero: these are the least squares
            steps.append(step.tolist())
            warnings.warn(f"no rates meet the targets: expected tokens {dict(zip(DOMAINS, now.tolist()))}, targets {dict(zip(DOMAINS, target.tolist()))}")
            break
    return steps


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, protect: str | None = None, margin: float = 1.0,
                 into: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all unless given) with a struct column ``into``: tokens, posterior and rate of each row.

    ``into`` takes the place of a column of that name. The texts are classified once; steps
    and result read the settled table.
    """
    model = learn(docs, labels)
    with_members = docs.withColumn(into, memberships(F.col("text"), model)).select(*[c for c in keep or docs.columns if c != into], into)
    members = settle(with_members, "members")
    tokens, p = F.col(into)["tokens"], F.col(into)["p"]
    steps = fit(members.select(tokens.alias("tokens"), p.alias("p")), targets or TARGETS, protect=protect, margin=margin)
    return members.withColumn(into, F.struct(tokens.alias("tokens"), p.alias("p"), rate(p, steps).alias("rate")))


def copies(rate_of: Column, *key: Column) -> Column:
    """A whole number of copies with the rate as its mean over documents, the same in every run."""
    share = F.pmod(F.xxhash64(*key), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate_of + share).cast("int")
