"""Mixing to target weights with soft domain membership.

A classifier learned from a labelled table gives each document a posterior over domains. Nonnegative
document rates are then fitted by projected gradient steps on the least squares distance between the
expected tokens of each domain, sum of rate * tokens * posterior, and the targets. A step moves a rate
by its posterior times one number per domain and cuts it off at zero, so the steps taken so far are all
that is kept: no state per document. Distances and steps are scaled by the domains' curvature, so rare
domains move as fast as large ones.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.llm.common import chosen_rows, lean, scratch_table, table, texts_of, whole_text
from cohortlake.llm.language import WIDTH, ngram_counts

TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
PRIOR = 0.5


@dataclass(frozen=True)
class DomainModel:
    """Naive Bayes over hashed n-grams, with the sharpness fitted on rows it has not seen."""

    domains: tuple[str, ...]
    log_share: np.ndarray  # domain x n-gram
    log_prior: np.ndarray
    sharpness: float

    def posteriors(self, texts: list[str]) -> np.ndarray:
        """One row per text; the priors for a text without n-grams of its own."""
        counts = np.array([ngram_counts(t) if t.strip() else np.zeros(WIDTH, np.int64) for t in texts])
        return soft(self.sharpness * mean_likelihood(counts, self.log_share) + self.log_prior)


def mean_likelihood(counts: np.ndarray, log_share: np.ndarray) -> np.ndarray:
    counts = counts.reshape(-1, WIDTH).astype(float)
    return counts @ log_share.T / np.maximum(1.0, counts.sum(axis=1, keepdims=True))


def soft(scores: np.ndarray) -> np.ndarray:
    scores = scores - scores.max(axis=1, keepdims=True) if scores.size else scores
    grown = np.exp(scores)
    return grown / np.maximum(grown.sum(axis=1, keepdims=True), 1e-300)


def fit_domains(
    docs: DataFrame, labelled: DataFrame, label: str = "domain", per_class: int = 1000, ident: str = "doc_id"
) -> DomainModel:
    """Learn from at most ``per_class`` labelled rows of each domain, on their whole texts.

    Half of them, by hash, give the n-gram shares; the other half fits the sharpness by likelihood.
    Null labels and identifiers are left out. Without labelled rows there are no domains.
    """
    found = texts_of(docs, chosen_rows(labelled, label, per_class, ident))
    found = found.withColumn("half", F.xxhash64("doc_id", F.lit("half")) % 2 == 0).persist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[name] = sums.get(name, 0) + ngram_counts(text)
        for name, total in sums.items():
            at = np.nonzero(total)[0]
            columns = [pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(total[at])]
            yield pa.record_batch(columns, names=["label", "gram", "n"])

    named = found.withColumn("label", F.col("label").cast("string"))
    grams = named.filter("half").select("text", "label").mapInArrow(lean(count), "label string, gram int, n long")
    sizes = {r.label: r.rows for r in named.groupBy("label").agg(F.sum("weight").alias("rows")).collect()}
    domains = sorted(sizes)
    shares = np.full((len(domains), WIDTH), PRIOR)
    for r in grams.groupBy("label", "gram").agg(F.sum("n").alias("n")).collect():
        shares[domains.index(r.label), r.gram] += r.n
    log_share = np.log(shares / shares.sum(axis=1, keepdims=True)) if domains else shares
    weights = np.array([float(sizes[d]) for d in domains])
    log_prior = np.log(weights / weights.sum()) if domains else weights

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [mean_likelihood(ngram_counts(t), log_share)[0].tolist() for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(scores, pa.list_(pa.float64())), batch.column(1)], names=["scores", "label"])

    rest = named.filter("not half").select("text", "label").mapInArrow(lean(measure), "scores array<double>, label string").collect()
    found.unpersist()
    sharpness = 1.0
    if rest:
        scores, truth = np.array([r.scores for r in rest]), [domains.index(r.label) for r in rest]
        steps = np.geomspace(0.5, 500, 40)
        loss = [-np.log(soft(s * scores + log_prior)[np.arange(len(truth)), truth] + 1e-12).mean() for s in steps]
        sharpness = float(steps[int(np.argmin(loss))])
    return DomainModel(tuple(domains), log_share, log_prior, sharpness)


def memberships(docs: DataFrame, model: DomainModel, text: str, draw: str, carried: list[str]) -> DataFrame:
    """(row, draw, tokens, domain, posterior) of each row: the carried columns as a struct, words, likeliest domain.

    ``draw`` in [0, 1) hashes the identifier column of that name with the text, so equal rows agree.
    """
    share = F.shiftrightunsigned(F.xxhash64(draw, whole_text(text)), 11).cast("double") / float(1 << 53)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), share.alias("draw"), whole_text(text).alias("text"))
    schema = rows.drop("text").schema.add("tokens", "long").add("domain", "string").add("posterior", T.ArrayType(T.DoubleType()))
    names = list(model.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                texts = part.column(2).to_pylist()
                posterior = model.posteriors(texts)
                best = [names[i] for i in posterior.argmax(axis=1)] if names else [None] * len(texts)
                new = {
                    "tokens": pa.array([len(t.split()) for t in texts], pa.int64()),
                    "domain": pa.array(best, pa.string()),
                    "posterior": pa.array(list(posterior), pa.list_(pa.float64())),
                }
                yield pa.record_batch([*part.columns[:2], *new.values()], names=["row", "draw", *new])

    return rows.mapInArrow(lean(run), schema)


def rates_after(steps: list[np.ndarray], posterior: np.ndarray) -> np.ndarray:
    """The rates of documents after the given steps, from one each."""
    rate = np.ones(len(posterior))
    for step in steps:
        rate = np.maximum(0.0, rate - posterior @ step)
    return rate


@dataclass
class Rates:
    """The steps of a fit, the expected tokens they reach, and how far the last point is from optimal.

    ``residual`` is the root mean square, by tokens, of the move that one more plain step would make.
    """

    steps: list[np.ndarray]
    reached: np.ndarray
    residual: float


def fit_rates(weighted: DataFrame, targets: np.ndarray, steps: int = 200, tolerance: float = 1e-4, still: float = 1e-3) -> Rates:
    """Rates of zero or more, near one, for (tokens, posterior) rows, whose expected domain tokens match.

    Minimises the distance to ``targets`` in the metric of the inverse curvature (the k x k sum of
    tokens * posterior * posterior'), in which a plain projected gradient step of length one never
    overshoots. A pass tries that step, steps scaled by the curvature of the documents still above
    zero, and longer ones, all at once; the best is taken. Ends when every total is within ``tolerance``
    of all tokens from its target; or, for targets that no rates reach, when the residual is below
    ``still`` and the distance no longer falls; or after ``steps`` passes. Always returns the rates, the
    totals they reach and the residual.
    """
    k = len(targets)
    everything = float(targets.sum())
    width = 2 * k * k + k

    def sums(before: list[np.ndarray], moves: list[np.ndarray]) -> np.ndarray:
        """After each move: expected tokens, curvature of all documents and of those above zero."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros((len(moves), width))
            for batch in batches:
                posterior = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                tokens = batch.column(0).to_numpy().astype(float)
                start = rates_after(before, posterior)
                for row, move in zip(found, moves, strict=True):
                    rate = np.maximum(0.0, start - posterior @ move)
                    row[:k] += (tokens * rate) @ posterior
                    row[k : k + k * k] += ((posterior * tokens[:, None]).T @ posterior).ravel()
                    row[k + k * k :] += ((posterior * (tokens * (rate > 0))[:, None]).T @ posterior).ravel()
            yield pa.record_batch([pa.array(np.arange(found.size)), pa.array(found.ravel())], names=["place", "value"])

        rows = weighted.select("tokens", "posterior").mapInArrow(add, "place long, value double")
        total = np.zeros(len(moves) * width)
        for r in rows.groupBy("place").agg(F.sum("value").alias("value")).collect():
            total[r.place] = r.value
        return total.reshape(-1, width)

    def residual_of(taken: list[np.ndarray], step: np.ndarray) -> float:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            moved = 0.0
            for batch in batches:
                posterior = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                rate = rates_after(taken, posterior)
                move = rate - np.maximum(0.0, rate - posterior @ step)
                moved += float((batch.column(0).to_numpy() * move * move).sum())
            yield pa.record_batch([pa.array([moved])], names=["moved"])

        found = weighted.select("tokens", "posterior").mapInArrow(add, "moved double")
        return float(np.sqrt((found.agg(F.sum("moved")).first()[0] or 0.0) / everything))

    if not everything:
        return Rates([], np.zeros(k), 0.0)
    taken: list[np.ndarray] = []
    first = sums(taken, [np.zeros(k)])[0]
    whole = first[k : k + k * k].reshape(k, k)
    if not whole.any():
        return Rates([], first[:k], 0.0)
    metric = np.linalg.inv(whole + 1e-9 * np.diag(np.diag(whole)) + 1e-12 * everything * np.eye(k))

    def facts(row: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        miss = row[:k] - targets
        return miss, float(miss @ metric @ miss) / 2, row[k + k * k :].reshape(k, k)

    (miss, distance, above), before, residual = facts(first), np.inf, np.inf
    for _ in range(steps):
        plain = metric @ miss
        if np.abs(miss).max() <= tolerance * everything:
            break
        if distance > 0.999 * before:
            residual = residual_of(taken, plain)
            if residual <= still:
                break
        moves = [plain]
        for damping in (1e-3, 0.05, 0.5):
            scaled = np.linalg.solve(above + damping * whole + 1e-12 * everything * np.eye(k), miss)
            moves += [scaled, scaled / 2]
        if taken:
            moves += [plain + taken[-1] / 2, plain + taken[-1]]
        found = [facts(row) for row in sums(taken, moves)]
        best = int(np.argmin([d for _, d, _ in found]))
        before = distance
        taken = [*taken, moves[best]]
        miss, distance, above = found[best]
    return Rates(taken, miss + targets, residual_of(taken, metric @ miss))


def rated(
    docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], label: str, per_class: int, text: str, ident: str, carried: list[str]
) -> DataFrame:
    """(row, domain, posterior, tokens, rate, copies) of each row of ``docs``, ``row`` with the carried columns."""
    model = fit_domains(docs, labelled, label, per_class, ident)
    k = len(model.domains)
    # Written once: the fit and the result read it, so texts are classified a single time.
    known = scratch_table(memberships(docs, model, text, ident, carried), "memberships")
    steps: list[np.ndarray] = []
    if k:
        tokens = known.agg(F.sum("tokens").alias("n")).first()["n"] or 0
        shares = np.array([max(0.0, float(targets.get(d, 0.0))) for d in model.domains])
        shares = shares / shares.sum() if shares.sum() else np.full(k, 1 / k)
        fit = fit_rates(known, shares * tokens)
        steps = fit.steps
        if tokens and np.abs(fit.reached - shares * tokens).max() > 1e-4 * tokens:
            got = {d: round(float(n / tokens), 4) for d, n in zip(model.domains, fit.reached, strict=True)}
            warnings.warn(f"no rates reach the targets {dict(targets)}; the nearest shares are {got}", stacklevel=3)

    @F.arrow_udf("double")
    def rate(posterior: pa.Array) -> pa.Array:
        return pa.array(rates_after(steps, posterior.flatten().to_numpy(zero_copy_only=False).reshape(len(posterior), k)))

    # Taken as not deterministic, so that a filter on the copies does not run it a second time, in workers of its own.
    found = known.withColumn("rate", rate.asNondeterministic()("posterior") if steps else F.lit(1.0))
    return found.withColumn("copies", F.floor(F.col("rate") + F.col("draw")).cast("int")).drop("draw")


def mix(
    docs: DataFrame,
    labelled: DataFrame,
    targets: Mapping[str, float],
    label: str = "domain",
    per_class: int = 1000,
    text: str = "text",
    ident: str = "doc_id",
) -> DataFrame:
    """Each row of ``docs`` with its domain posterior, tokens, rate and copies.

    ``labelled`` (``ident``, ``label``) names the domains of some documents. ``targets`` are weights
    by domain name, normalised; the domain token totals sought are these shares of all tokens (words)
    of ``docs``, so the mean rate is one. A domain without a target gets weight zero; a target
    without labelled rows cannot be reached and is left out. ``copies`` is the rate rounded up or
    down by a hash of the identifier and text, so its expectation is the rate and equal rows agree.

    The result has the identifier, then __domain, __posterior, __tokens, __rate and __copies. Null and
    empty texts have no tokens and the posterior of the priors. Targets that no rates reach give the
    nearest rates and a warning with the shares reached. Without labelled rows, or without tokens, every
    rate is one. An empty table gives no rows.
    """
    found = rated(docs, labelled, targets, label, per_class, text, ident, [ident])
    names = ("domain", "posterior", "tokens", "rate", "copies")
    return found.select(F.col("row")[ident].alias(ident), *[F.col(c).alias(f"__{c}") for c in names])


def mixed(
    docs: DataFrame,
    labelled: DataFrame,
    targets: Mapping[str, float],
    label: str = "domain",
    per_class: int = 1000,
    text: str = "text",
    ident: str = "doc_id",
) -> DataFrame:
    """The rows of ``docs`` with all their columns, whatever their names, each as often as its copies say."""
    found = rated(docs, labelled, targets, label, per_class, text, ident, docs.columns).filter("copies > 0")
    times = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    return found.select("row", times).select("row.*")


def labelled_languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the documents that the labelled table covers."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id"), "doc_id", "left_semi")


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Domain posterior, tokens, rate and copies of every document for the target weights."""
    docs = table(spark, folder, "documents")
    found = mix(docs, labelled_languages(docs, table(spark, folder, "labels")), TARGETS)
    return found.select(
        "doc_id",
        F.col("__domain").alias("domain"),
        F.col("__posterior").alias("posterior"),
        F.col("__tokens").alias("n_tokens"),
        F.col("__rate").alias("rate"),
        F.col("__copies").alias("copies"),
    )
