"""Toxic spans by a linear-chain conditional random field over tokens, aggregated to document scores.

1. Features of a token (a run of characters that are neither white space nor ASCII punctuation, in
   lower case): the word and its first 4 to 8 bytes.
2. Token labels.  Labels are given per document, so tokens are labelled from them: on a bounded sample
   of labelled documents, features that are far more frequent in toxic documents (log-likelihood
   ratio) mark tokens of toxic documents as toxic.  All other tokens are not.
3. A two-state chain is fitted to the labelled lines by its exact gradient (forward-backward).
4. Every text is scored line by line: marginals of the toxic state, offending spans where they reach one
   half, the chance that any token is toxic and the expected number of toxic tokens.  A logistic curve
   of the last two, fitted on the sample, is the document score.

The model has at most ``MAX_FEATURES`` weights, so what the workers get is bounded.  Lines without a known
feature have a marginal by length and place only, found once per length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritymill.llm import units

FIT_DOCUMENTS = 16_000
FIT_LINES = 8_000
FIT_LINE_TOKENS = 500
MAX_FEATURES = 1 << 16
MARK_RATIO, KNOWN_RATIO = 15.0, 8.0
MARK_ODDS = 8.0
STEPS, RATE, RIDGE = 40, 0.5, 1e-4
START_BIAS, START_MARK = -9.0, 6.0
PREFIXES = (4, 5, 6, 7, 8)

_TOKEN = ~units.IS_SPACE
_TOKEN[0x21:0x30] = _TOKEN[0x3A:0x41] = _TOKEN[0x5B:0x61] = _TOKEN[0x7B:0x7F] = False
_SCORES = "id bigint, any_toxic double, mass double, spans string"
_COUNTS = "feature bigint, toxic bigint, clean bigint"
_LINES = "toxic int, features array<bigint>, tokens array<int>, rank bigint"


def _lower(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the Latin letters at U+00C0 to U+00DE; no byte moves."""
    out = units.LOWER[data]
    wide = np.flatnonzero(data[:-1] == 0xC3) + 1
    up = wide[(data[wide] >= 0x80) & (data[wide] <= 0x9E) & (data[wide] != 0x97)]
    out[up] += 32
    return out


@dataclass
class Tokens:
    starts: np.ndarray
    ends: np.ndarray
    features: np.ndarray  # tokens x (1 + prefixes); 0 where the token is too short
    bounds: np.ndarray  # token bounds of the texts
    line: np.ndarray  # line number of each token, over the whole slice


def tokens_of(part: units.Slice) -> Tokens:
    if not len(part.data):
        none = np.zeros(0, dtype=np.int64)
        return Tokens(none, none, np.zeros((0, 1 + len(PREFIXES)), np.uint64), np.zeros(part.rows + 1, np.int64), none)
    data = _lower(part.data)
    starts, ends = units.edges(_TOKEN[data], part.bounds)
    values = units.byte_values(data)
    columns = [units.mix(units.span_hashes(values, starts, ends), 1)]
    for k in PREFIXES:
        long = ends - starts > k
        head = units.mix(units.span_hashes(values, starts, np.minimum(starts + k, ends)), k)
        columns.append(np.where(long, head, np.uint64(0)))
    breaks = np.cumsum(data == 0x0A)
    text = np.searchsorted(part.bounds, starts, side="right")
    line = (breaks[starts] if len(starts) else starts) + text  # a new text is a new line
    return Tokens(starts, ends, np.stack(columns, axis=1), np.searchsorted(starts, part.bounds), line)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label that hold each feature."""
    for batch in batches:
        label = batch.column("toxic").to_numpy()
        for part in units.slices(batch.column("text")):
            t = tokens_of(part)
            row = np.repeat(np.arange(part.rows), np.diff(t.bounds))
            wide = t.features.shape[1]
            feature, holder = t.features.reshape(-1), np.repeat(row, wide)
            order = np.lexsort((holder, feature))
            feature, holder = feature[order], holder[order]
            new = np.ones(len(feature), dtype=bool)
            new[1:] = (feature[1:] != feature[:-1]) | (holder[1:] != holder[:-1])
            new &= feature != 0
            feature, toxic = feature[new], label[part.first : part.first + part.rows][holder[new]] == 1
            cuts = np.flatnonzero(np.diff(feature, prepend=np.uint64(0))) if len(feature) else np.zeros(0, np.int64)
            hits = np.add.reduceat(toxic.astype(np.int64), cuts) if len(cuts) else cuts
            size = np.diff(np.append(cuts, len(feature)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(feature[cuts].view(np.int64)), pa.array(hits), pa.array(size - hits)], names=["feature", "toxic", "clean"]
            )


def _split_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of the sample: (document label, known features token by token)."""
    for batch in batches:
        label = batch.column("toxic").to_numpy()
        for part in units.slices(batch.column("text")):
            t = tokens_of(part)
            cuts = np.flatnonzero(np.diff(t.line, prepend=-1)) if len(t.line) else np.zeros(0, np.int64)
            stops = np.append(cuts[1:], len(t.line)) if len(cuts) else cuts
            text = np.searchsorted(part.bounds, t.starts[cuts], side="right") - 1 + part.first
            flat = t.features.view(np.int64)
            out = [
                (int(label[r]), flat[a:b].reshape(-1), int(b - a), int(units.mix(np.array([a, r, b], np.uint64), 5).sum() >> np.uint64(1)))
                for r, a, b in zip(text.tolist(), cuts.tolist(), stops.tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([o[0] for o in out], pa.int32()),
                    pa.array([o[1] for o in out], pa.list_(pa.int64())),
                    pa.array([[o[2]] for o in out], pa.list_(pa.int32())),
                    pa.array([o[3] for o in out], pa.int64()),
                ],
                names=["toxic", "features", "tokens", "rank"],
            )


def forward_backward(unary: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the toxic state, expected transition counts and log partition of padded chains.

    ``unary`` (chains x places) is the toxic state's score over the other's; ``trans`` 2 x 2.
    """
    n, size = unary.shape
    score = np.stack([np.zeros_like(unary), unary], axis=2)
    alpha, beta = np.zeros((size, n, 2)), np.zeros((size, n, 2))
    alpha[0] = score[:, 0]
    for i in range(1, size):
        step = np.logaddexp(alpha[i - 1][:, 0, None] + trans[0], alpha[i - 1][:, 1, None] + trans[1]) + score[:, i]
        alpha[i] = np.where(mask[:, i, None], step, alpha[i - 1])
    for i in range(size - 2, -1, -1):
        ahead = beta[i + 1] + score[:, i + 1]
        step = np.logaddexp(trans[:, 0] + ahead[:, 0, None], trans[:, 1] + ahead[:, 1, None])
        beta[i] = np.where(mask[:, i + 1, None], step, beta[i + 1])
    total = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
    toxic = np.exp(alpha[:, :, 1] + beta[:, :, 1] - total).T * mask
    pairs = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            both = alpha[:-1, :, a] + trans[a, b] + score[:, 1:, b].T + beta[1:, :, b] - total
            pairs[a, b] = np.exp(np.where(mask[:, 1:].T, both, -np.inf)).sum()
    return toxic, pairs, total


def _groups(order: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Chains in ascending order of size, in groups of at most about 100,000 padded places."""
    at = 0
    while at < len(order):
        group = order[at : at + 2000]
        padded = np.arange(1, len(group) + 1) * size[group]
        group = group[: max(1, int(np.searchsorted(padded, 100_000, side="right")))]
        yield group
        at += len(group)


@dataclass
class Model:
    """``known`` ascending feature hashes with their weights, bias and transitions; ``curve`` of the document score."""

    known: np.ndarray
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    curve: tuple[float, float, float] = (0.0, 1.0, 0.0)
    lengths: dict[int, np.ndarray] = field(default_factory=dict)

    def unary(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores of the toxic state, tokens with a known feature)."""
        if not len(self.known):
            return np.full(len(features), self.bias), np.zeros(len(features), dtype=bool)
        at = np.minimum(np.searchsorted(self.known, features), len(self.known) - 1)
        hit = self.known[at] == features
        return self.bias + np.where(hit, self.weights[at], 0.0).sum(axis=1), hit.any(axis=1)

    def plain(self, size: int) -> np.ndarray:
        """Marginals of a line of ``size`` tokens without a known feature."""
        if size not in self.lengths:
            if len(self.lengths) > 4096:
                self.lengths.clear()
            one = np.ones((1, size), dtype=bool)
            self.lengths[size] = forward_backward(np.full((1, size), self.bias), one, self.trans)[0][0]
        return self.lengths[size]

    def marginals(self, t: Tokens) -> np.ndarray:
        unary, hit = self.unary(t.features)
        out = np.zeros(len(unary))
        cuts = np.flatnonzero(np.diff(t.line, prepend=-1)) if len(t.line) else np.zeros(0, np.int64)
        size = np.diff(np.append(cuts, len(unary)))
        known = np.maximum.reduceat(hit, cuts) if len(cuts) else hit
        for n in np.unique(size[~known]).tolist():
            at = cuts[~known & (size == n)]
            out[at[:, None] + np.arange(n)] = self.plain(n)
        for group in _groups(np.flatnonzero(known)[np.argsort(size[known], kind="stable")], size):
            place = np.arange(int(size[group].max()))
            mask = place[None, :] < size[group][:, None]
            cell = np.where(mask, cuts[group][:, None] + place, 0)
            found = forward_backward(np.where(mask, unary[cell], 0.0), mask, self.trans)[0]
            out[cell[mask]] = found[mask]
        return out


def _ratio(counts: DataFrame, toxic: int, clean: int) -> DataFrame:
    """Counts with the log-likelihood ratio and the odds of a feature's use in toxic documents."""
    t, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    both = (t + c) / F.lit(float(max(1, toxic + clean)))
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))
    nt, nc = F.lit(float(toxic)), F.lit(float(clean))
    llr = 2 * (term(t, nt * both) + term(c, nc * both) + term(nt - t, nt * (1 - both)) + term(nc - c, nc * (1 - both)))
    odds = ((t + 0.5) / (nt + 1)) / ((c + 0.5) / (nc + 1))
    return counts.select("feature", "toxic", "clean", llr.alias("ratio"), odds.alias("odds")).where("odds > 1 AND toxic > 1")


def _fit_chain(lines: pa.Table, known: np.ndarray, marks: np.ndarray) -> Model:
    """Gradient ascent on the labelled lines, the bounded sample; only known features are kept of it."""
    wide = 1 + len(PREFIXES)
    size = pa.concat_arrays([c.flatten() for c in lines.column("tokens").chunks]).to_numpy().astype(np.int64)
    flat = pa.concat_arrays([c.flatten() for c in lines.column("features").chunks]).to_numpy().view(np.uint64).reshape(-1, wide)
    toxic, first = lines.column("toxic").to_numpy() == 1, np.cumsum(size) - size
    batches = []
    for part in _groups(np.argsort(size, kind="stable"), size):
        place = np.arange(int(size[part].max()))
        mask = place[None, :] < size[part][:, None]
        features = flat[(first[part][:, None] + place)[mask]]
        marked = np.isin(features, marks).any(axis=1) & np.repeat(toxic[part], size[part])
        label = np.zeros(mask.shape, dtype=bool)
        label[mask] = marked
        at = np.minimum(np.searchsorted(known, features), len(known) - 1)
        token, column = np.nonzero(known[at] == features)
        batches.append((mask, label, np.flatnonzero(mask.reshape(-1))[token], at[token, column]))
    del flat
    weights, bias, trans = np.where(np.isin(known, marks), START_MARK, 0.0), START_BIAS, np.zeros((2, 2))
    total = max(1, int(size.sum()))
    squares = [np.full_like(weights, 1e-8), 1e-8, np.full_like(trans, 1e-8)]
    for _ in range(STEPS):
        gw, gb, gt = np.zeros_like(weights), 0.0, np.zeros((2, 2))
        for mask, label, cell, index in batches:
            unary = np.bincount(cell, weights[index], mask.size).reshape(mask.shape) + bias * mask
            marginal, pairs, _ = forward_backward(unary, mask, trans)
            rest = (label - marginal) * mask
            gb += rest.sum()
            gw += np.bincount(index, rest.reshape(-1)[cell], len(weights))
            state = label.astype(np.int64)
            seen = np.bincount((2 * state[:, :-1] + state[:, 1:])[mask[:, 1:]], minlength=4).reshape(2, 2)
            gt += seen - pairs
        steps = [gw / total - RIDGE * weights / max(1, len(known)), gb / total, gt / total]
        squares = [s + g * g for s, g in zip(squares, steps, strict=True)]
        weights, bias, trans = (
            x + RATE * g / np.sqrt(s) for x, g, s in zip((weights, bias, trans), steps, squares, strict=True)
        )
    return Model(known, weights, float(bias), trans)


def _score(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part in units.slices(batch.column("text")):
                t = tokens_of(part)
                p = m.marginals(t)
                row = np.repeat(np.arange(part.rows), np.diff(t.bounds))
                none = np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), part.rows)
                spans = [""] * part.rows
                bad = np.flatnonzero(p >= 0.5)
                if len(bad):
                    point = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
                    cut = np.flatnonzero((np.diff(bad) > 1) | (np.diff(t.line[bad]) != 0)) + 1
                    for run_of in np.split(bad, cut):
                        r = row[run_of[0]]
                        base = point[part.bounds[r]]
                        text = f"{point[t.starts[run_of[0]]] - base}:{point[t.ends[run_of[-1]]] - base}"
                        spans[r] = f"{spans[r]},{text}" if spans[r] else text
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(part.first, part.rows),
                        pa.array(-np.expm1(none)),
                        pa.array(np.bincount(row, p, part.rows).astype(float)),
                        pa.array(spans),
                    ],
                    names=["id", "any_toxic", "mass", "spans"],
                )

    return run


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression of labels on the columns of ``x``, by Newton steps with a light pull to 0."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * curve[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (y - p) - 0.1 * w)
        w = w + np.clip(step, -2, 2)
    return tuple(map(float, w))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def fit(labelled: DataFrame, documents: int = FIT_DOCUMENTS, lines: int = FIT_LINES) -> Model:
    """Model of labelled rows (id, text, toxic); at most ``documents`` rows are used, and for the chain
    at most ``lines`` of their lines, of at most ``FIT_LINE_TOKENS`` tokens.

    The sample is the rows of least hashed id, the same in every run.  Rows without a label, text
    or id are left out.  No rows, or rows of one label, give a model that scores all texts alike.
    """
    spark = labelled.sparkSession
    rows = labelled.where("toxic IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL")
    ranks = rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(documents)
    sample = rows.join(ranks, "id", "left_semi").select("id", "text", F.col("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    counts = sample.mapInArrow(_count, _COUNTS).groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ranked = _ratio(counts, sizes.get(1, 0), sizes.get(0, 0)).where(F.col("ratio") >= KNOWN_RATIO)
    best = ranked.orderBy(F.desc("ratio"), "feature").limit(MAX_FEATURES).toPandas()
    strong = best[(best["ratio"] >= MARK_RATIO) & (best["odds"] >= MARK_ODDS)]
    known = np.sort(best["feature"].to_numpy(dtype=np.int64).view(np.uint64))
    marks = strong["feature"].to_numpy(dtype=np.int64)
    if not len(marks):
        rate = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
        return Model(known[:0], np.zeros(0), -30.0, np.zeros((2, 2)), (float(_logit(np.array(rate))), 0.0, 0.0))
    held = sample.mapInArrow(_split_lines, _LINES).where(F.size("features").between(1, FIT_LINE_TOKENS * (1 + len(PREFIXES))))
    marked = F.arrays_overlap("features", F.array(*[F.lit(int(m)) for m in marks[:2000]]))
    half = [held.where(c).orderBy("rank", "features").limit(lines // 2) for c in ((F.col("toxic") == 1) & marked, ~((F.col("toxic") == 1) & marked))]
    model = _fit_chain(half[0].union(half[1]).toArrow(), known, marks.view(np.uint64))
    scored = sample.select("id", "text").mapInArrow(_score(spark.sparkContext.broadcast(model)), _SCORES)
    pairs = scored.join(sample.select("id", "toxic"), "id").select("any_toxic", "mass", "toxic").toPandas()
    model.lengths.clear()
    inputs = np.column_stack([_logit(pairs["any_toxic"].to_numpy()), np.log1p(pairs["mass"].to_numpy())])
    model.curve = _fit_curve(inputs, pairs["toxic"].to_numpy(dtype=float))
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_id``, score, spans) of every row; spans are ``start:end`` code points, comma-joined.

    Null, empty and blank texts have no tokens and get the score of no toxic token.  Rows that repeat an id
    are scored one by one.  Only the text enters a score.  An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    p = F.least(F.greatest(F.col("any_toxic"), F.lit(1e-9)), F.lit(1 - 1e-9))
    a, b, c = map(F.lit, model.curve)
    value = 1 / (1 + F.exp(-(a + b * F.log(p / (1 - p)) + c * F.log1p("mass"))))
    return source.mapInArrow(_score(shared), _SCORES).select(F.col("id").alias(doc_id), value.alias("score"), "spans")
