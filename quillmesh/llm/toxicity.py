"""Toxicity by weak supervision.

Many weak voters look at a text: one for each entry of a lexicon, which a pass
over labelled rows finds in whole words and in beginnings of words, and some
for patterns of writing. A generative model of the votes, fitted by expectation
maximisation, estimates how accurate each voter is and which voters hang
together given the truth, by a factor for each voter and its parent in a tree;
the given label is a voter as well, so wrong labels are outvoted. Its posteriors
are the soft labels on which a linear classifier is trained. Every text of the
corpus is scored by that classifier.

The models are fitted on at most about ``max_rows`` labelled rows, taken by a
hash of their ids; everything else covers all rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillmesh.llm.tokens import steps
from quillmesh.workspace import stored

#: Insults that vote before any label has been seen.
INSULTS = ("clown", "disgusting", "dumb", "filth", "garbage", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "ugly", "vermin", "worthless")
WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings of words that can be entries; marked by a leading ^.
STEMS = (4, 5)
#: Pattern voters, after those of the lexicon: several entries, many entries a word, shouting, calling out.
PATTERNS = 4
#: Labelled rows that a step of the fit takes at once; bounds the arrays on the driver.
FITTED_ROWS = 2048


def _entries(text: str) -> tuple[Counter, int]:
    """Words and beginnings of longer words of a text, and the number of its words."""
    words = WORD.findall(text.lower())
    return Counter(words), len(words)


def hits(text: str, lexicon: dict[str, int]) -> tuple[list[int], list[float]]:
    """Entries of the lexicon in a text, by number, and the pattern features of it."""
    seen, n = _entries(text)
    found, total = set(), 0
    for w, k in seen.items():
        at = {lexicon[e] for e in (w, *("^" + w[:m] for m in STEMS if len(w) > m)) if e in lexicon}
        if at:
            found |= at
            total += k
    shouted = text.count("!") / (len(text) + 1)
    return sorted(found), [float(np.log1p(total)), min(1.0, 10.0 * total / (n + 1)), min(1.0, 20.0 * shouted), min(1.0, 5.0 * (seen["you"] + seen["your"]) / (n + 1))]


@dataclass
class ToxicityModel:
    """A linear classifier over lexicon hits and patterns, and what the label model has found."""

    lexicon: dict[str, int]
    weights: np.ndarray
    intercept: float
    accuracies: np.ndarray
    correlations: np.ndarray

    def score(self, text: str) -> float:
        found, patterns = hits(text, self.lexicon)
        z = self.intercept + float(self.weights[found].sum()) + float(np.dot(self.weights[len(self.lexicon) :], patterns))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _blocks(n: int):
    """Slices that cover ``n`` rows."""
    return (slice(at, at + FITTED_ROWS) for at in range(0, n, FITTED_ROWS))


def _joint(votes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted counts of the votes -1, 0 and 1 of all pairs of voters: voters by voters by 3 by 3."""
    n = votes.shape[1]
    counts = np.zeros((3 * n, 3 * n))
    for s in _blocks(len(votes)):
        on = np.concatenate([(votes[s] == k).astype(np.float32) for k in (-1, 0, 1)], axis=1)
        counts += (on * weights[s, None].astype(np.float32)).T @ on
    return counts.reshape(3, n, 3, n).transpose(1, 3, 0, 2)


def dependencies(votes: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The voter that each voter depends on most, or -1, and how much all voters share given the truth (in nats).

    The parents are a spanning tree of the largest mutual information given
    the truth, so that what depends on each other is counted once.
    """
    n, shared = votes.shape[1], np.zeros((votes.shape[1],) * 2)
    for w in (q, 1 - q):
        joint = _joint(votes, w) + 1e-3
        joint /= joint.sum(axis=(2, 3), keepdims=True)
        alone = joint.sum(axis=3, keepdims=True) * joint.sum(axis=2, keepdims=True)
        shared += w.mean() * (joint * np.log(joint / alone)).sum(axis=(2, 3))
    np.fill_diagonal(shared, 0)
    parent, best, at, inside = np.full(n, -1), np.full(n, -np.inf), 0, np.zeros(n, bool)
    for _ in range(n - 1):  # Prim's tree, from the first voter
        inside[at] = True
        better = ~inside & (shared[at] > best)
        best[better], parent[better] = shared[at][better], at
        at = int(np.argmax(np.where(inside, -np.inf, best)))
    return np.where(best > 1e-4, parent, -1), shared


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors, accuracies and correlations of ``votes`` (rows by voters: 1, 0 abstains, -1) and noisy ``labels``.

    A generative model with one factor for each voter and one for each voter
    and the one it depends on: P(truth) times the product of P(vote | truth,
    vote of its parent). It starts from the labels, which vote like all others;
    parents are found from those, and from the posteriors after half of the
    rounds. The labels have no parent:
    who gave them didn't look at the voters. Correlations are the mutual
    information of two voters given the truth.
    """
    all_ = np.column_stack([votes, 2 * labels - 1]).astype(np.int8)
    n = all_.shape[1]
    q, parent, shared = np.where(labels > 0, 0.9, 0.1), np.full(n, -1), np.zeros((n, n))
    for step in range(rounds):
        if step in (0, rounds // 2):
            tree, shared[:-1, :-1] = dependencies(all_[:, :-1], q)
            parent = np.append(tree, -1)
        of = lambda s: np.where(parent >= 0, all_[s][:, np.maximum(parent, 0)], 0)  # noqa: B023, E731, votes of the parents
        counts = np.zeros((2, 3, 3, n))  # truth, vote of the parent, vote, voter
        for s in _blocks(len(q)):
            w, of_s = np.stack([q[s], 1 - q[s]]), of(s)
            for b in (-1, 0, 1):
                for a in (-1, 0, 1):
                    counts[:, b + 1, a + 1] += w @ ((of_s == b) & (all_[s] == a))
        given = np.log((counts + 0.5) / (counts.sum(axis=2, keepdims=True) + 1.5))
        p = np.clip(q.mean(), 1e-3, 1 - 1e-3)
        odds = np.concatenate([(given[0] - given[1])[of(s) + 1, all_[s] + 1, np.arange(n)].sum(axis=1) for s in _blocks(len(q))]) + np.log(p / (1 - p))
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    agree = sum(q[s] @ (all_[s] > 0) + (1 - q[s]) @ (all_[s] < 0) for s in _blocks(len(q)))
    cast = (all_ != 0).sum(axis=0)
    return q, agree / np.maximum(cast, 1), shared


def linear_fit(x: np.ndarray, q: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps."""
    w, penalty = np.zeros(x.shape[1] + 1), np.full(x.shape[1] + 1, ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        curve, slope = np.diag(penalty), -penalty * w
        for s in _blocks(len(x)):
            x1 = np.column_stack([x[s].astype(np.float64), np.ones(len(x[s]))])
            p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
            curve += (x1 * (p * (1 - p) + 1e-6)[:, None]).T @ x1
            slope += x1.T @ (q[s] - p)
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def held_out(id_col) -> "F.Column":
    """Whether a row is kept out of all learning."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0


def _counted(batches):
    """Documents that hold each entry, by label; summed up within a batch."""
    for batch in batches:
        for part in steps(batch, "text"):
            count = {0: Counter(), 1: Counter()}
            for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist()):
                seen, _ = _entries(text or "")
                count[label].update({*seen, *("^" + w[:m] for w in seen for m in STEMS if len(w) > m)})
            # an entry without a toxic document can't vote
            rows = [(e, n, count[0][e]) for e, n in count[1].items()]
            clean = [(e, 0, n) for e, n in count[0].items() if e not in count[1]]
            rows += clean
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["entry", "toxic", "clean"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000, max_entries: int = 300, least: int = 4) -> ToxicityModel:
    """Fit the label model and the classifier on at most about ``max_rows`` labelled rows that aren't held out.

    An entry of the lexicon is in at least ``least`` toxic documents and far
    more often in toxic than in clean ones; at most ``max_entries`` vote, a
    bound of the model's size as ``max_rows`` is. Labels other than 0 and 1 and
    rows without an id teach nothing.
    """
    own = labels.select(F.col(id_col).alias("lid"), F.col(label_col).cast("double").alias("label")).where("lid is not null and label in (0, 1)").withColumn("label", F.col("label").cast("int")).where(~held_out(F.col("lid"))).groupBy("lid").agg(F.max("label").alias("label"))
    n = own.count()
    share = int(min(1.0, max_rows / max(n, 1)) * (1 << 20))
    # at most about max_rows rows of two numbers: small enough for every executor
    sample = F.broadcast(own.where(F.pmod(F.xxhash64("lid"), F.lit(1 << 20)) < share))
    # read three times below, so it is written once: the sampled rows only
    texts = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sample, F.col("id") == F.col("lid")).select("text", "label"), "sample")
    counts = texts.mapInArrow(_counted, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    totals = texts.agg(F.sum("label"), F.count("*")).first()
    n_toxic, n_clean = int(totals[0] or 0), int((totals[1] or 0) - (totals[0] or 0))
    ratio = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    best = counts.where(F.col("toxic") >= least).where(ratio >= 8).withColumn("strength", F.col("toxic") * F.log(ratio)).orderBy(F.desc("strength"), "entry").limit(max_entries).collect()
    names = [r["entry"] for r in best]
    lexicon = {e: i for i, e in enumerate([*names, *(w for w in INSULTS if w not in names)])}
    v = len(lexicon)

    def seen(batches):
        for part in (p for batch in batches for p in steps(batch, "text")):
            got = [hits(t or "", lexicon) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float64()))], names=["label", "found", "patterns"])

    # bounded by max_rows and by the lexicon
    rows = texts.mapInArrow(seen, "label int, found array<int>, patterns array<double>").toArrow().combine_chunks()
    x = np.zeros((rows.num_rows, v + PATTERNS), np.float32)
    if rows.num_rows:
        found, patterns = (rows.column(c).combine_chunks() for c in ("found", "patterns"))
        x[np.repeat(np.arange(len(x)), found.value_lengths().to_numpy()), found.flatten().to_numpy()] = 1
        x[:, v:] = patterns.flatten().to_numpy().reshape(-1, PATTERNS)
    y = rows.column("label").to_numpy().astype(np.float64)
    votes = np.zeros(x.shape, np.int8)
    votes[:, :v] = x[:, :v]
    some = x[:, :v].sum(axis=1)
    votes[:, v] = np.where(some >= 3, 1, np.where(some == 0, -1, 0))
    votes[:, v + 1] = np.where(x[:, v + 1] > 0.1, 1, np.where(x[:, v + 1] == 0, -1, 0))
    votes[:, v + 2] = np.where(x[:, v + 2] > 0.5, 1, 0)
    votes[:, v + 3] = np.where(x[:, v + 3] > 0.2, 1, 0)
    if rows.num_rows:
        q, accuracies, correlations = label_model(votes, y)
        weights, intercept = linear_fit(x, q)
    else:  # nothing to learn from: the fixed insults decide
        weights, intercept = np.concatenate([np.full(v, 1.0), [2.0, 1.0, 0.0, 0.0]]), -3.0
        accuracies, correlations = np.zeros(v + PATTERNS + 1), np.eye(v + PATTERNS + 1)
    return ToxicityModel(lexicon, weights, intercept, accuracies, correlations)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", extra: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns ``extra`` of every row and its score as column ``name``, from 0 to 1; a null text counts as empty."""
    carried = list(dict.fromkeys([*extra, text_col]))
    fields = [docs.schema[c] for c in carried]
    shown, at = [f"c{i}" for i in range(len(extra))], f"c{carried.index(text_col)}"

    def run(batches):
        for batch in batches:
            for part in steps(batch, at):
                scores = [model.score(t or "") for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*map(part.column, shown), pa.array(scores, pa.float64())], names=[*shown, "s"])

    named = StructType([StructField(c, f.dataType, True) for c, f in zip(shown, fields)] + [StructField("s", DoubleType())])
    got = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried))).mapInArrow(run, named)
    return got.select(*(F.col(k).alias(c) for k, c in zip(shown, extra)), F.col("s").alias(name))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: ``id_col, held_out, score, predicted``.

    Edge cases: a null or empty text has the score of a text without hits; a
    null id is never learned from and counts as not held out; rows that repeat
    an id are scored each; labels that repeat an id count once, as toxic if any
    is; without labels the fixed insults decide; an empty table gives no rows;
    no other column of ``docs`` is read.
    """
    model = train(docs, labels, id_col, text_col, **options)
    scored = score(docs, model, text_col, (id_col,))
    return scored.select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns, whatever their names.

    Edge cases as in ``toxicity``: null and empty texts have the score of a text
    without hits, null and repeated ids are judged row by row by their texts,
    and an empty table stays empty.
    """
    model = train(docs, labels, id_col, text_col, **options)
    name = "score"
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return score(docs, model, text_col, tuple(docs.columns), name).where(F.col(name) < 0.5).drop(name)
