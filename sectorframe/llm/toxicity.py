"""Toxicity of whole texts by weak supervision.

Named voters vote on a document: lexicons of words, one for each slice of the labelled texts, which
has the words that are most frequent among its toxic ones; lexicons of beginnings of words; patterns of characters that no label has a part in (letters
repeated, digits among letters, shouting, runs of marks); and lexicons of what marks clean texts. A
generative model explains the votes of all documents, labelled or not: for each class, each voter's
rate of voting, where a voter may lean on another with which it is correlated beyond the class. It is
fitted by expectation maximisation on the counts of vote patterns, which number 2 to the voters at
most. A linear classifier on the single terms and patterns is then trained on the posterior labels
of a bounded sample of documents, and scores all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches, stored, text_column
from .labelled import fit_logistic, labelled_sample
from .words import ALPHANUMERIC, buffer, mix, words

#: Bytes of word beginnings that may be terms; 0 is the whole word.
BEGINNINGS = (0, 4, 5)
#: Labelled texts of each class that terms are mined from, at most, and slices of them that have lexicons of their own.
PER_CLASS, SLICES = 10_000, 4
#: Terms that mark toxic texts, and those that mark clean ones, at most.
TERMS, CLEAN_TERMS = 256, 64
#: Patterns of characters.
PATTERNS = ("repeats", "digits", "shouts", "marks")
#: Patterns of votes number 2 to the number of voters at most, the bound of what the driver gets.
VOTERS = (*(f"words_{k}" for k in range(SLICES)), *(f"beginnings_{k}" for k in BEGINNINGS[1:]), *PATTERNS, "clean_words", "clean_beginnings")
CLEAN = np.array([v.startswith("clean") for v in VOTERS])
#: A term occurs in this many texts of its class, at least, and its G2 statistic is at least this.
LEAST_TEXTS, LEAST_G2 = 4, 16.0
#: Documents whose posterior labels the classifier learns from, at most.
LEARNED = 20_000
ROUNDS = 60
#: Correlation within a class from which one voter is modelled as leaning on another.
LEANING = 0.1


def patterns(texts: pa.Array) -> list[np.ndarray]:
    """Which texts have each of PATTERNS."""
    data, bounds = buffer(texts)
    low = data | 32
    letter, digit = (low >= 97) & (low <= 122), (data >= 48) & (data <= 57)
    upper, mark = (data >= 65) & (data <= 90), (data == 33) | (data == 63)
    found = [
        (letter[:-2] & (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:]), 3),
        (letter[:-2] & digit[1:-1] & letter[2:], 3),
        (upper[:-3] & upper[1:-2] & upper[2:-1] & upper[3:], 4),
        (mark[:-1] & mark[1:], 2),
    ]
    out = []
    for hit, width in found:
        at = np.flatnonzero(hit)
        owner = np.searchsorted(bounds, at, "right") - 1
        out.append(np.unique(owner[at + width <= bounds[owner + 1]]))
    return out


def term_hashes(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of BEGINNINGS: hashes of all terms of all texts, and the text of each."""
    found = words(texts, ALPHANUMERIC)
    owner = np.repeat(np.arange(len(texts)), np.diff(found.bounds))
    out = [(mix(found.hashes ^ np.uint64(1)), owner)]
    for size in BEGINNINGS[1:]:
        long = np.flatnonzero(found.lengths > size)
        h = np.zeros(len(long), np.uint64)
        for k in range(size):
            h = (h << np.uint64(8)) | found.data[found.starts[long] + k].astype(np.uint64)
        out.append((mix(h * np.uint64(16) + np.uint64(size)), owner[long]))
    return out


_COUNTS = "term bigint, size int, " + ", ".join(f"{x}{k} bigint" for k in range(SLICES) for x in ("pos", "neg"))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each term in a batch: toxic and other texts of each slice that have it."""
    for batch in small_batches(batches):
        kind = 2 * batch.column("slice").to_numpy() + 1 - batch.column("y").to_numpy()
        for size, (terms, owner) in zip(BEGINNINGS, term_hashes(text_column(batch)), strict=True):
            if not len(terms):
                continue
            order = np.lexsort((owner, terms))
            terms, owner = terms[order], owner[order]
            first = np.append(True, (terms[1:] != terms[:-1]) | (owner[1:] != owner[:-1]))
            terms, own = terms[first], kind[owner[first]]
            starts = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
            n = [np.add.reduceat((own == k).astype(np.int64), starts) for k in range(2 * SLICES)]
            names = [f"{x}{k}" for k in range(SLICES) for x in ("pos", "neg")]
            yield pa.RecordBatch.from_pydict({"term": pa.array(terms[starts].view(np.int64)), "size": pa.array(np.full(len(starts), size), pa.int32()), **dict(zip(names, map(pa.array, n), strict=True))})


class Terms(NamedTuple):
    hashes: np.ndarray
    voters: np.ndarray  # terms and patterns x voters: whether it makes the voter vote


def mine(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[Terms, float]:
    """Terms that mark toxic or clean texts with the voters that they belong to, and the share of toxic labels."""
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(SLICES)).cast("int")
    sample = stored(labelled_sample(docs, labels, "toxic", per_class).withColumn("slice", part), "toxic-sample")
    n = {(r.y, r.slice): r.n for r in sample.groupBy("y", "slice").agg(F.count("*").alias("n")).collect()}
    toxic, clean = (sum(v for (y, _), v in n.items() if y == q) for q in (1, 0))
    rate = float(labels.where(F.col("toxic").isin(0, 1) & ~held_out()).agg(F.avg("toxic")).head()[0] or 0.0)
    found = sample.mapInArrow(_counts, _COUNTS).groupBy("term", "size").agg(*[F.sum(f"{x}{k}").alias(f"{x}{k}") for k in range(SLICES) for x in ("pos", "neg")])
    pos, neg = (sum((F.col(f"{x}{k}") for k in range(1, SLICES)), F.col(f"{x}0")).cast("double") for x in ("pos", "neg"))
    found = found.withColumns({"pos": pos, "neg": neg})
    pos, neg, share = F.col("pos"), F.col("neg"), (F.col("pos") + F.col("neg")) / max(1, toxic + clean)

    def part_of(k, of, expected):
        return F.when((k > 0) & (expected > 0), k * F.ln(k / (expected * of))).otherwise(0.0)

    found = found.withColumn("g2", 2 * (part_of(pos, toxic, share) + part_of(neg, clean, share) + part_of(toxic - pos, toxic, 1 - share) + part_of(clean - neg, clean, 1 - share)))
    telling = found.where((F.col("g2") >= LEAST_G2) & F.lit(toxic > 0 and clean > 0))
    marks_toxic = telling.where((pos >= LEAST_TEXTS) & (pos * clean > 8 * neg * toxic)).orderBy(F.desc("g2"), "term").limit(TERMS)
    marks_clean = telling.where((neg >= LEAST_TEXTS) & (neg * toxic > 8 * pos * clean)).orderBy(F.desc("g2"), "term").limit(CLEAN_TERMS)
    best = [(r, False) for r in marks_toxic.collect()] + [(r, True) for r in marks_clean.collect()]
    voters = np.zeros((len(best) + len(PATTERNS), len(VOTERS)), bool)
    for k, (r, is_clean) in enumerate(best):
        if is_clean:
            voters[k, VOTERS.index("clean_beginnings" if r["size"] else "clean_words")] = True
        elif r["size"]:
            voters[k, VOTERS.index(f"beginnings_{r['size']}")] = True
        else:
            # Each word has one lexicon, so that a single word isn't several votes.
            voters[k, max(range(SLICES), key=lambda s: r[f"pos{s}"] / max(1, n.get((1, s), 0)))] = True
    for k, name in enumerate(PATTERNS):
        voters[len(best) + k, VOTERS.index(name)] = True
    return Terms(np.array([r.term for r, _ in best], np.int64).view(np.uint64), voters), rate


class LabelModel(NamedTuple):
    prior: float  # share of toxic documents
    leans: np.ndarray  # of each voter, the voter it leans on, or -1
    rates: np.ndarray  # class x vote of the one leaned on x voter: rate of voting

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of toxic for rows of votes (0 or 1)."""
        leaned = np.where(self.leans >= 0, votes[:, self.leans], 0)
        voter = np.arange(votes.shape[1])
        logs = []
        for y, share in ((0, 1 - self.prior), (1, self.prior)):
            p = self.rates[y][leaned, voter]
            logs.append(np.log(share) + np.where(votes == 1, np.log(p), np.log1p(-p)).sum(1))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))


def _rates(votes: np.ndarray, n: np.ndarray, toxic: np.ndarray, leans: np.ndarray, clean: np.ndarray) -> np.ndarray:
    out = np.zeros((2, 2, votes.shape[1]))
    for y, weight in ((0, n * (1 - toxic)), (1, n * toxic)):
        for j, on in enumerate(leans):
            # As if seen before: documents of a voter's own class vote more often than others.
            voted, of = (0.5, 2.0) if bool(y) != bool(clean[j]) else (0.05, 10.0)
            for value in (0, 1):
                w = weight * (votes[:, on] == value) if on >= 0 else weight
                out[y, value, j] = ((w * votes[:, j]).sum() + voted) / (w.sum() + of)
    return np.clip(out, 1e-5, 1 - 1e-5)


def fit_label_model(votes: np.ndarray, n: np.ndarray, prior: float, clean: np.ndarray | None = None, first: np.ndarray | None = None) -> LabelModel:
    """Expectation maximisation on counted patterns: first with independent voters, then with the
    strongest correlations within a class, which form a forest.

    ``clean``: voters that vote for clean; ``first``: those whose votes are the first guess.
    """
    clean = np.zeros(votes.shape[1], bool) if clean is None else clean
    first = ~clean if first is None else first
    prior = float(np.clip(prior, 1e-4, 1 - 1e-4))
    leans = np.full(votes.shape[1], -1)
    toxic = np.where(votes[:, first].any(1), 0.9, 0.01)
    for stage in range(2):
        for _ in range(ROUNDS):
            model = LabelModel(prior, leans, _rates(votes, n, toxic, leans, clean))
            now = model.posterior(votes)
            done, toxic = np.abs(now - toxic).max() < 1e-7, now
            if done:
                break
        if stage == 0:
            pairs = []
            for y, weight in ((0, n * (1 - toxic)), (1, n * toxic)):
                mean = (weight @ votes) / max(weight.sum(), 1e-9)
                spread = (votes - mean) * np.sqrt(weight)[:, None]
                cov = spread.T @ spread / max(weight.sum(), 1e-9)
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                corr = cov / np.outer(sd, sd)
                share = weight.sum() / n.sum()
                pairs.append(np.abs(corr) * (share > 0.005))
            corr = np.maximum(*pairs)
            root = np.arange(len(leans))
            for k in np.argsort(-np.triu(corr, 1), axis=None):
                i, j = divmod(int(k), len(leans))
                if corr[i, j] < LEANING or i >= j:
                    break
                if root[i] != root[j] and leans[j] < 0:
                    leans[j] = i
                    root[root == root[j]] = root[i]
    return model


def accuracies(model: LabelModel, votes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each voter's estimated chance that a document it votes on is of its class, over counted patterns of votes
    (NaN for one that never votes)."""
    toxic = model.posterior(votes)
    of_class = np.where(CLEAN, (1 - toxic)[:, None], toxic[:, None])
    voted = (n[:, None] * votes).sum(0)
    return (n[:, None] * votes * of_class).sum(0) / np.where(voted, voted, np.nan)


def hits(docs: DataFrame, terms: Terms) -> DataFrame:
    """``doc_id, n, hits``: words of each row's whole text and the numbers of the terms and patterns it has, ascending."""
    order = np.argsort(terms.hashes)
    ordered, all_ = terms.hashes[order], len(terms.voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = text_column(batch)
            found = term_hashes(texts)
            n = np.bincount(found[0][1], minlength=batch.num_rows)
            pairs = [own * np.int64(all_) + len(ordered) + k for k, own in enumerate(patterns(texts))]
            for own, owner in found if len(ordered) else []:
                at = np.minimum(np.searchsorted(ordered, own), len(ordered) - 1)
                ok = np.flatnonzero(ordered[at] == own)
                pairs.append(np.unique(owner[ok] * np.int64(all_) + order[at[ok]]))
            owners, which = np.divmod(np.unique(np.concatenate(pairs)), all_)
            edges = np.searchsorted(owners, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(which, pa.int32()))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "n": pa.array(n, pa.int64()), "hits": lists})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, hits array<int>")


def label_model(found: DataFrame, terms: Terms, prior: float) -> LabelModel | None:
    """The generative model, from the votes on all documents; none where no voter mined from labels votes."""
    masks = F.array(*[F.lit(int(v @ (1 << np.arange(len(VOTERS))))) for v in terms.voters])
    pattern = F.aggregate("hits", F.lit(0), lambda a, k: a.bitwiseOR(F.element_at(masks, k + 1)))
    counted = found.select(pattern.alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n")).toPandas()
    votes = (counted["pattern"].to_numpy(np.int64)[:, None] >> np.arange(len(VOTERS))) & 1
    first = np.array([v.startswith(("words", "beginnings")) for v in VOTERS])
    if not len(terms.hashes) or not votes[:, first].any():
        return None
    return fit_label_model(votes, counted["n"].to_numpy(np.float64), prior, CLEAN, first)


def fit(found: DataFrame, terms: Terms, prior: float) -> np.ndarray:
    """The classifier's weights (the last is the constant), from the terms found in all documents."""
    model, width = label_model(found, terms, prior), len(terms.voters)
    if model is None:
        p = float(np.clip(prior, 1e-4, 0.4))
        return np.append(np.zeros(width), np.log(p / (1 - p)))
    # Half of the sample is of texts with terms, as far as there are any.
    by, marked = F.xxhash64("doc_id", "hits"), F.exists("hits", lambda k: k < len(terms.hashes))
    some, none = (found.where(c).orderBy(by).limit(LEARNED // 2) for c in (marked, ~marked))
    sample = some.union(none).select("hits").toPandas()["hits"]
    x = np.zeros((len(sample), width))
    for row, own in zip(x, sample, strict=True):
        row[np.asarray(own, np.int64)] = 1
    return fit_logistic(x, model.posterior((x @ terms.voters > 0).astype(np.int64)), ridge=0.05)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs`` (``doc_id``, ``text``).

    A null or empty text has no term and gets the score of such texts. Null ids count as not
    held out and are never labelled; repeated rows and other columns change nothing. Without
    labels of both kinds there are no terms, and all scores are the share of toxic labels. A long
    text's words are looked at whole, slice by slice.
    """
    terms, prior = mine(docs, labels)
    found = stored(hits(docs, terms), "hits")
    weights = fit(found, terms, prior)
    # 324 weights at most, as a literal of the plan.
    each = F.array(*[F.lit(float(w)) for w in weights[:-1]])
    total = F.aggregate("hits", F.lit(float(weights[-1])), lambda a, k: a + F.element_at(each, k + 1))
    score = 1 / (1 + F.exp(-total))
    return found.select("doc_id", held_out().alias("held_out"), score.alias("score")).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
