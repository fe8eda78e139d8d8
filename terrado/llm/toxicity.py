"""Toxicity: weak supervision by many lexicon and pattern voters.

Voters are the words of a short lexicon and the word beginnings that a bounded
sample of labelled rows singles out, and voters that speak for a clean text. A
generative label model (expectation maximisation over the votes, without labels)
estimates the accuracy of each and the correlations between them; correlated
voters share their weight. A linear classifier is trained on its posterior
labels and scores every whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrado.llm.common import WORD_BYTES, drop_table, materialize, slices, texts_of, utf8
from terrado.llm.labelled import fold, sample_labels

# Insults, each a voter.
LEXICON = (
    "clown", "coward", "disgusting", "dumb", "filthy", "freak", "idiot", "imbecile", "jerk", "liar", "loser", "moron",
    "pathetic", "pervert", "retard", "scum", "shut", "stupid", "sucker", "swine", "trash", "vermin", "worthless",
)

SAMPLE = 20_000
#: Pattern voters at most; a pattern needs so many toxic rows, and their share among its rows.
PATTERNS, LEAST_ROWS, LEAST_SHARE = 240, 4, 0.8
#: Lengths in bytes of the word beginnings that are tried, and how many different words of a text must begin so.
STEMS = (4, 5, 6, 7, 8)
TIMES = (1, 2, 3)
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
ROUNDS = 40
#: Rows of the sample that the fit takes at a time, and columns of the classifier besides those of the voters.
BLOCK, EXTRA = 1024, 5


def _words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def _stems(text: bytes) -> Counter:
    """Word beginnings of a text, with the number of different words that begin so."""
    distinct = set(_words(text))
    return Counter([w[:n] for w in distinct for n in STEMS if len(w) >= n])


def mine_patterns(known: DataFrame, limit: int = PATTERNS, least_rows: int = LEAST_ROWS, least_share: float = LEAST_SHARE) -> list[tuple[bytes, int]]:
    """(word beginning, least number of different words) that toxic rows of the sample have and others hardly; shorter beginnings stand for longer ones."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, other = Counter(), Counter()
            for text, y in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                into = toxic if y >= 0.5 else other
                for stem, n in _stems(text).items():
                    for k in TIMES[: n if n < len(TIMES) else None]:
                        into[stem, k] += 1
            terms = list(toxic | other)
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in terms], pa.binary()), pa.array([k for _, k in terms], pa.int32()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([other[t] for t in terms], pa.int64())],
                names=["term", "times", "toxic", "other"],
            )

    counts = known.select("doc_id", "text", "y").mapInArrow(over, "term binary, times int, toxic long, other long")
    sums = counts.groupBy("term", "times").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    kept = sums.where((F.col("toxic") >= least_rows) & (F.col("toxic") >= least_share * (F.col("toxic") + F.col("other"))))
    score = F.log2((F.col("toxic") + 0.5) / (F.col("other") + 0.5)) * F.sqrt("toxic")
    best = kept.orderBy(score.desc(), "term", "times").limit(8 * limit).collect()
    rows = {(bytes(r["term"]), r["times"]): (r["toxic"], r["other"]) for r in best}
    chosen: list[tuple[bytes, int]] = []
    for term, times in rows:
        shorter = [(term[:n], times) for n in STEMS if n < len(term) and (term[:n], times) in rows]
        if not any(rows[x][1] * 20 <= rows[x][0] for x in shorter) and len(chosen) < limit:
            chosen.append((term, times))
    return chosen


class Voters:
    """Hits of each voter in a text: places of a lexicon word, or different words with a pattern's beginning if they are enough."""

    def __init__(self, lexicon: tuple[str, ...], patterns: list[tuple[bytes, int]]):
        self.whole = {w.encode(): i for i, w in enumerate(lexicon)}
        self.begin: dict[bytes, list[tuple[int, int]]] = {}
        for i, (stem, times) in enumerate(patterns):
            self.begin.setdefault(stem, []).append((len(lexicon) + i, times))
        self.first = {x[:4] for x in [*self.whole, *self.begin]}
        self.lengths = sorted({len(stem) for stem in self.begin})
        self.n = len(lexicon) + len(patterns)

    def __call__(self, text: bytes) -> tuple[int, Counter]:
        words, first = _words(text), self.first
        hits: Counter = Counter()
        found = [w for w in words if w[:4] in first]
        for w in found:
            if (i := self.whole.get(w)) is not None:
                hits[i] += 1
        stems = Counter([w[:n] for w in set(found) for n in self.lengths if len(w) >= n])
        for stem, count in stems.items():
            for i, times in self.begin.get(stem, ()):
                if count >= times:
                    hits[i] = count
        return len(words), hits


def votes(counts: np.ndarray, words: np.ndarray, n_lexicon: int) -> np.ndarray:
    """1 toxic, -1 clean, 0 none: a vote for each voter that has hits, and four voters that speak for a clean text."""
    hit = (counts > 0).astype(np.int8)
    total = counts.sum(1, dtype=float)
    clean = np.stack([hit[:, :n_lexicon].sum(1) == 0, hit[:, n_lexicon:].sum(1) == 0, total == 0, total * 200 < words], 1)
    return np.hstack([hit, -clean.astype(np.int8)])


def _blocks(n: int) -> Iterator[slice]:
    """The rows a block at a time, so that only votes of one byte each are held for all of them."""
    for at in range(0, n, BLOCK):
        yield slice(at, at + BLOCK)


class LabelModel:
    """Accuracies of voters and the class share by expectation maximisation; correlated voters share their weight."""

    def __init__(self, v: np.ndarray, share: float = 0.1, rounds: int = ROUNDS):
        n, m = v.shape
        total, rate = v.sum(0, dtype=np.int64), np.count_nonzero(v, 0) / max(n, 1)
        own = np.where(rate > 0, np.where(total > 0, 1, -1), 0)  # voters vote one way only
        q = np.clip(0.5 + 0.25 * v.sum(1, dtype=np.int64), 0.02, 0.98)
        self.discount = np.ones(m)
        for step in range(rounds):
            self.share = float(np.clip((q.sum() + share) / (n + 1.0), 1e-3, 0.999))
            toxic, clean = max(q.sum(), 1e-9), max((1 - q).sum(), 1e-9)
            in_toxic, in_clean = np.zeros(m), np.zeros(m)
            for at in _blocks(n):
                fired = (v[at] != 0).astype(float)
                in_toxic += q[at] @ fired
                in_clean += (1 - q[at]) @ fired
            # a voter's prior: it fires five times as often in its own class
            p1 = (in_toxic + 2 * np.clip(rate * np.where(own > 0, 1, 0.2), 1e-4, 1)) / (toxic + 2)
            p0 = (in_clean + 2 * np.clip(rate * np.where(own > 0, 0.2, 1), 1e-4, 1)) / (clean + 2)
            self.p1, self.p0 = np.clip(p1, 1e-5, 1 - 1e-5), np.clip(p0, 1e-5, 1 - 1e-5)
            if step in (5, 15) and n > 1:
                together = np.zeros((m, m))
                for at in _blocks(n):
                    left = (v[at] != 0) - np.outer(q[at], self.p1) - np.outer(1 - q[at], self.p0)
                    together += left.T @ left
                scale = np.sqrt(np.maximum(np.diag(together) / n, 1e-9))
                self.correlation = together / n / np.outer(scale, scale)
                np.fill_diagonal(self.correlation, 0)
                self.discount = 1 / (1 + np.where(self.correlation > 0.1, self.correlation, 0).sum(1))
            q = self.posterior(v)
        self.accuracy = np.where(own > 0, self.p1 * self.share, self.p0 * (1 - self.share)) / np.maximum(self.p1 * self.share + self.p0 * (1 - self.share), 1e-12)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        silent = np.log((1 - self.p1) / (1 - self.p0)) * self.discount
        more = np.log(self.p1 / self.p0) * self.discount - silent
        z = np.empty(len(v))
        for at in _blocks(len(v)):
            z[at] = (v[at] != 0) @ more
        z += np.log(self.share / (1 - self.share)) + silent.sum()
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def design(counts: np.ndarray, words: np.ndarray, n_lexicon: int) -> np.ndarray:
    """Columns of the linear classifier: log counts by voter, log sums by family, log density, a constant."""
    lexicon, pattern = counts[:, :n_lexicon].sum(1, dtype=float), counts[:, n_lexicon:].sum(1, dtype=float)
    total = lexicon + pattern
    more = [np.log1p(lexicon), np.log1p(pattern), np.log1p(100 * total / np.maximum(words, 1)), (total > 0).astype(float), np.ones(len(words))]
    return np.hstack([np.log1p(counts, dtype=float), np.stack(more, 1)])


def fit_linear(counts: np.ndarray, words: np.ndarray, n_lexicon: int, target: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps, summed over blocks of rows; the constant is not shrunk."""
    size = counts.shape[1] + EXTRA
    w = np.zeros(size)
    shrink = np.diag([ridge] * (size - 1) + [1e-6])
    for _ in range(rounds):
        curve, slope = shrink.copy(), -shrink @ w
        for at in _blocks(len(counts)):
            x = design(counts[at], words[at], n_lexicon)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            curve += (x * (p * (1 - p) + 1e-9)[:, None]).T @ x
            slope += x.T @ (target[at] - p)
        change = np.linalg.solve(curve, slope)
        w = w + np.clip(change, -4, 4)
        if np.abs(change).max() < 1e-6:
            break
    return w


def _counted(texts: pa.Array, voters: Voters) -> tuple[np.ndarray, np.ndarray]:
    counts, words = np.zeros((len(texts), voters.n), np.float32), np.zeros(len(texts))
    for i, text in enumerate(utf8(texts)):
        words[i], hits = voters(text)
        for j, n in hits.items():
            counts[i, j] = n
    return counts, words


class Scorer:
    """Scores of texts: the voters and the linear classifier."""

    def __init__(self, voters: Voters, n_lexicon: int, weights: np.ndarray):
        self.voters, self.n_lexicon, self.weights = voters, n_lexicon, weights

    def __call__(self, texts: pa.Array) -> np.ndarray:
        z = design(*_counted(texts, self.voters), self.n_lexicon) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: DataFrame, labels: DataFrame, *, label_col: str = "toxic", lexicon: tuple[str, ...] = LEXICON, sample: int = SAMPLE, folds: int = FOLDS, held_out: int = HELD_OUT) -> Scorer:
    """A scorer from texts (doc_id, text) and labels, of which at most `sample` outside the held-out fold count."""
    chosen = sample_labels(labels, label_col, folds, held_out, sample)
    # of rows that repeat an id one counts, that of the smallest hash: at most `sample` rows
    known = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "y"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("one"))
    known = materialize(known.select("doc_id", "one.text", "one.y"))
    voters = Voters(lexicon, mine_patterns(known))
    n_lexicon = len(lexicon)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, words = _counted(batch.column(1), voters)
            rows = [np.minimum(c, 255).astype(np.uint8).tobytes() for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), pa.array(words, pa.float64())], names=["doc_id", "counts", "words"])

    kind = known.schema["doc_id"].dataType.simpleString()
    rows = known.select("doc_id", "text").mapInArrow(gather, f"doc_id {kind}, counts binary, words double").orderBy("doc_id").toArrow()
    drop_table(known)
    counts = np.frombuffer(b"".join(rows["counts"].to_pylist()), np.uint8).reshape(-1, voters.n)
    words = rows["words"].to_numpy()
    if len(words):
        v = np.vstack([votes(counts[at], words[at], n_lexicon) for at in _blocks(len(words))])
        weights = fit_linear(counts, words, n_lexicon, LabelModel(v).posterior(v))
    else:
        weights = np.zeros(voters.n + EXTRA)
        weights[-2:] = 3.0, -2.0  # any hit of the lexicon: 0.73
    return Scorer(voters, n_lexicon, weights)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    lexicon: tuple[str, ...] = LEXICON,
    sample: int = SAMPLE,
    folds: int = FOLDS,
    held_out: int = HELD_OUT,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1, higher: toxic likelier), predicted.

    Labels (which choose the pattern voters) are used only outside the held-out
    fold, from at most `sample` rows; the label model and the classifier see
    those rows' texts (of rows that repeat an id the one of the smallest MD5). Null texts are scored as empty ones. Without labelled
    rows the lexicon alone votes.
    """
    texts = texts_of(docs, id_col, text_col)
    score = train(texts, labels, label_col=label_col, lexicon=lexicon, sample=sample, folds=folds, held_out=held_out)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(score(batch.column(1)), pa.float64())], names=["doc_id", "score"])

    scored = texts.mapInArrow(over, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """docs without the rows that score the threshold or more; all columns stay, and rows without text. No shuffle of the texts."""
    score = train(texts_of(docs, id_col, text_col), labels, **options)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(score(batch.column(text_col)) < threshold))

    return docs.mapInArrow(over, docs.schema)
