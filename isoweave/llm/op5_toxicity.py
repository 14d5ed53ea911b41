"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, and a linear classifier.

1. Voters: every word of a lexicon, a few patterns, and word stems that the labelled rows single out.  A voter fires or abstains.
2. The label model takes the voters' joint firing counts over all documents (one distributed sum of a voters x voters
   matrix).  Firing rates given each class come from all triplets of covariances, anchored by the voters' counts on labelled rows;
   pairs that fire together more often than the two classes explain are correlated, and their evidence is divided accordingly.
3. The posterior of each training document's votes is the label of a logistic regression over words and stems.  The training
   documents are drawn from all documents, labelled or not, and no label of the table reaches this step.
4. Scoring is a map over Arrow batches with the classifier's weights, which are bounded by ``FEATURES``.

Voters are mined and anchored on about ``SAMPLE`` labelled rows at most, and the classifier learns from about ``SAMPLE`` different
texts, both drawn by a hash of the text; the counts of step 2 cover every row.

Defined results: a null or empty text has no feature and gets the bias as its score; rows with equal texts get equal
scores; an id labelled twice counts as toxic if any label says so; without labelled rows the lexicon alone decides; other
columns pass through, whatever their names, except score and predicted, which are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from isoweave.llm.op1_langid import remainder
from isoweave.runtime import column, cut, map_arrow, table

#: labelled rows to learn from, mined stems, features of the classifier, the rows and the likelihood ratio that a feature needs
SAMPLE, STEMS, FEATURES, SUPPORT, EVIDENCE = 20000, 64, 4096, 4, 14.0
PREFIXES = (4, 5, 6, 7, 8)
THRESHOLD = 0.3
#: documents that the covariances of a voter stand for beside its labelled rows, and the triplets at which they stand for half of them
UNLABELLED, TRIPLETS = 200, 10
#: numbers of firing voters that are told apart
FIRINGS = 4
WORD = re.compile(r"[^\W\d_]+")

#: Fixed word list of common insults.
LEXICON = (
    "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb fool jerk creep filth vermin garbage "
    "imbecile cretin dimwit halfwit nitwit degenerate lowlife scumbag dirtbag bastard bitch asshole shit fuck fucking crap "
    "retard slut whore pig parasite cockroach subhuman inferior hateful vile repulsive coward liar hypocrite freak psycho "
    "lunatic brainless clueless useless ugly"
).split()

#: Fixed patterns over the lower-case text.
PATTERNS = [
    r"\byou(?:'re| are)? (?:such )?an? (?:\w+ ){0,2}(?:idiot|moron|loser|clown|fool|jerk|coward|liar|freak)\b",
    r"\b(?:shut up|go to hell|drop dead|get lost|kill yourself|nobody likes you)\b",
    r"\bi hate (?:you|them|those|these)\b",
    r"\b(?:those|these|all) (?:people|animals|pigs) (?:are|should)\b",
    r"\b(?:[a-z][*@#$!]+[a-z]+|1d10t|m0ron|l0ser|tr4sh|st[u\*]p[i1\*]d)\b",
    r"\b(?:piece of|full of) (?:trash|garbage|crap|shit|filth)\b",
]
#: for each pattern, parts of which every match contains at least one
GATES = [
    ["you"], ["shut up", "go to hell", "drop dead", "get lost", "kill yourself", "nobody likes you"], ["i hate "], ["those ", "these ", "all "],
    [*"*@#$!", "1d10t", "m0ron", "l0ser", "tr4sh", "stup"], ["piece of ", "full of "],
]
COMPILED = [(re.compile(p), g) for p, g in zip(PATTERNS, GATES, strict=True)]
#: tokens between spaces whose features a task remembers; letters by which a word is told apart, marks around a word
WORDS, HEAD, MARKS = 1 << 17, min(PREFIXES), ".,;:!?()[]\"'"


def tokens(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features(words: set[str]) -> set[str]:
    """Words as they are, and the stems of longer ones marked by a final hyphen."""
    out = set(words)
    for n in PREFIXES:
        out.update([w[:n] + "-" for w in words if len(w) > n])
    return out


class Lexer:
    """Which of some features a text has; words are looked up once."""

    def __init__(self, names):
        self.names, self.known = frozenset(names), {}
        self.heads = {n.rstrip("-")[:HEAD] for n in names}  # no stem is shorter, so a word that begins otherwise has no feature

    def __call__(self, text: str | None) -> set[str]:
        out: set[str] = set()
        for w in set((text or "").lower().split()):  # no word spans a space
            found = self.known.get(w)
            if found is None:
                if len(self.known) >= WORDS:
                    self.known.clear()
                bare = w.strip(MARKS)
                plain = bare.isalpha() and bare[:HEAD] not in self.heads
                found = self.known[w] = () if plain else tuple(features(tokens(w)) & self.names)
            if found:
                out.update(found)
        return out


def _map(df: DataFrame, f, kinds: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """Rows that ``f(rows of the batch as tuples)`` yields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(f(zip(*(c.to_pylist() for c in batch.columns))))
            columns = list(zip(*rows)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, _, k) in zip(columns, kinds)], [n for n, _, _ in kinds])

    return df.mapInArrow(run, ", ".join(f"`{n}` {s}" for n, s, _ in kinds))


class Voters:
    """Names in order: lexicon, patterns, stems."""

    def __init__(self, stems: list[str]):
        self.words = {w: i for i, w in enumerate(LEXICON)} | {s: len(LEXICON) + len(PATTERNS) + i for i, s in enumerate(stems)}
        self.n = len(LEXICON) + len(PATTERNS) + len(stems)

    def __call__(self, text: str | None, found: set[str]) -> list[int]:
        """Voters that fire on a text with these features."""
        fired = [self.words[w] for w in found & self.words.keys()]
        lowered = (text or "").lower()
        fired += [len(LEXICON) + i for i, (p, gate) in enumerate(COMPILED) if any(g in lowered for g in gate) and p.search(lowered)]
        return sorted(fired)


def mined(counts: list[tuple[str, int, int]], positive: int, negative: int, limit: int = STEMS) -> list[str]:
    """Features that are common among toxic rows and nearly absent from clean ones; of nested stems the shorter stays."""
    scored = []
    for name, n1, n0 in counts:
        a, b = (n1 + 0.1) / (positive + 1), (n0 + 0.1) / (negative + 1)
        if n1 >= SUPPORT and a > 20 * b and not any(w.startswith(name.rstrip("-")) for w in LEXICON):
            scored.append((-n1 * np.log(a / b), name))
    out: list[str] = []
    for _, name in sorted(scored):
        if len(out) < limit and not any(name.rstrip("-").startswith(s[:-1]) or s.rstrip("-").startswith(name.rstrip("-")) for s in out if s.endswith("-")):
            out.append(name)
    return out


def joint_counts(docs: DataFrame, voters: Voters, text: str) -> tuple[np.ndarray, int]:
    """The voters x voters matrix of joint firings over every row, and the number of rows."""

    def count(rows):
        pairs, n, lexer = Counter(), 0, Lexer(voters.words)
        for (t,) in rows:
            fired = voters(t, lexer(t))
            pairs.update((i, j) for i in fired for j in fired if i <= j)
            n += 1
        yield from ((i, j, c) for (i, j), c in pairs.items())
        yield (-1, -1, n)

    sums = _map(docs.select(text), count, [("i", "int", pa.int32()), ("j", "int", pa.int32()), ("n", "long", pa.int64())]).groupBy("i", "j").agg(F.sum("n").alias("n"))
    out, total = np.zeros((voters.n, voters.n)), 0
    for i, j, n in sums.collect():  # at most voters squared
        if i < 0:
            total = n
        else:
            out[i, j] = out[j, i] = n
    return out, total


class LabelModel:
    """Firing rates ``a`` given toxic and ``b`` given clean, the share of toxic rows, and the voters' correlations.

    ``fired`` are the voters that fire on the labelled rows, ``gold`` their classes: counts of both anchor the rates.
    """

    def __init__(self, joint: np.ndarray, total: int, fired: list[np.ndarray], gold: np.ndarray):
        n1, n0, total = gold.sum(), (1 - gold).sum(), max(1, total)
        self.prior = float(np.clip((n1 + 1) / (n1 + n0 + 10), 0.01, 0.5))
        rate = np.diag(joint) / total
        seen = [np.bincount(np.concatenate([*(f for f, y in zip(fired, gold) if y == c), np.zeros(0, np.int64)]).astype(np.int64), minlength=len(rate)) for c in (0, 1)]
        # the anchor: labelled rows, smoothed towards a voter of average use
        strength = 2.0
        self.a, self.b = (seen[1] + strength * 0.2) / (n1 + strength), (seen[0] + strength * 0.002) / (n0 + strength)
        spread = np.sqrt((1 - self.prior) / self.prior)
        cov = joint / total - np.outer(rate, rate)
        for i in range(len(rate)):
            partners = np.flatnonzero(cov[i] > 1e-9)
            partners = partners[partners != i]
            j, k = (partners[x] for x in np.triu_indices(len(partners), 1))
            told = cov[j, k] > 1e-9
            if told.any():
                v = np.sqrt(np.median(cov[i, j[told]] * cov[i, k[told]] / cov[j[told], k[told]]))
                rows = UNLABELLED * told.sum() / (told.sum() + TRIPLETS)
                w1, w0 = (w / (w + n) for w, n in ((rows * self.prior, n1), (rows * (1 - self.prior), n0)))
                self.a[i] = (1 - w1) * self.a[i] + w1 * np.clip(rate[i] + v * spread, 0.5 / total, 0.95)
                self.b[i] = (1 - w0) * self.b[i] + w0 * np.clip(rate[i] - v / spread, 0.5 / total, 0.95)
        # joint firings beyond what the classes explain, as a correlation; the evidence of a clique counts once
        told = self.prior * np.outer(self.a, self.a) + (1 - self.prior) * np.outer(self.b, self.b)
        scale = np.sqrt(np.maximum(np.outer(rate, rate), 1e-12))
        self.correlation = np.clip((joint / total - told) / scale, 0, 1)
        np.fill_diagonal(self.correlation, 0)
        self.weight = 1 / (1 + self.correlation.sum(1))
        # how many voters fire is evidence of its own; what one says on average beyond the usual for their number is added to it
        many, said = self._said(fired)
        self.base, self.usual = np.zeros(FIRINGS), np.zeros(FIRINGS)
        for k in range(FIRINGS):
            own = many == k
            p1, p0 = ((own & (gold == c)).sum() for c in (1, 0))
            self.base[k] = np.log((p1 + 0.5) / (n1 + 1)) - np.log((p0 + 0.5) / (n0 + 1))
            self.usual[k] = said[own].mean() if own.any() else 0.0

    def _said(self, fired: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """How many voters fire on each row, and their mean evidence."""
        told = np.log(self.a / self.b) * self.weight
        return np.array([min(len(f), FIRINGS - 1) for f in fired], np.int64), np.array([told[f].mean() if len(f) else 0.0 for f in fired])

    def posterior(self, fired: list[np.ndarray]) -> np.ndarray:
        """A single silent voter says nothing (a lexicon of another language is silent on every text)."""
        many, said = self._said(fired)
        odds = np.log(self.prior / (1 - self.prior)) + self.base[many] + said - self.usual[many]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def regress(rows: list[np.ndarray], target: np.ndarray, n: int, steps: int = 300, ridge: float = 2e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels over binary features, by accelerated gradient descent."""
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, momentum, bias, speed = np.zeros(n), np.zeros(n), 0.0, 0.0
    scale = 1 / np.sqrt(np.bincount(flat, minlength=n) / max(1, len(rows)) + 1e-3)
    sums, share = np.zeros(n), 1e-8
    for step in range(steps):
        ahead, ahead_bias = w + 0.9 * momentum, bias + 0.9 * speed
        z = np.bincount(owner, ahead[flat], minlength=len(rows)) + ahead_bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        slope = np.bincount(flat, error[owner], minlength=n) / len(rows) + ridge * ahead
        sums += slope ** 2
        share += error.mean() ** 2
        momentum = 0.9 * momentum - 0.3 * slope / (np.sqrt(sums) + 1e-6) * np.minimum(1, scale / scale.max() + 0.5)
        speed = 0.9 * speed - 0.3 * error.mean() / np.sqrt(share)
        w, bias = w + momentum, bias + speed
        if step % 30 == 29:  # let old slopes fade, so that late steps still move
            sums, share = sums * 0.5, share * 0.5
    return w, float(bias)


def _drawn(rows: DataFrame, text: str, seed: int) -> DataFrame:
    """About ``SAMPLE`` rows at most, drawn by a hash of the text; of equal texts one."""
    n, draw = rows.count(), F.pmod(F.xxhash64(text, F.lit(seed)), F.lit(1 << 30))
    return rows.where(draw < min(1 << 30, int(SAMPLE / max(1, n) * (1 << 30)))).dropDuplicates([text])


def fit(docs: DataFrame, labelled: DataFrame, pool: DataFrame | None = None, text: str = "text") -> tuple[dict[str, float], float]:
    """(weights by feature, bias).

    ``labelled`` has the text and toxic (0 or 1) of the rows to learn voters and anchors from; ``pool`` the documents to draw training
    texts from, all of ``docs`` by default.
    """
    rows = labelled.select(column(text).alias("text"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null")
    docs, pool = docs.select(column(text).alias("text")), (docs if pool is None else pool).select(column(text).alias("text"))
    sample = cut(_drawn(rows, "text", 5))

    def count(batch):
        seen = {0: Counter(), 1: Counter()}
        for t, y in batch:
            seen[1 if y else 0].update(features(tokens(t)))
        yield from ((k, seen[1][k], seen[0][k]) for k in seen[0] | seen[1])

    sizes = {1 if r[0] else 0: r[1] for r in sample.groupBy(F.col("toxic") != 0).count().collect()}
    sums = _map(sample, count, [("k", "string", pa.string()), ("n1", "long", pa.int64()), ("n0", "long", pa.int64())]).groupBy("k").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    # twice the log-likelihood ratio of unequal against equal rates: chance seldom lifts one of 10^5 features over EVIDENCE
    part = lambda k, of: F.when(k > 0, k * F.log(k * F.lit(n1 + n0 + 0.0) / ((F.col("n1") + F.col("n0")) * F.lit(max(1, of))))).otherwise(0.0)
    top = sums.where(F.col("n1") + F.col("n0") >= SUPPORT).withColumn("lean", 2 * (part(F.col("n1"), n1) + part(F.col("n0"), n0)) * F.signum(F.col("n1") * F.lit(n0) - F.col("n0") * F.lit(n1)))
    told = {w[:n] + "-" for w in LEXICON for n in PREFIXES}  # the words themselves are features
    best = [(r.k, r.n1, r.n0) for r in top.where(F.col("lean") > EVIDENCE).orderBy(F.desc("lean"), "k").limit(FEATURES).select("k", "n1", "n0").collect() if r.k not in told]
    if not n1 or not n0:
        return {w: 4.0 for w in LEXICON}, -3.0
    voters = Voters(mined(best, n1, n0))
    joint, total = joint_counts(docs, voters, "text")

    names = sorted({k for k, _, _ in best} | set(LEXICON))
    index = {k: i for i, k in enumerate(names)}

    def anchor(batch):
        lexer = Lexer(voters.words)
        for t, y in batch:
            yield (1 if y else 0, np.array(voters(t, lexer(t)), "<u2").tobytes())

    def describe(batch):
        lexer = Lexer(voters.words.keys() | index.keys())
        for (t,) in batch:
            found = lexer(t)
            yield (np.array(voters(t, found), "<u2").tobytes(), np.array(sorted(index[k] for k in found & index.keys()), "<u2").tobytes())

    ids = lambda body: np.frombuffer(body, "<u2").astype(np.int64)
    known = sorted(map(tuple, _map(sample, anchor, [("y", "int", pa.int32()), ("v", "binary", pa.binary())]).collect()))
    model = LabelModel(joint, total, [ids(v) for _, v in known], np.array([y for y, _ in known]))
    drawn = sorted(map(tuple, _map(_drawn(pool, "text", 7), describe, [("v", "binary", pa.binary()), ("x", "binary", pa.binary())]).collect()))
    weights, bias = regress([ids(x) for _, x in drawn], model.posterior([ids(v) for v, _ in drawn]), len(names))
    return {k: float(w) for k, w in zip(names, weights) if abs(w) > 1e-3}, bias


def predict(df: DataFrame, model: tuple[dict[str, float], float], text: str = "text") -> DataFrame:
    """``df`` with score and predicted."""
    added = StructType.fromDDL("score double, predicted int")
    fields = [f for f in df.schema.fields if f.name not in added.names]
    columns, names = [f.name for f in fields], [f.name for f in fields] + added.names
    held = df.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights and the lexicon

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = held.value
        lexer = Lexer(weights)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                odds = [bias + sum(sorted(map(weights.get, lexer(t)))) for t in part.column(at).to_pylist()]
                scores = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
                kept = [part.column(part.schema.get_field_index(c)) for c in columns]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names)

    return map_arrow(df.select(*map(column, columns)), run, StructType([*fields, *added.fields]))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], float]:
    """The model from ``docs`` (doc_id, text); labels of held-out rows teach nothing, nor do their texts train the classifier."""
    known = labels.where("doc_id is not null and toxic is not null").where(remainder("doc_id", 4) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return fit(docs, docs.select("doc_id", "text").join(known, "doc_id"), docs.where(remainder("doc_id", 4) != 2))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", "text", (remainder("doc_id", 4) == 2).alias("held_out"))
    return predict(rows, model).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLES: dict[str, str] = {}
