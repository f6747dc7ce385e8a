"""Abusive, hateful or sexual content, by class-conditional Kneser-Ney models.

Two trigram models with interpolated Kneser-Ney smoothing, one of toxic passages and one of ordinary text, back off
to unigram counts that they share, so that an expression seen in neither tells nothing. A passage is scored by the
difference of the two log-likelihoods, normalised by its length; a document by its highest passage. Reviews are of
whole documents, so training finds the toxic passages itself: starting from all passages of documents judged toxic,
it keeps those that the models of the last round ascribe to the toxic class, and fits again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.text import let

#: Bound of the labelled sample that is fitted: documents per class, chosen by a hash of their id.
TOXIC_DOCS, CLEAN_DOCS = 2500, 2500
#: Documents scored at a time.
BATCH = 500
ROUNDS, FOLDS, DISCOUNT, PRIOR_TOKENS = 3, 3, 0.75, 3.0
#: Verdict that means no such content. Fixed value.
CLEAN = "clean"
_ZERO_WIDTH = r"[\x{00AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]"
_SPACED = r"(?<![\p{L}\p{N}])\p{L}(?:[ .*_\-]\p{L}){3,}(?![\p{L}\p{N}])"
_APART = r"(?<![\p{L}\p{N}])(\p{L})[ .*_\-](?=\p{L}(?![\p{L}\p{N}]))"
_LEET = r"\p{L}[0134578]{1,2}\p{L}"
#: Invisible characters or look-alike letters: one sign for both, so that a text is read once for the two.
#: The first range turns ordinary characters away with one comparison.
_HIDDEN = r"[\x{00AD}-\x{FEFF}&&[\x{00AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{0400}-\x{052F}]]"
#: Cheap signs of letters set apart and of digits for letters, tried on every text before the replacements; they start
#: at the rarer character and look back from it.
_SET_APART = r"[ .*_\-](?=\p{L}[ .*_\-]\p{L}(?![\p{L}\p{N}]))(?<=[ .*_\-]\p{L}[ .*_\-])"
_DIGITS = r"[0134578](?<=[a-z][0134578])[0134578]?[a-z]"
#: Letters drawn out, and the cheap sign of them.
_DRAWN, _DRAWN_OUT = r"(\p{L})\1{2,}", r"(\p{L})\1\1"
#: Letters of other scripts that look like Latin ones. Fixed values.
_LOOK, _LIKE = "авсеԁһіјкӏмопрѕтухѵԝ", "abcedhijklmonpstyxvw"
_ENDS = ".!?;:\n\t|。！？；"
_LATIN = r"a-z\x{C0}-\x{24F}"
_KANA = r"\x{3040}-\x{30FF}\x{3400}-\x{9FFF}"
#: A word (which may hide letters behind marks), a passage's end, a character of a script without spaces, other words.
_TOKEN = rf"[{_LATIN}][0-9{_LATIN}'*@$]*+|[.!?;:。！？；\n\t|]++|  ++|[{_KANA}]|[\p{{L}}&&[^{_KANA}]]++"
_END = 0  # hash of a passage's end


def plain(text: Column) -> Column:
    """Lower case, without invisible characters, look-alike letters, letters set apart, digits for letters and letters
    drawn out. Each replacement is tried only on texts that show its sign."""
    steps = [
        (_HIDDEN, lambda t: F.translate(F.regexp_replace(t, _ZERO_WIDTH, ""), _LOOK, _LIKE)),
        (_SET_APART, lambda t: F.when(t.rlike(_SPACED), F.regexp_replace(F.regexp_replace(t, _APART, "$1"), "  +", " ")).otherwise(t)),
        (_DIGITS, lambda t: F.array_join(F.transform(F.split(t, " "), lambda w: F.when(w.rlike(_LEET), F.translate(w, "0134578", "oieastb")).otherwise(w)), " ")),
        (_DRAWN_OUT, lambda t: F.regexp_replace(t, _DRAWN, "$1")),
    ]
    out = F.lower(F.coalesce(text, F.lit("")))
    guarded = lambda sign, change: lambda t: F.when(t.rlike(sign), change(t)).otherwise(t)
    for sign, change in steps:
        out = let(out, guarded(sign, change))
    return out


def tokens(text: Column) -> Column:
    """Hashes of a text's tokens, 0 standing for the end of a passage; empty for NULL and ''."""
    ends = [ord(c) for c in _ENDS + " "]
    words = F.regexp_extract_all(plain(text), F.lit(_TOKEN), F.lit(0))
    return F.transform(words, lambda w: F.when(F.ascii(w).isin(ends), F.lit(_END).cast("long")).otherwise(F.xxhash64(w)))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) + np.uint64(0x7F4A7C159E3779B9))
        x ^= x >> np.uint64(29)
        return (x * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


@dataclass
class Table:
    """Counts by key, looked up in whole arrays."""

    keys: np.ndarray
    values: np.ndarray

    def get(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], 0.0)


def _counted(keys: np.ndarray, weights: np.ndarray | None = None) -> Table:
    u, inv = np.unique(keys, return_inverse=True)
    return Table(u, np.bincount(inv, weights=weights, minlength=len(u)).astype(float))


@dataclass
class Grams:
    """Token streams with the keys of their n-grams. Passage ends are no tokens; they begin contexts anew."""

    word: np.ndarray
    prev: np.ndarray  # key of the one-token context
    prev2: np.ndarray  # key of the two-token context
    passage: np.ndarray  # index of the passage

    @classmethod
    def of(cls, flat: np.ndarray, first: np.ndarray) -> Grams:
        """``flat``: hashes of all documents in turn, ``first``: whether a token is its document's first."""
        end = flat == _END
        passage = np.cumsum(end | first)
        p1 = np.where(first, _END, np.roll(flat, 1)) if len(flat) else flat
        p2 = np.where(first | (p1 == _END), _END, np.roll(p1, 1)) if len(flat) else flat
        keep = ~end
        w, a, b = flat[keep], p1[keep], p2[keep]
        return cls(w, a, _mix(b, a), passage[keep])

    def part(self, at: np.ndarray) -> Grams:
        return Grams(self.word[at], self.prev[at], self.prev2[at], self.passage[at])


class KneserNey:
    """Interpolated Kneser-Ney trigrams over shared unigram backoff counts."""

    def __init__(self, g: Grams, shared: Table, total: float):
        self.shared, self.total = shared, total
        tri, at = np.unique(_mix(g.prev2, g.word), return_index=True)
        bi_all = _mix(g.prev, g.word)
        self.c3 = _counted(_mix(g.prev2, g.word))
        self.n3, self.t3 = _counted(g.prev2), _counted(g.prev2[at])  # tokens and types after a context
        self.c2 = _counted(bi_all[at])  # continuation counts: distinct contexts to the left
        self.n2, self.t2 = _counted(g.prev[at]), _counted(g.prev[np.unique(bi_all, return_index=True)[1]])
        uni = np.unique(bi_all, return_index=True)[1]
        self.c1, self.n1 = _counted(g.word[uni]), float(len(uni))
        self.t1 = float(len(self.c1.keys))

    def log_p(self, word: np.ndarray, prev: np.ndarray, prev2: np.ndarray) -> np.ndarray:
        d = DISCOUNT
        p = (self.shared.get(word) + 0.5) / (self.total + 0.5 * (len(self.shared.keys) + 1))
        if self.n1:
            p = (np.maximum(self.c1.get(word) - d, 0) + d * self.t1 * p) / self.n1
        for c, n, t, gram, context in ((self.c2, self.n2, self.t2, _mix(prev, word), prev), (self.c3, self.n3, self.t3, _mix(prev2, word), prev2)):
            seen = n.get(context)
            p = np.where(seen > 0, (np.maximum(c.get(gram) - d, 0) + d * t.get(context) * p) / np.maximum(seen, 1), p)
        return np.log(p)


@dataclass
class Model:
    toxic: KneserNey
    ordinary: KneserNey
    threshold: float = 0.0
    judged: bool = False  # whether there were enough documents for folds
    held_out: tuple | None = None  # (held-out score, label) of each fitted document
    seen: dict | None = None  # held-out score of each fitted document by its key

    def ratios(self, g: Grams, slots: int = 1 << 21) -> np.ndarray:
        """Log-likelihood ratio of each token. Trigrams already met are taken from a table of fixed size, in which a
        later trigram may replace an earlier one; the others are looked up in the models once each."""
        gram = _mix(g.prev2, g.word)
        keys, values = self.__dict__.setdefault("_met", (np.zeros(slots, np.int64), np.zeros(slots)))
        at = gram & (slots - 1)
        out, new = values[at], np.flatnonzero(keys[at] != gram)
        if len(new):
            _, first, inv = np.unique(gram[new], return_index=True, return_inverse=True)
            i = new[first]
            r = self.toxic.log_p(g.word[i], g.prev[i], g.prev2[i]) - self.ordinary.log_p(g.word[i], g.prev[i], g.prev2[i])
            out[new] = r[inv]
            slot = at[i]
            keys[slot], values[slot] = gram[i], r
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_met", "held_out")}

    def passages(self, g: Grams) -> tuple[np.ndarray, np.ndarray]:
        """(first token of each passage, its length-normalised score). A passage shorter than a few tokens is drawn
        towards 0 as if it had ``PRIOR_TOKENS`` more of ratio 0."""
        if not len(g.word):
            return np.zeros(0, int), np.zeros(0)
        start = np.flatnonzero(np.r_[True, g.passage[1:] != g.passage[:-1]])
        n = np.diff(np.r_[start, len(g.word)])
        return start, np.add.reduceat(self.ratios(g), start) / (n + PRIOR_TOKENS)


def _score_docs(model: Model, g: Grams, doc: np.ndarray, n_docs: int) -> np.ndarray:
    start, score = model.passages(g)
    out = np.full(n_docs, -np.inf)
    np.maximum.at(out, doc[start], score)
    return out


def _threshold(scores: np.ndarray, toxic: np.ndarray, slack: float = 0.9) -> float:
    """A cut in the middle of the widest gap between scores, among the cuts whose F1 is within ``slack`` of the best:
    reviewers err, so the labels alone leave a wide range of cuts nearly equal."""
    order = np.argsort(-scores, kind="stable")
    s, hit = scores[order], np.cumsum(toxic[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + max(1, toxic.sum()))
    gap = np.where(f1[:-1] >= slack * f1.max(), s[:-1] - s[1:], -1.0)
    if not len(gap) or gap.max() < 0:
        return float(s[int(np.argmax(f1))]) - 1e-9
    i = int(np.argmax(gap))
    return float((s[i] + s[i + 1]) / 2)


def fit(flat: list[np.ndarray], toxic: np.ndarray, folds: int = FOLDS, rounds: int = ROUNDS) -> Model:
    """Fit on documents given as arrays of token hashes, at least one of either class.

    Documents are split into folds, and a passage is only ever judged by models that have not seen its document, so
    that none is kept for being remembered. Each round sets the threshold with the highest F1 over the held-out
    documents; passages of toxic documents above it make the next toxic model, passages of clean documents above it
    (reviewers err) leave the ordinary one.
    """
    lengths = np.array([len(x) for x in flat], dtype=int)
    all_ = np.concatenate([*flat, np.zeros(0, np.int64)]).astype(np.int64)
    doc_of = np.repeat(np.arange(len(flat)), lengths)
    first = np.r_[True, doc_of[1:] != doc_of[:-1]] if len(doc_of) else np.zeros(0, bool)
    g, doc = Grams.of(all_, first), doc_of[all_ != _END]
    shared, total = _counted(g.word), float(len(g.word))
    fold = np.zeros(len(flat), int)
    for label in (True, False):
        at = np.flatnonzero(toxic == label)
        fold[at] = np.arange(len(at)) % folds
    bad = toxic[doc]
    kn = lambda mask: KneserNey(g.part(np.flatnonzero(mask)), shared, total)
    chosen, plain_ = bad, ~bad
    held = np.full(len(flat), -np.inf)
    threshold = 0.0
    if min(toxic.sum(), (~toxic).sum()) >= folds:
        outs = [np.flatnonzero(fold[doc] == k) for k in range(folds)]
        parts = [(g.part(out), doc[out]) for out in outs]
        for _ in range(rounds):
            held[:] = -np.inf
            judged = []
            for k, (part, d) in enumerate(parts):
                start, score = Model(kn(chosen & (fold[doc] != k)), kn(plain_ & (fold[doc] != k))).passages(part)
                np.maximum.at(held, d[start], score)
                judged.append((start, score))
            seen = np.isfinite(held)
            threshold = _threshold(held[seen], toxic[seen])
            over = np.zeros(len(doc), bool)
            for out, (start, score) in zip(outs, judged):
                over[out] = np.repeat(score > threshold, np.diff(np.r_[start, len(out)]) if len(start) else [])
            if not (over & bad).any():
                break
            chosen, plain_ = over & bad, ~over & ~bad
    return Model(kn(chosen), kn(plain_), threshold, np.isfinite(held).any(), held_out=(held, toxic))


def labels(reviews: DataFrame) -> DataFrame:
    """(doc_id, toxic) by the majority of the verdicts given; NULL verdicts don't count and ties give no label."""
    v = reviews.where(F.col("verdict").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.lower(F.trim("verdict")) != CLEAN).cast("int").alias("t"))
    return v.groupBy("doc_id").agg((2 * F.sum("t") - F.count("*")).alias("m")).where("m <> 0").select("doc_id", (F.col("m") > 0).alias("toxic"))


def train(docs: DataFrame, reviews: DataFrame, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS) -> Model:
    """Fit on at most so many reviewed documents of either class, taken by a hash of their id. Without a label of
    either class every score is 0 and no document is found."""
    lab = labels(reviews).withColumn("h", F.xxhash64("doc_id"))
    take = lab.where("toxic").orderBy("h").limit(toxic_docs).unionByName(lab.where("not toxic").orderBy("h").limit(clean_docs)).select("doc_id", "toxic")
    # the sample is bounded by its parameters, so it may be broadcast and collected
    rows = docs.select("doc_id", "text").join(F.broadcast(take), "doc_id").select("doc_id", "toxic", tokens(F.col("text")).alias("t")).toArrow()
    flat = [x.values.to_numpy(zero_copy_only=False).astype(np.int64) if x.is_valid and len(x.as_py()) else np.zeros(0, np.int64) for x in rows["t"]]
    toxic = np.array(rows["toxic"].to_pylist(), dtype=bool)
    if not len(toxic) or toxic.all() or not toxic.any():
        return Model(KneserNey(Grams.of(np.zeros(0, np.int64), np.zeros(0, bool)), Table(np.zeros(0, np.int64), np.zeros(0)), 0.0), KneserNey(Grams.of(np.zeros(0, np.int64), np.zeros(0, bool)), Table(np.zeros(0, np.int64), np.zeros(0)), 0.0), float("inf"))
    m = fit(flat, toxic)
    m.seen = {}
    if m.judged:
        for k, v in zip(rows["doc_id"].to_pylist(), m.held_out[0].tolist()):
            m.seen[k] = max(v, m.seen.get(k, -np.inf))
    return m


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", carry: list[str] = (), unseen_only: bool = False) -> DataFrame:
    """(key, carried columns, score, toxic) of every row: the score of its most toxic passage, -Infinity for a text without words
    (NULL, empty, blank). Whole texts are read, in one pass without a shuffle; repeated rows stay. A document that the
    model was fitted on has two scores, that of the model, which knows its review, and that of the fold that had not seen
    it, which a reviewer's error cannot sway; the higher counts. ``unseen_only`` takes the second alone, for measuring."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(model))  # bounded by the sample that was fitted
    schema = docs.select(key, *carry).schema.add("score", "double").add("toxic", "boolean")

    def run(batches):
        import pyarrow as pa

        m = cloudpickle.loads(shared.value)
        for b in (whole.slice(i, BATCH) for whole in batches for i in range(0, whole.num_rows, BATCH)):
            ts = b.column(b.num_columns - 1)
            flat = ts.values.to_numpy(zero_copy_only=False)
            off = ts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
            flat, off = flat[off[0] : off[-1]], off - off[0]
            doc_of = np.repeat(np.arange(len(ts)), np.diff(off))
            first = np.zeros(len(flat), bool)
            first[off[:-1][np.diff(off) > 0]] = True
            out = _score_docs(m, Grams.of(flat, first), doc_of[flat != _END], len(ts)) if len(flat) else np.full(len(ts), -np.inf)
            if m.seen:
                for i, k in enumerate(b.column(0).to_pylist()):
                    if k in m.seen:
                        out[i] = m.seen[k] if unseen_only else max(out[i], m.seen[k])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out), pa.array(out > m.threshold)], names=[key, *carry, "score", "toxic"])

    return docs.select(key, *carry, tokens(F.col(text)).alias("t")).mapInArrow(run, schema)
