"""Subject areas of documents (problem 10).

One linear classifier per subject on hashed word n-grams (characters of scripts
without spaces), applied to every sentence; a document gets the subjects of
enough of its sentences. Labels are weak: sentences take over the labels of their
document, documents with two labels share their sentences out, and a bounded
sample of unlabelled documents is labelled by the model itself where it is sure.
Thresholds are calibrated per subject on the labelled documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm import arrays as A
from foliomill.llm.common import sampled
from foliomill.llm.tokenize import _arrow_type

#: Most labelled and unlabelled documents that the classifiers are fitted on.
LABELLED = 3000
UNLABELLED = 2000
#: Characters used of a longer document, in fitting only.
FITTED_CHARS = 4000
BITS = 18
ROUNDS = 2
STEPS = 30
#: Share of sentences from which an unlabelled document is fitted on as if it had a label.
TAKEN = 0.3
#: A subject counts from this share of a document's sentences on, unless calibration moves it.
SHARE = 0.25

_MARKS = np.zeros(A.TABLE_SIZE, bool)
_MARKS[[ord(c) for c in ".!?…"]] = True
_WIDE_MARKS = np.zeros(A.TABLE_SIZE, bool)
_WIDE_MARKS[[ord(c) for c in "。！？"]] = True


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all sentences: feature, its sentence; and of each sentence its text and weight
    (letters, those of scripts without spaces counting three)."""
    batch = A.TextBatch([A.plain(t) for t in texts])
    codes, classes = batch.lower, batch.classes
    n = len(codes)
    following = np.concatenate([classes[1:], [A.SPACE]])
    second = np.concatenate([batch.codes[2:], [10, 10]])
    upper = lower_unlike(second)
    ends = (batch.raw == 10) | _WIDE_MARKS[batch.codes] | (_MARKS[batch.codes] & (following == A.SPACE) & upper)
    sentence = np.concatenate([[0], np.cumsum(ends)[:-1]])
    n_sentences = int(sentence[-1]) + 1
    owner = np.zeros(n_sentences, np.int64)
    owner[sentence] = np.searchsorted(batch.ends, np.arange(n))
    wide = (classes == A.HAN) | (classes == A.KANA)
    letters = ((classes == A.LATIN) | (classes == A.CYRILLIC) | (classes == A.GREEK) | (classes == A.LETTER) | (classes == A.MARK))
    starts, stops = A.runs(letters)
    words = A.span_hashes(codes, starts, stops)
    of_word = sentence[starts] if len(starts) else np.zeros(0, np.int64)
    found, of = [words], [of_word]
    with np.errstate(over="ignore"):
        if len(words) > 1:
            same = of_word[1:] == of_word[:-1]
            found.append(A.mix(words[:-1] * np.uint64(3) + words[1:])[same])
            of.append(of_word[1:][same])
        at = np.flatnonzero(wide)
        if len(at) > 1:
            c = codes.astype(np.uint64)
            pair = at[:-1][np.diff(at) == 1]
            two = A.mix((c[pair] << np.uint64(20)) + c[pair + 1] + np.uint64(1 << 50))
            found.append(two)
            of.append(sentence[pair])
            triple = pair[:-1][np.diff(pair) == 1] if len(pair) > 1 else pair[:0]
            found.append(A.mix((c[triple] << np.uint64(40)) + (c[triple + 1] << np.uint64(20)) + c[triple + 2] + np.uint64(1 << 61)))
            of.append(sentence[triple])
    weight = np.bincount(sentence, weights=letters + 3.0 * wide, minlength=n_sentences)
    return (np.concatenate(found) & np.uint64((1 << BITS) - 1)).astype(np.int64), np.concatenate(of), owner, weight


_LOWER_CASE: list[np.ndarray] = []


def lower_unlike(codes: np.ndarray) -> np.ndarray:
    """Whether a code point is not a lower-case letter."""
    if not _LOWER_CASE:
        t = np.ones(A.TABLE_SIZE, bool)
        for c in range(0x2000):
            if chr(c).islower():
                t[c] = False
        _LOWER_CASE.append(t)
    return _LOWER_CASE[0][codes]


def _scores(feature: np.ndarray, of: np.ndarray, n: int, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Summed weights of each sentence, divided by the root of its number of n-grams."""
    if not len(feature):
        return np.broadcast_to(bias, (n, len(bias))).copy()
    order = np.argsort(of, kind="stable")
    f, o = feature[order], of[order]
    first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
    out = np.zeros((n, len(bias)), np.float32)
    out[o[first]] = np.add.reduceat(weights[f], first, axis=0) / np.sqrt(np.diff(np.concatenate([first, [len(o)]])))[:, None]
    return out + bias


def train(texts: list[str], labels: list[list[int]], k: int, more: list[str] = ()) -> dict:
    """Weights, bias and share thresholds for k subjects. ``labels`` holds the subjects of each text."""
    n_labelled = len(texts)
    texts = [t[:FITTED_CHARS] for t in [*texts, *more]]
    feature, of, owner, weight = features(texts) if texts else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int64), np.zeros(0))
    n = len(owner)
    allowed = np.zeros((len(texts), k), bool)
    for i, ys in enumerate(labels):
        allowed[i, ys] = True
    target = (allowed[owner] / np.maximum(1, allowed[owner].sum(1, keepdims=True))).astype(np.float32)
    use = (owner < n_labelled) & (weight >= 12)
    weights, bias = np.zeros((1 << BITS, k), np.float32), np.full(k, -2.0, np.float32)
    known, index = np.unique(feature, return_inverse=True)
    for turn in range(ROUNDS):
        weights[known], bias = _fit(index, of, n, len(known), target, use, k)
        p = 1 / (1 + np.exp(-np.clip(_scores(feature, of, n, weights, bias), -30, 30)))
        sure, best = p.max(1), p.argmax(1)
        first_time = ~allowed[owner].any(1)
        # an unlabelled document takes the subjects that enough of its sentences show, and hands them down like a labelled one
        shown = _shares(p, owner, weight, len(texts)) >= TAKEN
        shown[:n_labelled] = False
        allowed = allowed | shown
        has = allowed[owner].any(1)
        within = np.where(allowed[owner], p, 0)
        strength = within.max(1)
        target = np.zeros((n, k), np.float32)
        target[np.arange(n), within.argmax(1)] = has & (strength >= 0.5)
        handed = has & first_time & (strength < 0.5)
        target[handed] = (allowed[owner] / np.maximum(1, allowed[owner].sum(1, keepdims=True)))[handed]
        # a sentence that says another subject aloud is taken at its word
        aloud = has & (sure > 0.9) & (strength < 0.3)
        target[aloud] = 0
        target[aloud, best[aloud]] = 1
        use = (weight >= 12) & has & ((strength >= 0.5) | (sure < 0.2) | handed | aloud)
        if turn == ROUNDS - 1:
            break
    share = _shares(p, owner, weight, len(texts))[:n_labelled]
    cut = np.array([_calibrated(share[:, s], allowed[:n_labelled, s]) for s in range(k)])
    return {"weights": weights.astype(np.float16), "bias": bias, "share": cut}


def _fit(index: np.ndarray, of: np.ndarray, n: int, m: int, target: np.ndarray, use: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """One-versus-rest logistic regression: full-batch Adagrad on the n-grams of the sentences in use."""
    keep = use[of]
    f, o = index[keep], of[keep]
    order = np.argsort(o, kind="stable")
    f, o = f[order], o[order]
    weights, bias = np.zeros((m, k), np.float32), np.full(k, -2.0, np.float32)
    if not len(f):
        return weights, bias
    first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
    scale = (1 / np.sqrt(np.diff(np.concatenate([first, [len(o)]])))).astype(np.float32)
    row = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(o)]])))
    y = target[o[first]]
    by_feature = np.argsort(f, kind="stable")
    ff = f[by_feature]
    start = np.flatnonzero(np.concatenate([[True], ff[1:] != ff[:-1]]))
    squares, bias_squares = np.full((m, k), 1e-3, np.float32), np.full(k, 1e-3, np.float32)
    for _ in range(STEPS):
        z = np.add.reduceat(weights[f], first, axis=0) * scale[:, None] + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y).astype(np.float32)
        g = np.zeros((m, k), np.float32)
        g[ff[start]] = np.add.reduceat((error * scale[:, None])[row[by_feature]], start, axis=0)
        g += 0.02 * weights
        squares += g * g
        weights -= 0.5 * g / np.sqrt(squares)
        gb = error.sum(0)
        bias_squares += gb * gb
        bias -= 0.3 * gb / np.sqrt(bias_squares)
    return weights, bias


def _shares(p: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Of each text, the share of its sentences that deal with each subject; scraps without a subject don't count."""
    hit = p >= 0.5
    counted = (hit.any(1) & (weight >= 6)) | (weight >= 25)
    total = np.bincount(owner, weights=counted, minlength=n)
    by = np.stack([np.bincount(owner, weights=hit[:, s] & counted, minlength=n) for s in range(p.shape[1])], 1)
    return by / np.maximum(total, 1)[:, None]


def _calibrated(share: np.ndarray, truth: np.ndarray) -> float:
    """The cut near SHARE with the best F1 on the labelled documents; SHARE itself where that is as good."""
    best, at = -1.0, SHARE
    for cut in sorted(np.arange(0.18, 0.3001, 0.01), key=lambda c: abs(c - SHARE)):
        said = share >= cut - 1e-9
        f1 = 2 * (said & truth).sum() / max(1, said.sum() + truth.sum())
        if f1 > best + 0.01:
            best, at = f1, float(cut)
    return at


def classify(texts: list[str], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each text by subject, and which of them count."""
    feature, of, owner, weight = features(texts)
    z = _scores(feature, of, len(owner), model["weights"].astype(np.float32, copy=False), model["bias"])
    share = _shares(1 / (1 + np.exp(-np.clip(z, -30, 30))), owner, weight, len(texts))
    return share, (share >= model["share"] - 1e-9) & (share > 0)


def learn(documents: DataFrame, labels: DataFrame, names: list[str], key: str = "doc_id", text: str = "text") -> dict:
    """Classifiers fitted on at most LABELLED labelled and UNLABELLED other documents (two bounded collects)."""
    docs = documents.select(F.col(key).alias("k"), F.substring(text, 1, FITTED_CHARS).alias("t")).where(F.length(F.trim("t")) > 0)
    marks = labels.select(F.col(key).alias("k"), "subject").where(F.col("subject").isin(names)).groupBy("k").agg(F.array_sort(F.collect_set("subject")).alias("s"))
    # sampled before the join: the labels are the small side whatever the corpus holds
    some = sampled(marks, "k", LABELLED)
    rows = docs.join(some, "k").select("k", "t", "s").collect()
    rows.sort(key=lambda r: (str(r.k), r.t))
    others = sampled(docs, "k", UNLABELLED).select("t").collect()
    at = {s: i for i, s in enumerate(names)}
    return train([r.t for r in rows], [[at[s] for s in r.s] for r in rows], len(names), [r.t for r in others])


def assign(documents: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, subject, share``: the subjects of each document, with the share of its sentences.

    Null, blank and subjectless texts give no rows, so do all texts where there are no labels at all.
    Repeated rows give repeated results. One pass over the documents after fitting, no shuffle.
    """
    names = sorted(r.subject for r in subjects.select("subject").where("subject is not null").distinct().collect())
    kind = documents.schema[key].dataType
    key_type = _arrow_type(kind)
    model = documents.sparkSession.sparkContext.broadcast(learn(documents, labels, names, key, text) if names else None)
    inflated: list = []

    def run(columns: dict) -> pa.RecordBatch | None:
        if not names:
            return None
        if not inflated:
            inflated.append(model.value | {"weights": model.value["weights"].astype(np.float32)})
        share, count = classify([t or "" for t in columns["text"]], inflated[0])
        row, subject = np.nonzero(count)
        return pa.RecordBatch.from_arrays([
            pa.array([columns["key"][i] for i in row], key_type), pa.array([names[s] for s in subject], pa.string()), pa.array(share[row, subject], pa.float64()),
        ], names=["key", "subject", "share"])

    return documents.select(documents[key].alias("key"), documents[text].alias("text")).mapInArrow(
        A.map_arrow(run), f"key {kind.simpleString()}, subject string, share double").withColumnRenamed("key", key)
