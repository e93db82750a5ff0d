"""Abusive, hateful or sexual content (problem 8).

Method: gradient-boosted trees over dense features with isotonic calibration. The unit is the sentence (see
``sentences``): densities of word lists per kind outside and inside quotations, the same for a learned list, second and
first person and their distance to the nearest hit, capitals, punctuation, length, and the rate of disguised places
(invisible characters, look-alike letters, spaced or dotted letters, digits for letters, masked words). Disguises are
undone before words are looked up. A document's score is that of its strongest sentence, calibrated.

Training: raters label documents, not sentences, and err. Of a bounded sample of labelled documents (``MAX_LABELLED``,
by hash of the id) each document's label is the share of its raters' latest votes; documents of a bad label give their
strongest sentence as positive (chosen by the lists first, then by the first trees), those of a good label give their
strongest sentences and some others as negatives. The learned list (log odds of words, pairs of words, and
character pairs and triples of scripts without spaces) is computed out of fold for training, and calibration sees
only documents that neither list nor trees have seen. Scoring covers every sentence of every document.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm import lexicon as L
from treeline.llm.boost import Trees, isotonic
from treeline.llm.boundaries import HEAD, LIST, SPEAKER, guarded
from treeline.llm.sentences import Model, is_chat, load_model, share_model, split, train
from treeline.plans.session import settled

MAX_LABELLED = 6_000
THRESHOLD = 0.5
FOLDS = 4

_TESTS = {
    "insult": L.matcher(L.INSULTS), "group": L.matcher(L.GROUPS), "inhuman": L.matcher(L.DEHUMANISING),
    "sexual": L.matcher(L.SEXUAL), "threat": L.matcher(L.THREATS), "second": L.matcher(L.SECOND), "first": L.matcher(L.FIRST),
}
_KINDS = ("insult", "group", "inhuman", "sexual", "threat")
_SAID = re.compile("[“”„«»「」『』\"（）()《》]")
_DIGIT = re.compile(r"\d")


@lru_cache(maxsize=200_000)
def _kinds(word: str) -> tuple[str, ...]:
    return tuple(k for k, test in _TESTS.items() if test(word))


def analyse(sentence: str) -> tuple[list[str], list[float]]:
    """Tokens for the learned list (those inside quotations marked with a leading ') and the dense features."""
    flat, hidden = L.plain(sentence)
    joined, inner = L.inner_marks(flat)
    closes = guarded(joined)[1] if _SAID.search(joined) else {}
    zones = sorted((o, c) for c, o in closes.items() if joined[o] not in "(（[【")
    tokens: list[str] = []
    counts = dict.fromkeys([*_TESTS, *(f"q_{k}" for k in _KINDS)], 0)
    hits, persons, n, upper, quoted_words = [], [], 0, 0, 0
    last = ""
    z = 0
    spaceless = L.SPACELESS_CHAR.search(joined) is not None
    for m in L._WORD.finditer(joined):
        w = m.group()
        while z < len(zones) and zones[z][1] < m.start():
            z += 1
        inside = z < len(zones) and zones[z][0] < m.start() < zones[z][1]
        low = w.lower()
        if not low.isalpha() and _DIGIT.search(low):
            low = "0"
        n += 1
        quoted_words += inside
        upper += len(w) > 2 and w.isupper()
        tag = "'" if inside else ""
        if spaceless and L.SPACELESS_CHAR.search(w):
            tokens += [tag + w[i : i + k] for k in (2, 3) for i in range(len(w) - k + 1)]
            last = ""
        else:
            tokens.append(tag + low)
            if last:
                tokens.append(tag + last + " " + low)
            last = low
        for k in _kinds(low):
            if inside and k in _KINDS:
                counts["q_" + k] += 1
            else:
                counts[k] += 1
                if k == "second":
                    persons.append(n)
                elif k in _KINDS:
                    hits.append(n)
    if spaceless:
        outside = "".join(c for i, c in enumerate(joined) if not any(a < i < b for a, b in zones)) if zones else joined
        for k, entries in L.SPACELESS.items():
            c = sum(outside.count(e) for e in entries)
            counts["inhuman" if k == "group" else k] += c
            if c and k != "second":
                hits.append(1)
            elif c:
                persons.append(1)
    near = min((abs(a - b) for a in hits for b in persons), default=50)
    size = max(n, len(joined) / 6, 1)
    letters = sum(map(str.isalpha, joined)) or 1
    capitals = sum(map(str.isupper, joined)) if joined != joined.lower() else 0
    mixed = sum(1 for a, b in zip(joined, joined[1:]) if a.islower() and b.isupper()) if capitals > 1 or not joined[:1].isupper() and capitals else 0
    digits = sum(map(str.isdigit, joined)) if _DIGIT.search(joined) else 0
    found = sum(counts[k] for k in _KINDS)
    dense = [
        *[float(counts[k]) for k in counts], found / size, found / size * (near < 6), 1.0 / (1 + near), float(hidden), float(inner), hidden / size,
        float(upper), capitals / letters, float(mixed), float(joined.count("!")), float(joined.count("?")), float(size),
        quoted_words / size, float(sentence.count("\U0001f595")), float("maskedword" in joined), digits / len(joined or " "),
    ]
    return tokens, dense


def learned_features(w: np.ndarray, owner: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Features of the learned list for many sentences: ``w`` has the non-zero log odds of their tokens, ``owner`` the sentence
    of each, ``lengths`` the number of tokens of every sentence."""
    n, up = len(lengths), w > 0
    minus = np.bincount(owner[~up], w[~up], n)
    w, owner = w[up], owner[up]
    order = np.lexsort((-w, owner))
    w, owner = w[order], owner[order]
    rank = np.arange(len(w)) - np.searchsorted(owner, owner)
    total = np.bincount(owner, w, n)
    best, four = np.bincount(owner[rank == 0], w[rank == 0], n), np.bincount(owner[rank < 4], w[rank < 4], n)
    return np.column_stack([total, best, four, minus, (total + minus) / np.maximum(lengths, 1), np.bincount(owner, minlength=n)])


def log_odds(bad: np.ndarray, ok: np.ndarray, n_bad: float, n_ok: float) -> np.ndarray:
    """Smoothed log odds per token from document frequencies; 0 where it isn't clear."""
    rate = min(max(n_bad / max(n_bad + n_ok, 1e-9), 0.05), 0.95)
    w = np.log((bad + rate) / (n_bad + 1)) - np.log((ok + 1 - rate) / (n_ok + 1))
    w[(bad + ok < 2) | (np.abs(w) <= 0.7)] = 0
    return w


def votes(labels: DataFrame) -> DataFrame:
    """Share of bad votes per document: (doc_id, share, raters). A rater's latest label counts; null labels and
    ids are none; letter case and blanks do not matter; copies count once."""
    clean = labels.select("doc_id", "rater", F.lower(F.trim("label")).alias("label"), "labelled_at").where(
        "doc_id is not null and label is not null and label <> ''"
    )
    last = clean.groupBy("doc_id", "rater").agg(F.max(F.struct("labelled_at", "label")).alias("r"))
    return last.groupBy("doc_id").agg(
        F.avg((F.col("r.label") != "ok").cast("double")).alias("share"), F.count(F.lit(1)).alias("raters")
    )


def labelled_sample(docs: DataFrame, labels: DataFrame) -> pd.DataFrame:
    """At most MAX_LABELLED labelled documents, chosen by hash of the id."""
    voted = votes(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    return docs.select("doc_id", "text", "source_type").where("text is not null and text <> ''").join(F.broadcast(voted), "doc_id").toPandas()


class Scorer:
    """Sentence scores: learned list, trees, calibration knots."""

    def __init__(self, weights: dict[str, float], trees: Trees | None, knots: tuple[np.ndarray, np.ndarray]) -> None:
        self.weights, self.trees, self.knots = weights, trees, knots

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, *self.knots)

    def raw(self, sentences: list[tuple[list[str], list[float]]]) -> np.ndarray:
        if not sentences:
            return np.zeros(0)
        get = self.weights.get
        found = [[w for w in map(get, tokens) if w] for tokens, _ in sentences]
        sizes = np.array([len(w) for w in found])
        flat = np.fromiter((w for own in found for w in own), float, int(sizes.sum()))
        learned = learned_features(flat, np.repeat(np.arange(len(found)), sizes), np.array([len(t) for t, _ in sentences]))
        x = np.column_stack([np.array([d for _, d in sentences]), learned])
        return self.trees.predict(x) if self.trees else x[:, 0] + x[:, 2] + x[:, 3] + x[:, 4] - 2.0


def passages(text: str, chat: bool, model: Model) -> list[tuple[int, int, str]]:
    """Sentences with their text without the speaker's, heading or list mark."""
    out = []
    for s, e in split(text, chat, model):
        part = text[s:e]
        mark = SPEAKER.match(part) if chat else HEAD.match(part) or LIST.match(part)
        out.append((s, e, part[mark.end() :] if mark else part))
    return out


class _Bag:
    """Unique sentences of the labelled documents as flat arrays: tokens, dense features, sentences of each document."""

    def __init__(self, sample: pd.DataFrame, model: Model) -> None:
        vocabulary: dict[str, int] = {}
        known: dict[str, int] = {}
        tokens: list[np.ndarray] = []
        dense: list[list[float]] = []
        self.docs: list[np.ndarray] = []
        for text, kind in zip(sample.text, sample.source_type):
            own = []
            for *_, key in passages(text, is_chat(kind), model) or [(0, 0, "")]:
                if key not in known:
                    known[key] = len(dense)
                    words, features = analyse(key)
                    tokens.append(np.array([vocabulary.setdefault(t, len(vocabulary)) for t in words], np.int32))
                    dense.append(features)
                own.append(known[key])
            self.docs.append(np.array(sorted(set(own))))
        self.dense = np.array(dense)
        self.vocabulary = vocabulary
        self.flat = np.concatenate([*tokens, np.zeros(0, np.int32)])
        self.owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        self.bags = [np.unique(np.concatenate([tokens[k] for k in own])) for own in self.docs]

    def log_odds(self, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
        counts = [np.zeros(len(self.vocabulary)), np.zeros(len(self.vocabulary))]
        for i in rows:
            counts[int(y[i])][self.bags[i]] += 1
        return log_odds(counts[1], counts[0], float(y[rows].sum()), float(len(rows) - y[rows].sum()))

    def features(self, weights: np.ndarray) -> np.ndarray:
        """Dense and learned features of all sentences."""
        at = np.flatnonzero(weights[self.flat])
        lengths = np.bincount(self.owner, minlength=len(self.dense))
        return np.column_stack([self.dense, learned_features(weights[self.flat[at]], self.owner[at], lengths)])


def fit(sample: pd.DataFrame, model: Model) -> Scorer:
    """Scorer from labelled documents (doc_id, text, source_type, share, raters).

    Calibration is nested: for each fold everything (learned list, choice of the sentence that earned the label, trees) is
    fitted again on the other folds alone, so the knots rest on scores of documents that nothing has seen.
    """
    if sample.empty or sample.share.max() <= 0.5 or sample.share.min() > 0.5:
        return Scorer({}, None, (np.array([-2.0, 2.0]), np.array([0.0, 1.0])))
    sample = sample.sort_values("doc_id").reset_index(drop=True)
    y = (sample.share > 0.5).to_numpy(float)
    sure = (np.abs(2 * sample.share - 1) * np.minimum(sample.raters, 3) / 3 + 0.05).to_numpy()
    fold = np.array([xxhash.xxh64_intdigest(str(i)) % FOLDS for i in sample.doc_id])
    bag = _Bag(sample, model)

    def fitted(allowed: np.ndarray) -> tuple[Trees, np.ndarray]:
        """Trees and learned list from the ``allowed`` documents only."""
        feats = {}
        for f in np.unique(fold[allowed]):  # a document's own label is in no list its features are computed with
            x = bag.features(bag.log_odds(allowed[fold[allowed] != f], y))
            feats.update((i, x[bag.docs[i]]) for i in allowed[fold[allowed] == f])
        # first choice of the sentence that earned the label: the learned list, then the word lists and disguises
        strength = {i: x[:, -4] + 2.0 * np.minimum(x[:, 0] + x[:, 2] + x[:, 3] + x[:, 4], 2) + np.minimum(x[:, 15], 2) for i, x in feats.items()}

        def grown() -> Trees:
            rows, target, weight = [], [], []
            for i in allowed:
                x, order = feats[i], np.argsort(-strength[i], kind="stable")
                take = order[:1] if y[i] else np.concatenate([order[:3], order[3::17]])
                rows.append(x[take])
                target.append(np.full(len(take), y[i]))
                weight.append(np.full(len(take), sure[i]))
            return Trees().fit(np.concatenate(rows), np.concatenate(target), np.concatenate(weight))

        for _ in range(2):
            trees = grown()
            ends = np.cumsum([len(feats[i]) for i in allowed])[:-1]
            strength = dict(zip(allowed, np.split(trees.predict(np.concatenate([feats[i] for i in allowed])), ends)))
        return grown(), bag.log_odds(allowed, y)

    every = np.arange(len(y))
    top = np.zeros(len(y))
    for f in np.unique(fold):
        held, rest = every[fold == f], every[fold != f]
        if not len(rest) or y[rest].min() == y[rest].max():  # nothing to learn from: the lists alone
            top[held] = [(bag.dense[bag.docs[i]][:, [0, 2, 3, 4]].sum(1) - 2.0).max() for i in held]
            continue
        trees, weights = fitted(rest)
        x = bag.features(weights)
        top[held] = [trees.predict(x[bag.docs[i]]).max() for i in held]
    trees, final = fitted(every)
    return Scorer({t: float(final[k]) for t, k in bag.vocabulary.items() if final[k]}, trees, isotonic(top, y, sure))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every document: doc_id, source, score (0..1), flagged (score >= THRESHOLD), and the strongest sentence's
    start_offset and end_offset (null without sentences). Null and empty texts score 0. Without usable labels the word
    lists alone decide."""
    texts = settled(docs.select("doc_id", "text", "source_type"), "doc_id")
    model = train(texts)
    scorer = fit(labelled_sample(docs, labels), model)
    spark = docs.sparkSession
    shared, packed = share_model(spark, model), spark.sparkContext.broadcast(zlib.compress(pickle.dumps(scorer)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, sc = load_model(shared), pickle.loads(zlib.decompress(packed.value))
        known: dict[str, float] = {}
        for pdf in batches:
            if len(known) > 100_000:
                known = {}
            spans, fresh = [], {}
            for text, kind in zip(pdf["text"], pdf["source_type"]):
                own = passages(text, is_chat(kind), m) if text else []
                fresh.update((key, None) for *_, key in own if key not in known)
                spans.append(own)
            keys = list(fresh)
            for a in range(0, len(keys), 5_000):
                part = keys[a : a + 5_000]
                known.update(zip(part, sc.raw([analyse(k) for k in part]).tolist()))
            rows = []
            for doc, own in zip(pdf["doc_id"], spans):
                if own:
                    s, e, key = max(own, key=lambda x: known[x[2]])
                    rows.append((doc, float(sc.calibrated(known[key])), s, e))
                else:
                    rows.append((doc, 0.0, None, None))
            out = pd.DataFrame(rows, columns=["doc_id", "score", "start_offset", "end_offset"])
            yield out.astype({"start_offset": "Int64", "end_offset": "Int64"})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = texts.mapInPandas(run, f"doc_id {id_type}, score double, start_offset long, end_offset long")
    return scored.withColumn("flagged", F.col("score") >= THRESHOLD)


def source_name(x: Column) -> Column:
    """Sources spelled in other ways are one: trimmed, lower case, with underscores; null stays null."""
    return F.regexp_replace(F.lower(F.trim(x)), "[-\\s]+", "_")


def source_rates(docs: DataFrame, scored: DataFrame) -> DataFrame:
    """Per source: documents, flagged documents, their rate and the mean score."""
    named = docs.select("doc_id", source_name(F.col("source")).alias("source")).join(scored, "doc_id")
    return named.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("flagged").cast("long")).alias("n_flagged"),
        F.avg(F.col("flagged").cast("double")).alias("rate"), F.avg("score").alias("mean_score"),
    )
