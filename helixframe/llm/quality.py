"""Quality classifier: weak labellers, expectation-maximisation of their accuracies, and a hashed linear scorer.

Two aspects are judged: *junk* (repetition, tables of fragments, symbol noise, shouting) and *toxic* (insults).  For each,
overlapping heuristic labellers vote good, bad or abstain on every document; the toxic ones abstain where they find no insult, since
the list is English and short.  A table of gold labels, where given, anchors the documents it names: their P(bad) stays at 0.99 or 0.01.
It also teaches two toxic labellers the words of each language (column ``lang``, if there is one) that stand in toxic documents and
hardly in clean ones, on at most about ``LEXICON_ROWS`` gold documents of either class; a gold document itself is voted on with the
words of the other half of the gold documents, so that EM doesn't overrate these labellers.
EM runs on the counts of vote patterns over all documents (at most 3^labellers
rows, whatever the corpus), and estimates each labeller's outcome rates given the true class.  The posterior labels of a sample
of at most ``train_rows`` documents (those with the smallest hashes of id and text) and at most TRAIN_FEATURES features of each train a linear scorer by FTRL with L1
regularisation over hashed features: each distinct lower-cased word, and each statistic's bin.  Both bounds hold for the fit alone.  The scorer then reads every
whole document.  A document is rejected if either score is 0.5 or more.

A language needs about five toxic gold documents with a word in common (of some 10 % toxic ones) before that word is learned.

The texts are read once for the votes and the sample's features, which are written, and once for the scores; gold documents once more for their words.

Edge cases: null and empty texts have no words, get no vote and only the scorer's bias and bins; rows that repeat an id and text
vote as often as they occur; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import Words, chunks, ids_of, mix, row_chunks, written

ASPECTS = ("junk", "toxic")
#: Common English insults, the lexicon of two labellers.
INSULTS = (
    "bastard", "clown", "coward", "creep", "cretin", "disgusting", "dumb", "fool", "garbage", "idiot", "imbecile", "jerk", "liar",
    "loser", "moron", "pathetic", "pig", "scum", "stupid", "trash", "ugly", "vermin", "worthless",
)
BITS = 18
#: Documents that train the scorer, and features of one of them, at most.
TRAIN_ROWS, TRAIN_FEATURES = 12_000, 2_048
#: Gold documents of either class, and words, that the learned labellers use at most.
LEXICON_ROWS, LEXICON_WORDS = 10_000, 20_000
#: A learned word's evidence (log-likelihood ratio against the language's toxic share) and share of toxic documents.
_EVIDENCE, _PRECISION = 11.5, 0.8
_SURE = 0.99
#: Bin edges of the statistics, in the order of _STATS.
_STATS = ("symbols", "repeats", "upper", "distinct", "bars", "length")
_EDGES = {
    "symbols": (0.02, 0.05, 0.1, 0.2), "repeats": (0.02, 0.1, 0.3, 0.6), "upper": (0.1, 0.3, 0.6), "distinct": (0.1, 0.25, 0.4),
    "bars": (0.02, 0.1, 0.3), "length": (1, 5, 30, 100, 1000),
}

_ALNUM = np.zeros(256, np.uint8)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = 1
_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 1
_LETTER = np.zeros(256, np.uint8)
_LETTER[65:91] = _LETTER[97:123] = 1
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[[ord(c) for c in "#$%&*+<=>@[\\]^_`{|}~"]] = 1
_BAR = np.zeros(256, np.uint8)
_BAR[ord("|")] = 1


def _insult_hashes() -> np.ndarray:
    return np.sort(Words(pa.array(INSULTS), lower=True, inside=_ALNUM).hashes())


def _per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


class Features:
    """Words and statistics of a run of texts."""

    def __init__(self, texts: pa.Array):
        self.words = w = Words(texts, lower=True, inside=_ALNUM)
        self.hash = w.hashes()
        n = w.counts()
        doc = w.doc_of()
        some = np.maximum(n, 1)
        size = np.maximum(np.diff(w.off), 1)
        same = np.concatenate([[False], (self.hash[1:] == self.hash[:-1]) & (doc[1:] == doc[:-1])]) if len(doc) else np.zeros(0, bool)
        firsts = _distinct(doc, self.hash, len(n))
        self.n = n
        self.stats = {
            "symbols": _per_doc(_SYMBOL[w.data], w.off) / size,
            "repeats": np.bincount(doc[same], minlength=len(n)) / some,
            "upper": _per_doc(_UPPER[w.data], w.off) / np.maximum(_per_doc(_LETTER[w.data], w.off), 1),
            "distinct": np.where(n > 0, firsts / some, 1.0) * np.where(n >= 50, 1.0, np.inf),
            "bars": _per_doc(_BAR[w.data], w.off) / some,
            "length": n.astype(float),
        }

    def insults(self) -> np.ndarray:
        return np.bincount(self.words.doc_of()[np.isin(self.hash, _insult_hashes())], minlength=len(self.n))

    def keys(self, langs: pa.Array) -> np.ndarray:
        """Each word's hash, mixed with its text's language."""
        names = langs.cast(pa.string()).fill_null("").dictionary_encode()
        salt = np.array([xxhash.xxh3_64_intdigest(x) for x in names.dictionary.to_pylist()], np.uint64)
        return self.hash + salt[names.indices.to_numpy()][self.words.doc_of()]

    def learned(self, keys: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
        """How many of each text's words are in the sorted lexicon."""
        may = np.zeros(1 << 16, bool)
        may[lexicon >> np.uint64(48)] = True
        at = np.flatnonzero(may[keys >> np.uint64(48)])
        return np.bincount(self.words.doc_of()[at[np.isin(keys[at], lexicon)]], minlength=len(self.n))

    def bins(self) -> np.ndarray:
        """A hashed feature for each statistic's bin: one row for each document."""
        out = [np.searchsorted(_EDGES[s], self.stats[s], "right") + 16 * k for k, s in enumerate(_STATS)]
        return (mix(np.stack(out, 1).astype(np.uint64) + np.uint64(1 << 40)) >> np.uint64(64 - BITS)).astype(np.int64)

    def hashed(self) -> np.ndarray:
        return (self.hash >> np.uint64(64 - BITS)).astype(np.int64)


def _distinct(doc: np.ndarray, h: np.ndarray, docs: int) -> np.ndarray:
    """Distinct words of each document."""
    bounds = np.searchsorted(doc, np.arange(docs + 1))
    return np.array([len(np.unique(h[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.int64)


def _vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    """2: bad, 1: good, 0: abstains."""
    return np.where(bad, 2, np.where(good, 1, 0))


def votes(f: Features, learned: np.ndarray) -> dict[str, list[np.ndarray]]:
    """The heuristic labellers' votes; ``learned`` counts each text's words that the gold labels taught."""
    s, some = f.stats, f.n > 0
    hits, never = f.insults(), np.zeros(len(f.n), bool)
    return {
        "junk": [
            _vote(some & (s["symbols"] > 0.08), some & (s["symbols"] < 0.02)),
            _vote(some & (s["repeats"] > 0.25), some & (s["repeats"] < 0.1)),
            _vote(some & (s["bars"] > 0.2), some & (s["bars"] < 0.05)),
            _vote(some & (s["upper"] > 0.5), some & (s["upper"] < 0.3)),
            _vote(some & (s["distinct"] < 0.2), some & np.isfinite(s["distinct"]) & (s["distinct"] > 0.35)),
        ],
        "toxic": [_vote(x, never) for x in (hits >= 1, hits >= 2, hits > 0.004 * f.n, learned >= 1, learned >= 2)],
    }


HEURISTICS = {"junk": 5, "toxic": 5}


def _lang(df: DataFrame) -> Column:
    return (F.col("lang").cast("string") if "lang" in df.columns else F.lit("")).alias("lang")


def _half(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.view(np.uint64)) & np.uint64(1)).astype(np.int64)


def learn_words(df: DataFrame, sure: DataFrame, rows: int = LEXICON_ROWS) -> list[np.ndarray]:
    """Sorted keys of the words that mark toxic documents: by the gold documents of half 0, of half 1, and by all.

    ``sure`` has doc_id and gold_toxic.
    """
    known = {r[0]: r[1] for r in sure.where("gold_toxic IN (0, 1)").groupBy("gold_toxic").count().collect()}
    if not known.get(1) or not known.get(0):
        return [np.zeros(0, np.uint64)] * 3
    share = [min(1.0, rows / known[c]) for c in (0, 1)]
    most = F.when(F.col("gold_toxic") == 1, _up_to(share[1])).when(F.col("gold_toxic") == 0, _up_to(share[0]))
    some = sure.where(F.xxhash64(F.lit(43), F.col("doc_id")) <= most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b):
                f = Features(c.column("text"))
                keys, doc = f.keys(c.column("lang")), f.words.doc_of()
                first = np.unique(np.stack([doc.astype(np.uint64), keys]), axis=1)
                of = first[0].astype(np.int64)
                cell = _half(ids_of(c.column("doc_id"))) * 2 + c.column("gold_toxic").to_numpy()
                langs = c.column("lang").take(pa.array(np.concatenate([of, np.arange(len(f.n))])))
                # a null key stands for the document itself
                key = pa.array(np.concatenate([first[1].view(np.int64), np.zeros(len(f.n), np.int64)]), mask=np.arange(len(of) + len(f.n)) >= len(of))
                yield pa.RecordBatch.from_arrays([langs, key, pa.array(cell[np.concatenate([of, np.arange(len(f.n))])])], ["lang", "key", "cell"])

    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _lang(df)).join(F.broadcast(some.select("doc_id", F.col("gold_toxic").cast("long").alias("gold_toxic"))), "doc_id")
    cells = [F.count_if(F.col("cell") == k).alias(f"c{k}") for k in range(4)]  # half * 2 + toxic
    count = docs.mapInArrow(run, "lang string, key long, cell long").groupBy("lang", "key").agg(*cells).where("key IS NULL OR (c1 + c3 >= 3)")
    ratio = share[1] / share[0]
    toxic = F.col("c1") + F.col("c3")
    count = count.where(F.col("key").isNull() | (toxic >= _PRECISION * (toxic + ratio * (F.col("c0") + F.col("c2"))) / 2))
    found = count.orderBy(F.col("key").isNull().desc(), toxic.desc(), "key").limit(LEXICON_WORDS)
    found = found.select("lang", F.col("key").isNull().alias("whole"), F.coalesce("key", F.lit(0)).alias("key"), *[f"c{k}" for k in range(4)]).toPandas()
    total = found[found["whole"]].set_index("lang")
    words = found[~found["whole"]]
    out = []
    for halves in ((0,), (1,), (0, 1)):
        t, c = (sum(words[f"c{2 * h + k}"].to_numpy(float) for h in halves) for k in (1, 0))
        all_t, all_c = (sum(total[f"c{2 * h + k}"].reindex(words["lang"]).to_numpy(float) for h in halves) for k in (1, 0))
        base = np.clip(all_t / np.maximum(all_t + all_c, 1), 1e-6, 1 - 1e-6)
        q = np.clip(t / np.maximum(t + c, 1), 1e-6, 1 - 1e-6)
        good = (t * np.log(q / base) + c * np.log((1 - q) / (1 - base)) >= _EVIDENCE) & (t >= _PRECISION * (t + ratio * c)) & (q > base)
        out.append(np.sort(words["key"].to_numpy(np.int64)[good].view(np.uint64)))
    return out


def _up_to(share: float) -> Column:
    """The largest 64-bit hash of this share of all."""
    return F.lit(int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else (1 << 63) - 1)


def vote_table(df: DataFrame, lexicons: list[np.ndarray] | None = None, share: float = 0.0) -> DataFrame:
    """(doc_id, junk, toxic, gold_code, place, features), in one pass over the texts.

    junk and toxic are each document's votes, a base-3 number for each aspect; gold_code is toxic for a gold document.  The ``share`` of the documents with the
    smallest ``place`` has features: distinct hashed ones, at most TRAIN_FEATURES of a document, chosen by hash.
    """
    lexicons = lexicons or [np.zeros(0, np.uint64)] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b):
                f = Features(c.column("text"))
                keys = f.keys(c.column("lang"))
                hits = [f.learned(keys, x) for x in lexicons]
                v = [votes(f, x) for x in (hits[2], np.where(_half(ids_of(c.column("doc_id"))) == 0, hits[1], hits[0]))]
                code = [sum(x.astype(np.int32) * 3**k for k, x in enumerate(a)) for a in (v[0]["junk"], v[0]["toxic"], v[1]["toxic"])]
                h, at, bins = f.hashed(), f.words.at, f.bins()
                own = [_some(np.unique(np.concatenate([h[at[k] : at[k + 1]], bins[k]]))) if near else None for k, near in enumerate(c.column("near").to_pylist())]
                cols = [c.column("doc_id"), *[pa.array(x, pa.int32()) for x in code], c.column("place"), pa.array(own, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *ASPECTS, "gold_code", "place", "features"])

    place = F.xxhash64(F.lit(41), "doc_id", "text")
    own = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _lang(df), place.alias("place"))
    return own.withColumn("near", F.col("place") <= _up_to(share)).mapInArrow(run, "doc_id long, junk int, toxic int, gold_code int, place long, features array<int>")


def _some(features: np.ndarray) -> np.ndarray:
    if len(features) <= TRAIN_FEATURES:
        return features
    return np.sort(features[np.argpartition(mix(features.astype(np.uint64)), TRAIN_FEATURES)[:TRAIN_FEATURES]])


def expectation_maximisation(counts: dict[int, int], labellers: int, rounds: int = 50, gold: bool = False) -> tuple[dict[int, float], np.ndarray]:
    """P(bad) of each vote pattern, and rates[labeller, class, outcome], from the patterns' counts.

    Starts from the majority of the votes; outcome rates are smoothed by one pseudo-count.  With ``gold`` the last labeller
    anchors the patterns it votes on.
    """
    codes = sorted(counts)
    n = np.array([counts[c] for c in codes], float)
    outcome = np.array([[c // 3**j % 3 for j in range(labellers)] for c in codes]).reshape(len(codes), labellers)
    bad, good = (outcome == 2).sum(1), (outcome == 1).sum(1)
    p = np.where(bad + good > 0, (bad + 0.1) / (bad + good + 0.2), 0.1)
    anchored = lambda p: np.where(outcome[:, -1] == 2, _SURE, np.where(outcome[:, -1] == 1, 1 - _SURE, p)) if gold else p
    p = anchored(p)
    rates = np.zeros((labellers, 2, 3))
    for _ in range(rounds):
        weight = np.stack([n * (1 - p), n * p])
        for j in range(labellers):
            for o in range(3):
                rates[j, :, o] = weight[:, outcome[:, j] == o].sum(1) + 1
        rates /= rates.sum(2, keepdims=True)
        prior = np.clip(weight.sum(1) / max(n.sum(), 1), 1e-6, 1)
        log = np.log(prior)[:, None] + sum(np.log(rates[j, :, outcome[:, j]]).T for j in range(labellers))
        p = anchored(1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500))))
    return dict(zip(codes, p.tolist(), strict=True)), rates


def train_scorer(rows: list[tuple[np.ndarray, float]], passes: int = 3, alpha: float = 0.3, l1: float = 1.0, l2: float = 1.0) -> np.ndarray:
    """Weights (the last one is the bias) of a logistic scorer by FTRL-proximal; a row is (distinct features, P(bad))."""
    size = (1 << BITS) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    for k in range(passes):
        for at in np.random.default_rng(k).permutation(len(rows)):
            x, y = rows[at]
            x = np.append(x, size - 1)
            s = np.sqrt(n[x])
            w[x] = np.where(np.abs(z[x]) <= l1, 0.0, -(z[x] - np.sign(z[x]) * l1) / ((1 + s) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(w[x].sum(), -35, 35)))
            g = p - y
            z[x] += g - (np.sqrt(n[x] + g * g) - s) / alpha * w[x]
            n[x] += g * g
    s = np.sqrt(n)
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((1 + s) / alpha + l2))


def score_documents(df: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """``df`` (doc_id, text, ...) as a struct ``row`` with junk_score and toxic_score."""
    sent = df.sparkSession.sparkContext.broadcast(weights)  # 2 vectors of 2^18 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in row_chunks(b):
                f = Features(c.column("text"))
                h, bins, doc = f.hashed(), f.bins(), f.words.doc_of()
                scores = []
                for a in ASPECTS:
                    w = sent.value[a]
                    hit = np.flatnonzero(w[h])
                    once = np.unique((doc[hit].astype(np.int64) << BITS) | h[hit])
                    total = np.bincount(once >> BITS, w[once & ((1 << BITS) - 1)], minlength=len(f.n)) + w[bins].sum(1) + w[-1]
                    scores.append(pa.array(np.round(1 / (1 + np.exp(-np.clip(total, -35, 35))), 6)))
                yield pa.RecordBatch.from_arrays([c.column("row"), *scores], ["row", "junk_score", "toxic_score"])

    packed = df.select(F.struct(*df.columns).alias("row"))
    schema = T.StructType([packed.schema["row"], T.StructField("junk_score", T.DoubleType()), T.StructField("toxic_score", T.DoubleType())])
    return packed.mapInArrow(run, schema)


def fit(df: DataFrame, gold: DataFrame | None = None, train_rows: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    """Weights of both scorers; ``gold`` has doc_id, quality (0: junk) and toxic (1: toxic)."""
    labellers = dict(HEURISTICS)
    share = min(1.0, 1.2 * train_rows / max(1, df.count()))
    if gold is not None:
        sure = gold.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("gold_toxic"))
        told = written(vote_table(df, learn_words(df, sure), share), "votes")
        vote = lambda bad, good: F.when(bad, 2).when(good, 1).otherwise(0)
        table = told.join(sure, "doc_id", "left").select(
            "doc_id",
            (F.col("junk") + 3 ** HEURISTICS["junk"] * vote(F.col("quality") == 0, F.col("quality") == 1)).alias("junk"),
            (F.when(F.col("gold_toxic").isNull(), F.col("toxic")).otherwise(F.col("gold_code")) + 3 ** HEURISTICS["toxic"] * vote(F.col("gold_toxic") == 1, F.col("gold_toxic") == 0)).alias("toxic"),
            "place", "features",
        )
        labellers = {a: n + 1 for a, n in labellers.items()}
    else:
        table = written(vote_table(df, None, share), "votes")
    patterns = table.groupBy(*ASPECTS).count().collect()  # at most 3^6 * 3^6 rows, of which few occur
    beliefs = {}
    for k, a in enumerate(ASPECTS):
        counts: dict[int, int] = {}
        for r in patterns:
            counts[r[k]] = counts.get(r[k], 0) + r["count"]
        beliefs[a] = expectation_maximisation(counts, labellers[a], gold=gold is not None)[0] if counts else {}
    if not patterns:
        return {a: np.zeros((1 << BITS) + 1) for a in ASPECTS}
    chosen = table.where("features IS NOT NULL").orderBy("place", "doc_id", *ASPECTS).limit(train_rows)
    rows = chosen.select("features", *ASPECTS).toPandas()
    return {a: train_scorer([(np.asarray(x), beliefs[a][c]) for x, c in zip(rows["features"], rows[a], strict=True)]) for a in ASPECTS}


def classify(df: DataFrame, gold: DataFrame | None = None, train_rows: int = TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """``df`` as a struct ``row`` with junk_score, toxic_score and kept."""
    scored = score_documents(df, fit(df, gold, train_rows))
    return scored.withColumn("kept", (F.col("junk_score") < threshold) & (F.col("toxic_score") < threshold))
