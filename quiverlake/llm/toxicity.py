"""Toxicity: a support vector machine with a gapped subsequence kernel and Nyström landmarks.

The kernel compares words (and runs of single letters, joined) by the subsequences of three to five characters that
they share, each weighted by ``DECAY`` to the power of its gaps, so that gaps and inserted characters cost a little
only. Landmark words span an approximate feature space (Nyström), in which a linear machine is trained. As spans are
bounded, the kernel has an explicit map into ``TABLE`` hash buckets, and the trained machine is one table of that size:
a word's decision is a sum of look-ups. A sentence's decision is its words' largest, a text's its sentences'; a logistic
curve turns it into a score.

Training takes the labelled sentences of at most ``TRAIN_TEXTS`` labelled texts (chosen by a hash of their ids; the bound is the
parameter ``limit``). A sentence has its text's label, but is clean if a clean text has it too; each different sentence
counts once, and of texts that are mostly alike one. It is a multiple-instance machine: of a clean sentence all words are
clean, of a toxic one some word must stand for it. These witnesses are first the words that are ``LIKELIER`` in toxic sentences, beyond
what chance explains, then, in rounds, the worst word of each toxic text that none of them explains. The machine is trained on the
witnesses, weighted by their sentences, against words of clean sentences, and again with those that it took for toxic.
Two thirds of the texts train it, the others fit the curve. Scoring covers every word of every text.

Bounds of the training sample, besides ``limit``: ``POSITIVES`` witnesses by evidence, ``NEGATIVES`` clean words (the most frequent, then
by hash) and as many hard ones as a third of that, ``LANDMARKS`` landmarks.

Nulls and texts without words get the score of a text without evidence. Repeated rows get the same score. Ties among words
go by their letters. Without labelled texts of both kinds all scores are the share of toxic labels (0.1 where none). Other
columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, table
from .textvec import LOWER, SPACED, Words, flat, hash_word

TRAIN_TEXTS = 6000
#: Weight of each character left out; widths within which three, four and five characters may lie.
DECAY, SPANS = 0.5, {3: 4, 4: 5, 5: 6}
TABLE = 1 << 20
#: Characters of a word taken together; longer words are taken in overlapping parts.
WIDE = 32
LANDMARKS, NEGATIVES, ROUNDS = 240, 3000, 2
#: A witness is at least so many times likelier in toxic sentences than in clean ones; at most so many of them.
LIKELIER, POSITIVES = 4.5, 400
#: Where sentences end; a longer one is cut after so many words.
_END, LONGEST = re.compile(r"(?<=[.!?])\s+|\n+"), 64
#: The machine's cost of an error.
COST = 2.0
THRESHOLD = 0.3
#: Scored words remembered by a worker.
REMEMBERED = 400_000

#: Places of a subsequence's later characters, from its first.
SHAPES = [(*x, last) for n, span in SPANS.items() for last in range(n - 1, span) for x in itertools.combinations(range(1, last), n - 2)]
_LEET = str.maketrans("013457@", "oieasta")


def letters(word: str) -> str:
    """The word in lower case without what surrounds its letters; digits among letters as the letters they resemble."""
    word = word.lower()
    a, z = 0, len(word)
    while a < z and not word[a].isalpha():
        a += 1
    while z > a and not word[z - 1].isalpha():
        z -= 1
    word = word[a:z]
    return word if word.isalpha() else word.translate(_LEET)


def encoded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, WIDE + 2) from 1, 0 after the end, and lengths. Characters that aren't letters are left out, as if inserted."""
    out, size = np.zeros((len(words), WIDE + 2), np.int64), np.zeros(len(words), np.int64)
    for i, w in enumerate(words):
        codes = [c - 96 if 97 <= c <= 122 else 27 + c % 35 for c in map(ord, w) if 97 <= c <= 122 or c > 127]
        codes = [63, *codes[:WIDE], 62]  # both ends of the word are characters too
        size[i] = n = len(codes)
        out[i, :n] = codes
    return out, size


def features(codes: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, float, np.ndarray]]:
    """(bucket, weight, valid) of each subsequence shape at every start."""
    n = codes.shape[1]
    at = np.arange(n)
    padded = np.hstack([codes, np.zeros((len(codes), max(SPANS.values())), np.int64)])
    for shape in SHAPES:
        key = codes
        for o in shape:
            key = key * 64 + padded[:, o : o + n]
        key = (key * 0x9E3779B1 >> 11) & (TABLE - 1)
        yield key, DECAY ** (shape[-1] - len(shape)), (codes > 0) & (at + shape[-1] < size[:, None])


def lengths(size: np.ndarray) -> np.ndarray:
    """Norm of the map for words of different subsequences; depends on the length alone."""
    total = np.zeros(len(size))
    for shape in SHAPES:
        total += np.maximum(0, size - shape[-1]) * DECAY ** (2 * (shape[-1] - len(shape)))
    return np.sqrt(np.maximum(total, 1e-12))


def keyed(codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subsequences, a row for each word (TABLE where there is none), and the weight of each column."""
    found = [(np.where(valid, key, TABLE).astype(np.int32), weight) for key, weight, valid in features(codes, size)]
    return np.hstack([k for k, _ in found]), np.repeat([w for _, w in found], codes.shape[1]).astype(np.float32)


def apply_table(values: np.ndarray, keys: tuple[np.ndarray, np.ndarray], size: np.ndarray) -> np.ndarray:
    """Kernel sums of ``values`` (TABLE + 1 of them, the last is 0) with each word."""
    return (values[keys[0]] @ keys[1]).astype(np.float64) / lengths(size)


def landmark_map(keys: tuple[np.ndarray, np.ndarray], size: np.ndarray) -> Iterator[np.ndarray]:
    """The explicit map of each word, one dense table at a time."""
    for row, norm in zip(keys[0], lengths(size), strict=True):
        x = np.bincount(row, weights=keys[1], minlength=TABLE + 1) / norm
        x[TABLE] = 0
        yield x.astype(np.float32)


def svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps on the violated rows; the last weight is the bias."""
    z = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(z.shape[1])
    loss = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (z @ v)) ** 2).sum()
    for _ in range(rounds):
        bad = y * (z @ w) < 1
        zb, cb = z[bad], cost[bad]
        g = w - 2 * zb.T @ (cb * (y[bad] - zb @ w))
        step = np.linalg.solve(np.eye(len(w)) + 2 * (zb * cb[:, None]).T @ zb, g)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w


def units(text: str) -> list[str]:
    """Words and joined runs of single letters."""
    out, run = [], []
    for w in text.split():
        w = letters(w)
        if len(w) == 1:
            run.append(w)
            continue
        if len(run) > 2:
            out.append("".join(run))
        run = []
        if len(w) > 2:
            out += [w] if len(w) <= WIDE else [w[i : i + WIDE] for i in range(0, len(w) - WIDE // 2, WIDE // 2)]
    if len(run) > 2:
        out.append("".join(run))
    return out


class Model:
    """The trained table, its bias, and the logistic curve's slope and place."""

    def __init__(self, values: np.ndarray, bias: float, slope: float, place: float, empty: float):
        self.values, self.bias, self.slope, self.place, self.empty = values.astype(np.float32), bias, slope, place, empty
        # Decisions met before: by the hash of a word as it stands (sorted), and by its letters.
        self.keys, self.found, self.known = np.zeros(0, np.uint64), np.zeros(0), {}

    def decide(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words))
        order = np.argsort([len(w) for w in words], kind="stable") if words else np.zeros(0, np.int64)
        for lo in range(0, len(words), 4096):  # words of like lengths together, cut to the longest
            at = order[lo : lo + 4096]
            codes, size = encoded([words[i] for i in at])
            codes = codes[:, : int(size.max())]
            out[at] = apply_table(self.values, keyed(codes, size), size) + self.bias
        return out

    def remembered(self, words: list[str]) -> np.ndarray:
        """``decide``, once for each different word."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set(words).difference(self.known))
        self.known.update(zip(new, self.decide(new).tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), float, len(words))

    def score(self, decision: np.ndarray) -> np.ndarray:
        """From a text's largest decision; minus infinity: no words."""
        some = np.isfinite(decision)
        x = np.where(some, self.slope * np.where(some, decision, 0.0) + self.place, self.empty)
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def flatly(share: float) -> Model:
    place = float(np.log(share / (1 - share)))
    return Model(np.zeros(TABLE + 1), 0.0, 0.0, place, place)


def sentences(text: str) -> list[list[str]]:
    """The units of each sentence that has some."""
    found = [units(x) for x in _END.split(text)]
    return [x[i : i + LONGEST] for x in found for i in range(0, len(x), LONGEST)]


def different(bags: list[set[str]]) -> list[int]:
    """Indices of bags that aren't mostly the words of an earlier one: words of a much copied text would look telling.

    Bags alike share their rarest words of those that several have; each is compared with the earlier ones that it shares some with."""
    often = Counter(w for bag in bags for w in bag)
    by_word: dict[str, list[int]] = {}
    out = []
    for i, bag in enumerate(bags):
        marks = sorted((w for w in bag if often[w] > 1), key=lambda w: (often[w], zlib.crc32(w.encode()), w))[:6]
        near = {j for m in marks for j in by_word.get(m, ())}
        if bag and any(2 * len(bag & bags[j]) > min(len(bag), len(bags[j])) + 0.2 * max(len(bag), len(bags[j])) for j in near):
            continue
        out.append(i)
        for m in marks:
            by_word.setdefault(m, []).append(i)
    return out


def evidence(bad: int, good: int, share: float) -> float:
    """Log-likelihood ratio of a word held by so many toxic and clean sentences against chance at the share of toxic ones; 0 if it isn't LIKELIER in toxic ones."""
    n = bad + good
    if bad * (1 - share) < LIKELIER * (good + 0.3) * share:
        return 0.0
    return 2 * (bad * math.log(bad / (share * n)) + (good * math.log(good / ((1 - share) * n)) if good else 0.0))


def train(texts: list[str], toxic: list[int], seed: int = 11) -> Model:
    """Landmarks, machine and curve from labelled texts."""
    y = np.array(toxic)
    if not len(y):
        return flatly(0.1)
    share = float(np.clip(y.mean(), 0.01, 0.99))
    parts = [[set(map(sys.intern, x)) for x in sentences(t)] for t in texts]
    bags = [set().union(*x) if x else set() for x in parts]
    alone = different(bags)
    bags, parts, y = [bags[i] for i in alone], [parts[i] for i in alone], y[alone]
    learn = [i for i in range(len(bags)) if i % 3]
    labelled: dict[frozenset, int] = {}
    for i in learn:
        for x in map(frozenset, parts[i]):
            labelled[x] = min(labelled.get(x, 1), int(y[i]))
    bad, good = Counter(), Counter()
    for x in sorted(labelled, key=sorted):
        (bad if labelled[x] else good).update(x)
    n_bad = sum(labelled.values())
    if not n_bad or n_bad == len(labelled):
        return flatly(share)
    clean = sorted(good, key=lambda w: (hash_word(w), w))
    usual = sorted(clean, key=lambda w: -good[w])[: NEGATIVES // 3]
    clean = list(dict.fromkeys([*usual, *clean]))[:NEGATIVES]
    # Evidence beyond what the best of so many words would have by chance.
    told = {w: evidence(bad[w], good[w], n_bad / len(labelled)) for w in bad}
    ranked = sorted((w for w in told if told[w] > 0), key=lambda w: (-told[w], w))
    chosen = [w for w in ranked if told[w] > 2 * math.log(len(bad) + len(good))][:POSITIVES] or ranked[:20]
    if not chosen:
        return flatly(share)
    rng = np.random.default_rng(seed)
    model, worst = None, []
    for turn in range(ROUNDS + 1):
        positive = list(dict.fromkeys(chosen))
        twisted = []
        for w in positive:  # the same with a letter put in
            k = int(rng.integers(1, len(w)))
            twisted.append(w[:k] + chr(97 + int(rng.integers(26))) + w[k:])
        if model:  # words of clean texts that look worst
            every = list(good)
            f = model.decide(every)
            hard = [every[i] for i in np.argsort(-f, kind="stable")[: NEGATIVES // 3]]
            worst = hard[: LANDMARKS // 4] + worst
            clean = list(dict.fromkeys([*hard, *clean]))
        words = [*positive, *twisted, *clean]
        side = np.array([1.0] * (2 * len(positive)) + [-1.0] * len(clean))
        spread = [positive[i] for i in rng.permutation(len(positive))]
        marks = list(dict.fromkeys([*positive[: LANDMARKS // 4], *spread]))[: LANDMARKS // 2]
        marks += [*worst[: LANDMARKS // 2], *clean[: LANDMARKS // 4], *[clean[i] for i in rng.permutation(len(clean))[: LANDMARKS // 4]]]
        marks = list(dict.fromkeys(marks))
        codes, size = encoded(words)
        keys = keyed(codes, size)
        mark_codes, mark_size = encoded(marks)
        mark_keys = keyed(mark_codes, mark_size)
        both = [(apply_table(x, keys, size), apply_table(x, mark_keys, mark_size)) for x in landmark_map(mark_keys, mark_size)]
        k_nm, k_mm = (np.stack(x, axis=1) for x in zip(*both, strict=True))
        values, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
        keep = values > 1e-7 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        # A word counts as often as texts hold it; both sides weigh the same in sum.
        weight = np.array([*[min(bad[x], 40.0) for x in positive], *[0.25 * min(bad[x], 40.0) for x in positive], *[min(good[x], 40.0) + 5.0 for x in clean]])
        cost = COST * weight
        cost[side > 0] *= weight[side < 0].sum() / weight[side > 0].sum()
        w = svm(k_nm @ root, side, cost)
        weights = root @ w[:-1]
        table_ = np.zeros(TABLE + 1)
        for c, x in zip(weights, landmark_map(mark_keys, mark_size), strict=True):
            table_ += c * x
        model = Model(table_, float(w[-1]), 1.0, 0.0, 0.0)
        if turn < ROUNDS:
            # Toxic texts that no chosen word explains give the word most like the chosen ones.
            known = set(chosen)
            for i in learn:
                if y[i] and bags[i] and not known & bags[i]:
                    b = sorted(x for x in bags[i] if not good[x])
                    if b and (f := model.decide(b)).max() > 0.5:
                        chosen.append(b[int(f.argmax())])
    rest = [i for i in range(len(bags)) if i not in set(learn)] or learn
    top = np.array([model.decide(sorted(bags[i])).max() if bags[i] else -np.inf for i in rest])
    slope, place = _logistic(np.where(np.isfinite(top), top, -1.5), y[rest])
    return Model(table_, model.bias, slope, place, slope * -1.5 + place)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope (positive) and place of P(y | x) by Newton steps, lightly penalised."""
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 2.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - t) * x).sum() + 1e-2 * a, (p - t).sum() + 1e-2 * b])
        q = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(q * x * x).sum() + 1e-2, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0] * min(1, 2 / (np.abs(step).max() + 1e-9)), b - step[1] * min(1, 2 / (np.abs(step).max() + 1e-9))
    return max(float(a), 0.1), float(b)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_TEXTS) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``limit`` rows that aren't held out."""
    some = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").orderBy("doc_id", F.xxhash64("text")).limit(limit).collect()
    return [r["text"] or "" for r in rows], [int(r["toxic"]) for r in rows]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in chunks(batches, "text"):
            data, offsets = flat(b.column(1))
            w = Words(LOWER[data], offsets, SPACED)
            top = np.full(b.num_rows, -np.inf)
            # Each different word once; those seen before are looked up.
            h, first = np.unique(w.hash, return_index=True)
            keys, values = m.keys, m.found
            at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            seen = keys[at] == h if len(keys) else np.zeros(len(h), bool)
            f = np.full(len(h), -np.inf)
            f[seen] = values[at[seen]]
            new = np.flatnonzero(~seen)
            if len(new):
                raw = [bytes(data[w.start[i] : w.end[i]]).decode() for i in first[new].tolist()]
                parts = [units(x) for x in raw]
                got = m.remembered([p for x in parts for p in x])
                count = np.array([len(x) for x in parts])
                some = np.flatnonzero(count)
                if len(some):
                    f[new[some]] = np.maximum.reduceat(got, (np.cumsum(count) - count)[some])
                keys, values = np.concatenate([keys, h[new]]), np.concatenate([values, f[new]])
                order = np.argsort(keys)
                keys, values = keys[order], values[order]
                if len(keys) > 2 * REMEMBERED:
                    keys, values = keys[:0], values[:0]
                m.keys, m.found = keys, values
            each = f[np.searchsorted(h, w.hash)]
            have = np.flatnonzero(w.count)
            if len(have):
                top[have] = np.maximum.reduceat(each, w.first[:-1][have])
            # Runs of single letters, joined: only texts with three such words in a row.
            one = np.zeros(len(w) + 2, bool)
            letter = (np.r_[data, 0] | 32 >= 97) & (np.r_[data, 0] != 124)
            size = w.end - w.start
            one[: len(w)] = (size == 1) | (size == 2) & (letter[w.start].astype(int) + letter[w.start + size - 1] == 1)
            rows = w.doc[np.flatnonzero(one[:-2] & one[1:-1] & one[2:])] if len(w) else []
            for d in np.unique(rows).tolist():
                text = bytes(data[offsets[d] : offsets[d + 1]]).decode()
                joined = [x for x in units(text) if len(x) > 2]
                if joined:
                    top[d] = max(top[d], m.remembered(joined).max())
            score = m.score(top)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(*labelled_texts(docs, table(spark, sf_dir, "labels"))))
