"""Toxicity by a support vector machine with a subsequence string kernel (operator 6).

The kernel compares words by the subsequences of 3 to 5 characters that they share, a mark of
the beginning counting as a character. One or two other characters may stand between neighbours, each for a
factor DECAY: "idxiot" and "i1d1i1o1t" share many of theirs with "idiot". Characters that are
neither letters nor digits are left out of words ("i.d.i.o.t"), and single letters that stand alone in a row
("i d i o t") are read as one word. Words are divided by a norm that depends on their length
alone, which keeps the kernel positive definite.

With landmarks l (Nystroem), a word w becomes K(l, l)^-1/2 k(l, w), and a linear machine is trained
on that by the hinge loss. A text is labelled as a whole, and only some words of a toxic text
are to blame, so words get their labels in rounds: first those that toxic texts have
significantly more often, for so many words compared; then also the word that the machine finds worst in each toxic text;
and the innocent words that the machine finds worst join the others. The landmarks'
subsequences, weighted by the machine, make one table with a value for each hashed subsequence: a word is scored by looking
its subsequences up, whatever the number of landmarks. Last, a logistic function of a text's
worst word, of the number of its toxic words and of their share gives the score.

Learning takes a bounded sample of the labelled rows: about POSITIVES and NEGATIVES texts, by a hash of their ids. It runs in
one task, so that neither these texts nor the kernel's matrices are ever in the driver.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.llm.words import chunks

#: Texts of either label that are learnt from, and landmarks of either kind.
POSITIVES, NEGATIVES, LANDMARKS = 1500, 2500, (128, 128)
SLOTS, DECAY = 1 << 18, 0.5
#: Distances between the neighbours of each kind of subsequence.
SHAPES = [
    (1, 1), (1, 2), (2, 1), (2, 2), (1, 3), (3, 1),
    (1, 1, 1), (1, 1, 2), (1, 2, 1), (2, 1, 1), (1, 2, 2), (2, 2, 2),
    (1, 1, 1, 1), (1, 1, 1, 2), (1, 1, 2, 1), (1, 2, 1, 1),
]
#: Rounds of labelling; words that learning starts with, and innocent words that each round adds; spoilt forms of each blamed word.
ROUNDS, WORDS, HARD, VARIANTS = 3, 8_000, 2_000, 8
EPOCHS, STEPS, BATCH, REGULAR = 8, 1500, 64, 1e-4


BREAK, DROP, KEEP = 0, 1, 2
#: What becomes of a code point; those beyond the table are kept.
KIND = np.full(0x3002, KEEP, np.int8)
KIND[:0x3001] = [BREAK if chr(i).isspace() else KEEP if chr(i).isalnum() else DROP for i in range(0x3001)]


class Tokens:
    """The words of some texts as one array of code points; each begins with a mark (1)."""

    def __init__(self, texts: list[str]):
        joined = " ".join(t.lower() for t in texts) + " "
        wide = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.cumsum([0, *(len(t.lower()) + 1 for t in texts)])[:-1]
        sort = KIND[np.minimum(wide, len(KIND) - 1)]
        wide, sort, starts = wide[sort != DROP], sort[sort != DROP], np.cumsum(sort != DROP)
        begin = np.where(begin > 0, starts[np.maximum(begin - 1, 0)], 0)
        sep = sort == BREAK
        start = np.flatnonzero(~sep & np.concatenate(([True], sep[:-1])))
        end = np.flatnonzero(~sep & np.concatenate((sep[1:], [True]))) + 1
        text = np.searchsorted(begin, start, side="right") - 1
        # letters that stand alone in a row are one word
        size = end - start
        head = np.ones(len(start), bool)
        if len(start):
            head[1:] = ~((size[1:] == 1) & (size[:-1] == 1) & (text[1:] == text[:-1]))
        self.text, self.n_texts = text[head], len(texts)
        place = np.cumsum(size + head) - size
        total = int((size + head).sum())
        self.body = np.ones(total, np.uint32)
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        self.body[np.repeat(place, size) + within] = wide[np.repeat(start, size) + within]
        self.start = place[head] - 1
        self.end = np.append(self.start[1:], total) if len(self.start) else self.start

    def __len__(self) -> int:
        return len(self.start)

    def strings(self) -> list[str]:
        body = self.body.tobytes().decode("utf-32-le", "surrogatepass")
        return [body[a + 1 : b] for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)]

    def norm(self) -> np.ndarray:
        """Of each word, by its length: as if all its subsequences were distinct."""
        size = self.end - self.start
        most = int(size.max(initial=0)) + 1
        squares = np.zeros(most + 1)
        for shape in SHAPES:
            squares += np.maximum(0, np.arange(most + 1) - sum(shape)) * DECAY ** (2 * (sum(shape) - len(shape)))
        return np.sqrt(np.maximum(squares[size], 1e-9))

    def codes(self) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """For each shape: its weight, the places where it fits into one word, and the slots there."""
        word = np.repeat(np.arange(len(self), dtype=np.int32), self.end - self.start)
        value = self.body * np.uint32(0x9E3779B1)
        for shape in SHAPES:
            span = sum(shape)
            n = len(value) - span
            if n <= 0:
                continue
            at = np.flatnonzero(word[:n] == word[span:])
            h, step = value[:n].copy(), 0
            for gap in shape:
                step += gap
                h = (h ^ (h >> np.uint32(13))) * np.uint32(0x01000193) + value[step : step + n]
            h = h[at] + np.uint32(len(shape))
            h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
            yield DECAY ** (span - len(shape)), at, ((h >> np.uint32(14)) & np.uint32(SLOTS - 1)).astype(np.int32)

    def sums(self, tables: np.ndarray, column: np.ndarray | None = None) -> np.ndarray:
        """The sum of each word's weighted table values, for each of the tables, over the word's norm; ``column`` says where a slot is in a table."""
        out = np.zeros((len(tables), len(self)), np.float32)
        if not len(self):
            return out
        for lo in range(0, len(tables), 16):
            some = tables[lo : lo + 16]
            per_char = np.zeros((len(some), len(self.body)), np.float32)
            for weight, at, slots in self.codes():
                slots = slots if column is None else column[slots]
                for t in range(len(some)):
                    per_char[t, at] += np.float32(weight) * some[t].take(slots)
            for t in range(len(some)):
                out[lo + t] = np.add.reduceat(per_char[t], self.start)
        return out / self.norm()

    def table(self) -> np.ndarray:
        """All words' subsequences summed up as a table, each word over its norm."""
        norm = self.norm()
        word = np.repeat(np.arange(len(self)), self.end - self.start)
        out = np.zeros(SLOTS, np.float32)
        for weight, at, slots in self.codes():
            np.add.at(out, slots, (weight / norm[word[at]]).astype(np.float32))
        return out


class Model:
    def __init__(self, table: np.ndarray, bias: float, logistic: np.ndarray):
        self.table, self.bias, self.logistic = table, bias, logistic

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Of each text: its worst word's margin, and the logarithms of its toxic words and of their share."""
        tokens = Tokens(texts)
        n = len(texts)
        out = np.zeros((n, 3))
        out[:, 0] = -2.0
        if len(tokens):
            margin = tokens.sums(self.table[None])[0] + self.bias
            count = np.bincount(tokens.text, minlength=n)
            some = np.flatnonzero(count)
            out[some, 0] = np.maximum(-2.0, np.maximum.reduceat(margin, (np.cumsum(count) - count)[some]))
            toxic = np.bincount(tokens.text, weights=margin > 0, minlength=n)
            out[:, 1] = np.log1p(toxic)
            out[:, 2] = np.log1p(300 * toxic / np.maximum(count, 1))
        out[:, 0] = np.minimum(out[:, 0], 2.0)
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        z = self.evidence(texts) @ self.logistic[:3] + self.logistic[3]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _hinge(z: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """A linear machine by averaged stochastic descent on the weighted hinge loss."""
    w, b = np.zeros(z.shape[1]), 0.0
    total_w, total_b, n = np.zeros_like(w), 0.0, 0
    epochs = max(EPOCHS, -(-STEPS * BATCH // max(1, len(z))))  # few words are gone through more often
    for epoch in range(epochs):
        order = rng.permutation(len(z))
        rate = 2.0 / (1 + EPOCHS * epoch / epochs)
        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            bad = (y[some] * (z[some] @ w + b) < 1) * weight[some] * y[some] / len(some)
            w += rate * (bad @ z[some] - REGULAR * w)
            b += rate * bad.sum()
            if epoch >= epochs // 2:
                total_w, total_b, n = total_w + w, total_b + b, n + 1
    return total_w / max(n, 1), total_b / max(n, 1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and a constant by damped Newton steps; a small penalty keeps them finite."""
    x1, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (p - y) + 0.01 * w
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 + 0.01 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step / max(1.0, float(np.abs(step).max()) / 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _maps(landmarks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The landmarks' tables (landmarks, columns), and the column of each slot; slots that no landmark has share one of zeros."""
    sparse = []
    for word in landmarks:
        one = Tokens([word]).table()
        slots = np.flatnonzero(one)
        sparse.append((slots, one[slots]))
    every = np.unique(np.concatenate([s for s, _ in sparse]))
    column = np.full(SLOTS, len(every), np.int32)
    column[every] = np.arange(len(every))
    maps = np.zeros((len(landmarks), len(every) + 1), np.float32)
    for i, (slots, values) in enumerate(sparse):
        maps[i, column[slots]] = values
    return maps, column


def _spoil(word: str, rng: np.random.Generator) -> str:
    """The word with one or two letters or digits put in between its own."""
    for _ in range(int(rng.integers(1, 3))):
        at = int(rng.integers(1, max(2, len(word))))
        word = word[:at] + "abcdefghijklmnopqrstuvwxyz0123456789"[int(rng.integers(36))] + word[at:]
    return word


def _excess(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """How significantly more often toxic texts have a word: the log-likelihood ratio, below 0 for the contrary."""
    n, p = pos + neg, n_pos / (n_pos + n_neg)
    q = np.clip(pos / np.maximum(n, 1), 1e-12, 1 - 1e-12)
    ratio = 2 * (pos * np.log(q / p) + neg * np.log((1 - q) / (1 - p)))
    return np.where(q > p, ratio, -ratio)


def train(texts: list[str], labels: list[int], seed: int = 11) -> Model:
    """From texts and their labels 0 or 1."""
    y = np.array(labels)
    table, bias = np.zeros(SLOTS, np.float32), -1.0
    n_pos, n_neg = int(y.sum()), int((1 - y).sum())
    if not n_pos or not n_neg:
        share = math.log((n_pos + 1) / (n_neg + 1))
        return Model(table, bias, np.array([0, 0, 0, share]))
    rng = np.random.default_rng(seed)
    of_word: dict[str, int] = {}
    bags = [np.array(sorted({of_word.setdefault(w, len(of_word)) for w in Tokens([t]).strings()}), np.int32) for t in texts]
    words = list(of_word)
    has = [np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)]
    for label, bag in zip(labels, bags, strict=True):
        has[label][bag] += 1
    pos, neg = has[1], has[0]
    excess = _excess(pos, neg, n_pos, n_neg)
    ranked = np.lexsort((np.arange(len(words)), -excess))
    toxic = np.zeros(len(words), bool)
    toxic[excess >= 2 * math.log(max(2, len(words)))] = True
    if not toxic.any():
        toxic[ranked[:5]] = True
    common = np.lexsort((np.arange(len(words)), -neg))
    common = common[(neg[common] > 0) & ~toxic[common]]
    others = rng.permutation(common[WORDS // 2 :])[: WORDS // 2]
    innocent = np.concatenate([common[: LANDMARKS[1] // 2], others[: LANDMARKS[1] // 2]])
    marks = Tokens([words[i] for i in [*ranked[: LANDMARKS[0]], *innocent]])
    maps, column = _maps(marks.strings())
    kernel = lambda some: some.sums(maps, column).T.astype(np.float32)
    k_ll = kernel(marks)
    vals, vecs = np.linalg.eigh((k_ll + k_ll.T).astype(np.float64) / 2)
    good = vals > 1e-6 * vals.max()
    root = (vecs[:, good] / np.sqrt(vals[good])).astype(np.float32)
    every = [Tokens(words[lo : lo + 20_000]) for lo in range(0, len(words), 20_000)]
    inside = [bag for bag, label in zip(bags, labels, strict=True) if label and len(bag)]
    used = np.unique(np.concatenate([np.flatnonzero(toxic), common[: WORDS // 2], others]))
    z = kernel(Tokens([words[i] for i in used])) @ root
    for _ in range(ROUNDS):
        target = np.where(toxic[used], 1.0, -1.0)
        weight = np.sqrt(np.where(toxic[used], pos[used], neg[used]).astype(float))
        # blamed words with characters put in between, so that these don't change the verdict
        blamed = np.flatnonzero(toxic)
        source = np.repeat(blamed, VARIANTS)
        spoilt = Tokens([_spoil(words[i], rng) for i in source])
        z_all = np.vstack([z, kernel(spoilt) @ root])
        target = np.concatenate([target, np.ones(len(source))])
        weight = np.concatenate([weight, np.sqrt(pos[source]) / VARIANTS])
        weight[target > 0] *= 0.3 * weight[target < 0].sum() / max(weight[target > 0].sum(), 1e-9)
        weight /= weight.mean()
        w, bias = _hinge(z_all, target, weight, rng)
        value = ((root @ w) @ maps).astype(np.float32)[None]
        margin = np.concatenate([part.sums(value, column)[0] for part in every]) + bias
        # a toxic text without a word to blame names its worst, if toxic texts have it more often than clean ones
        named = toxic.copy()
        for rows in inside:
            if not toxic[rows].any():
                worst = rows[margin[rows].argmax()]
                named[worst] |= margin[worst] > 0 and excess[worst] > 2
        worst = np.lexsort((np.arange(len(words)), -margin))
        worst = worst[(neg[worst] > 0) & ~named[worst]][:HARD]
        toxic = named
        more = np.setdiff1d(np.concatenate([np.flatnonzero(toxic), worst]), used)
        if len(more):
            z = np.vstack([z, kernel(Tokens([words[i] for i in more])) @ root])
            used = np.concatenate([used, more])
    table = ((root @ w) @ maps).astype(np.float32)[column]
    model = Model(table, float(bias), np.zeros(4))
    model.logistic = _logistic(np.vstack([model.evidence(texts[lo : lo + 50]) for lo in range(0, len(texts), 50)]), y)
    return model


def fit(df: DataFrame, labels: DataFrame, may_learn: Column, text: str = "text", label: str = "toxic", key: str = "doc_id") -> Model:
    """Learn from a bounded sample of labelled rows; a row with several labels has the larger one."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & may_learn).groupBy(F.col(key).alias("_k")).agg(F.max(label).cast("int").alias("_y"))
    counts = {r._y: r.n for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect() if r._y in (0, 1)}
    parts = 1_000_000
    share = {c: parts * most / counts[c] for c, most in ((1, POSITIVES), (0, NEGATIVES)) if counts.get(c)}
    if not share:
        return train([], [])
    chance = F.coalesce(*[F.when(F.col("_y") == c, F.lit(float(s))) for c, s in share.items()])
    # (labels of texts that are not there count too, so the sample may be smaller)
    sample = known.filter(F.pmod(F.xxhash64("_k"), F.lit(parts)) < chance)
    bodies = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(text).alias("t"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((y, t) for b in batches for t, y in zip(b.column("t").to_pylist(), b.column("_y").to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([t for _, t in rows], [y for y, _ in rows]))], pa.binary())], ["model"])

    got = bodies.join(F.broadcast(sample), "_k").select("t", "_y").repartition(1).mapInArrow(learn, "model binary").first()
    return pickle.loads(got.model) if got else train([], [])


def scorer(df: DataFrame, model: Model) -> object:
    """A function of a text column: its score from 0 to 1."""
    kept = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [kept.value.score([t or "" for t in part.to_pylist()]) for _, part in chunks(texts, 500_000)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score


def score_texts(df: DataFrame, labels: DataFrame, held_out: Column, text: str = "text", key: str = "doc_id", names: tuple[str, str, str] = ("held_out", "score", "predicted")) -> DataFrame:
    """All columns of df and held_out, score, predicted.

    ``held_out`` is a column over the key, true for rows that are never learnt from. Null and empty texts score as texts without words. Without labels of both kinds every
    score is the share of the kind there is. Repeated rows come each for themselves; a key with several labels counts as toxic if one of them says so. Columns of df with
    the names of the results, which ``names`` may change, are replaced.
    """
    held = F.coalesce(held_out, F.lit(False))
    model = fit(df, labels, ~held, text=text, key=key)
    own = {n.lower() for n in names}
    scored = df.select(*(c for c in df.columns if c.lower() not in own), held.alias(names[0]), scorer(df, model)(F.coalesce(F.col(text), F.lit(""))).alias(names[1]))
    return scored.withColumn(names[2], (F.col(names[1]) >= 0.5).cast("int"))
