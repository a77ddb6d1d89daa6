"""Language identification (operator 10).

Subwords are the runs of 2 to 4 bytes of lower-cased words with a space at either end,
hashed into a table of embeddings. A text is the average of its subwords' embeddings,
and a linear softmax over it gives the languages. Both are trained together by stochastic
gradient descent in numpy, on windows drawn from the rows that may be learnt from: about WINDOWS for each
language, taken by a hash of the row and the place. A part of the windows is
kept back to fit a temperature and the score below which a prediction is rejected.

Because the model is linear, scoring uses the table embeddings @ weights, one value for
each bucket and language, and goes over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.llm.words import chunks, flat
from tideglass.session import cut, fresh, quoted

BUCKETS, DIM, SIZES = 1 << 16, 16, (2, 3, 4)
#: (few windows are gone through more often, for STEPS steps at least)
WINDOW, WINDOWS, EPOCHS, STEPS, BATCH, RATE = 200, 1500, 4, 500, 32, 2.0
#: Windows of all languages together, by which their number for each falls where there are very many languages; all languages are learnt.
ALL_WINDOWS = 300_000
#: Steps in which a window's chance to be drawn is told: fine enough for as many windows as there can be.
DRAWS = 1 << 40
#: Languages whose counts are sent to all tasks; more are joined by a shuffle.
BROADCAST_LANGUAGES = 100_000
#: The share of kept-back windows that the rejection threshold lets go.
REJECTED = 0.01
UNDETERMINED = "und"


def _subwords(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """For each size, the buckets at each byte place (BUCKETS where a subword holds a break); and where texts begin."""
    lower = pc.utf8_lower(texts.fill_null("")).cast(pa.large_string())
    body, at = flat(lower)
    # a space before each text and at the end, so that texts don't run into one another
    n = len(at) - 1
    wide = np.full(len(body) + n + 1, 32, np.uint8)
    begin = at[:-1] + np.arange(n)
    keep = np.ones(len(wide), bool)
    keep[begin] = False
    keep[-1] = False
    wide[keep] = body
    letter = ((wide >= 97) & (wide <= 122)) | (wide >= 128)
    wide[~letter] = 32
    value = wide.astype(np.uint32)
    inner = letter
    found = []
    h = value.copy()
    ok = np.ones(len(wide), bool)
    for k in range(1, max(SIZES)):
        h = h[:-1] * np.uint32(0x01000193) + value[k:]
        # places 1..k-1 are letters; both ends may be a break, not both at once
        ok = ok[:-1] & (inner[k - 1 : len(inner) - 1] if k > 1 else True)
        if k + 1 in SIZES:
            both = ~inner[: len(h)] & ~inner[k:]
            m = h * np.uint32(0x9E3779B1)
            m ^= m >> np.uint32(15)
            code = (m & np.uint32(BUCKETS - 1)).astype(np.int32)
            code[~ok | both] = BUCKETS
            found.append(code)
    return found, np.append(begin, len(wide))


def _sums(texts: pa.Array, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the values of each text's subwords, and how many it has. values has BUCKETS + 1 rows, the last of zeros."""
    codes, at = _subwords(texts)
    n = len(at) - 1
    total, count = np.zeros((n, values.shape[1])), np.zeros(n)
    columns = np.ascontiguousarray(values.T)
    for code in codes:
        lo = np.minimum(at[:-1], max(0, len(code) - 1))
        if not len(code):
            continue
        empty = np.minimum(at[1:], len(code)) <= at[:-1]
        real = (code < BUCKETS).astype(np.int32)
        for j in range(values.shape[1]):
            s = np.add.reduceat(columns[j].take(code), lo)
            total[:, j] += np.where(empty, 0, s)
        count += np.where(empty, 0, np.add.reduceat(real, lo))
    return total, count


class Model:
    """Languages, the value of each bucket for each of them, temperature and rejection threshold."""

    def __init__(self, languages: list[str], table: np.ndarray, temperature: float = 1.0, reject_below: float = 0.0):
        self.languages, self.table, self.temperature, self.reject_below = languages, table, temperature, reject_below

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        total, count = _sums(texts, self.table)
        z = total / np.maximum(count, 1)[:, None] / self.temperature
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model | None:
    """None if there is nothing to learn from."""
    languages = sorted(set(langs))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held = order[: len(order) // 5] if len(order) >= 50 else order
    used = order[len(order) // 5 :] if len(order) >= 50 else order
    y = np.array([languages.index(x) for x in langs])
    codes, at = _subwords(pa.array(texts, pa.large_string()))
    bags = []
    for i in range(len(texts)):
        bag = np.concatenate([c[at[i] : at[i + 1]] for c in codes])
        bags.append(bag[bag < BUCKETS])
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weights = np.zeros((DIM, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    share = np.bincount(y[used], minlength=len(languages)) / max(1, len(used))
    balance = (1 / np.maximum(share, 1e-9) / len(languages)).astype(np.float32)
    each = max(1, ceil(len(used) / BATCH))
    epochs = max(EPOCHS, ceil(STEPS / each))
    steps, done = epochs * each, 0
    for _ in range(epochs):
        for lo in range(0, len(used), BATCH):
            rows = [i for i in used[lo : lo + BATCH] if len(bags[i])]
            rate = RATE * (1 - done / steps)
            done += 1
            if not rows:
                continue
            sizes = np.array([len(bags[i]) for i in rows])
            flat_codes = np.concatenate([bags[i] for i in rows])
            mean = np.add.reduceat(table[flat_codes], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
            z = mean @ weights + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            g = (p * balance[y[rows]][:, None] / len(rows)).astype(np.float32)
            down = g @ weights.T
            weights -= rate * (mean.T @ g)
            bias -= rate * g.sum(0)
            unique, inverse = np.unique(flat_codes, return_inverse=True)
            spread = np.zeros((len(unique), DIM), np.float32)
            np.add.at(spread, inverse, np.repeat(down / sizes[:, None].astype(np.float32), sizes, axis=0))
            table[unique] -= rate * 20 * spread
        used = rng.permutation(used)
    values = np.vstack([table @ weights + bias, np.zeros((1, len(languages)), np.float32)]).astype(np.float32)
    model = Model(languages, values)
    p = model.probabilities(pa.array([texts[i] for i in held], pa.large_string()))
    logits, truth, best = np.log(np.maximum(p, 1e-30)), y[held], (np.inf, 1.0)
    for t in np.geomspace(0.1, 10, 41):
        z = logits / t
        z = z - z.max(1, keepdims=True)
        loss = float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(held)), truth]))
        best = min(best, (loss, float(t)))
    model.temperature = best[1]
    p = model.probabilities(pa.array([texts[i] for i in held], pa.large_string()))
    right = p.max(1)[p.argmax(1) == truth]
    model.reject_below = float(np.quantile(right, REJECTED)) if len(right) else 0.0
    return model


def training_windows(df: DataFrame, may_learn: Column, text: str, lang: str) -> DataFrame:
    """text, lang of windows of WINDOW characters: about WINDOWS of each language, ALL_WINDOWS at most, drawn by a hash from whole texts; a window that is drawn from several copies comes once."""
    body = df.filter(may_learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    body = body.withColumn("n", F.ceil(F.length("text") / WINDOW).cast("int")).filter("n > 0")
    # (copies are drawn together and count once, so that a language isn't drawn by how often its texts are repeated)
    counts = cut(body.groupBy("lang").agg((F.sum("n") * F.approx_count_distinct(F.xxhash64("text"), 0.02) / F.count("*")).alias("total")))
    n = counts.count()
    windows = float(max(1, min(WINDOWS, ALL_WINDOWS // max(1, n))))
    counts = F.broadcast(counts) if n <= BROADCAST_LANGUAGES else counts  # (so the texts aren't shuffled)
    # The draw needs nothing but the text, so that it is the same however the table is cut into partitions.
    drawn = body.join(counts, "lang").withColumn("seed", F.xxhash64("text"))
    place = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.pmod(F.xxhash64("seed", i), F.lit(DRAWS)) < F.ceil(F.lit(float(DRAWS) * windows) / F.col("total")))
    return drawn.select("lang", "text", F.explode(place).alias("i")).select(F.substring("text", F.col("i") * WINDOW + 1, F.lit(WINDOW)).alias("text"), "lang").distinct()


def fit(df: DataFrame, may_learn: Column, text: str = "text", lang: str = "lang") -> Model | None:
    rows = training_windows(df, may_learn, text, lang).collect()
    rows.sort(key=lambda r: (r.lang, r.text))
    return train([r.text for r in rows], [r.lang for r in rows])


def predictor(df: DataFrame, model: Model | None) -> object:
    """A function of a text column: struct of lang, score and rejected."""
    kept = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double, rejected boolean")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = kept.value
        for texts in batches:
            lang, score = [], []
            for _, part in chunks(texts, 1_000_000):
                if model is None:
                    lang += [UNDETERMINED] * len(part)
                    score += [0.0] * len(part)
                    continue
                # rounded, so that equal texts score alike wherever they stand; the first language of equals
                p = np.round(model.probabilities(part), 9)
                best = p.argmax(1)
                lang += [model.languages[i] for i in best]
                score += p[np.arange(len(best)), best].tolist()
            low = [s < (model.reject_below if model else 1.0) for s in score]
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(low, pa.bool_())], ["lang", "score", "rejected"])

    return predict


def identify(df: DataFrame, held_out: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """key, held_out, lang_pred, score, rejected of each row.

    Rows that are held out, or whose language is null, are never learnt from. A null text, an empty one and one without a letter
    get ``und`` with score 0; so does every row where nothing can be learnt. ``rejected`` marks scores below what the
    kept-back windows had; the prediction stands beside it. Repeated rows come each for themselves.
    """
    held = F.coalesce(held_out, F.lit(False))
    model = fit(df, ~held, text, lang)
    given, held_name, letter, guess = fresh(df, "_given", "_held", "_letter", "_guess")
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    out = df.select(F.col(quoted(key)).alias(given), held.alias(held_name), has_letter.alias(letter), predictor(df, model)(F.coalesce(F.col(text), F.lit(""))).alias(guess))
    return out.select(
        F.col(given).alias(key),
        F.col(held_name).alias("held_out"),
        F.when(F.col(letter), F.col(guess)["lang"]).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(F.col(letter), F.col(guess)["score"]).otherwise(0.0).alias("score"),
        (~F.col(letter) | F.col(guess)["rejected"]).alias("rejected"),
    )
