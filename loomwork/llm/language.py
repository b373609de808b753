"""Language identification by interpolated Kneser-Ney character models.

Per language, counts of character n-grams within words (a mark before and
behind each word) give an interpolated Kneser-Ney model.  A group of languages
is stored as sorted arrays of n-gram hashes, with each language's share of the
probability beside each hash, so one search serves all of them.  The language
of lowest cross-entropy per character wins; words' bits are cached in each
Python worker.

The models are fitted on a bounded sample of labelled rows: of each language
at most SAMPLE_ROWS, drawn by hash, whole texts.  At most CALIBRATION_ROWS
further ones, on which nothing is fitted, calibrate rejection, as they are and
with their letters shuffled, which makes noise of the same letters.  A text is
rejected when its bits per character exceed the middle between the 95th
percentile of texts of its language and the 5th of their noise, but never below
the median plus SPREADS times the distance from there to the 95th percentile.
Languages with fewer than LEAST calibration rows use the highest limit of the
others, or that of all rows together.

Only words of letters count.  Words that mix letters with digits or
underscores (codes, keys, addresses) are of no language, and count only in a
text that has no others.

Languages are read in groups of at most MODEL_BYTES; where there are more than
one, each takes a pass over the texts.  The driver holds the languages' names
and one group at a time.

Defined results: a null text or one without a letter is ``und`` with score 0
and rejected; where nothing can be learned, every text is ``und`` and only
those without a letter are rejected.  Rows of one doc_id stay rows.
"""

from __future__ import annotations

import io
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm import words as W
from loomwork.llm import worker
from loomwork.plans import storage

ORDER = 5
#: At most so many rows of each language that models are fitted on, and that calibrate rejection.
SAMPLE_ROWS, CALIBRATION_ROWS = 300, 150
#: Distances from the median to the 95th percentile that a text may be off; the least such distance; rows that calibrate a language by itself.
SPREADS, LEAST_SPREAD, LEAST = 2.0, 0.5, 10
#: Few characters say little: a text's bits may exceed the limit by so many bits in all.
SHORT_BITS = 32.0
#: Probability of a character that no model has seen.
FLOOR = 2.0**-20
#: Divides the difference in bits per character in the score.
TEMPERATURE = 0.25
CACHE_ENTRIES = 100_000
#: At most so many languages' counts are broadcast; more are joined.
LANGUAGES_TO_SEND = 10_000
#: Bytes of the models that a pass over the texts reads by.
MODEL_BYTES = 32 << 20
WORD, LETTERS = re.compile(r"\b[^\W\d_]+\b"), re.compile(r"[^\W\d_]+")


def _words(text: str) -> list[str]:
    low = text.lower()
    words = WORD.findall(low)
    return words if any(map(str.isalpha, words)) else LETTERS.findall(low)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def gram_keys(words: list[str], n: int) -> list[np.ndarray]:
    """For orders 1 to n, the hash of the gram that ends at each character of each marked word (its first mark aside), and at order 0 the word's index.

    Grams that would reach before the word's first mark are cut there, so they
    have the order they can have; their hash tells their length.
    """
    text = "\x02" + "\x03\x02".join(words) + "\x03"
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    begin = codes == 2
    ends = np.flatnonzero(~begin)
    start = np.maximum.accumulate(np.where(begin, np.arange(len(codes)), 0))[ends]
    letters = W.mix(codes + np.uint64(0x9E3779B97F4A7C15))
    keys, running = [np.cumsum(begin)[ends] - 1], np.zeros(len(ends), np.uint64)
    for k in range(n):
        at = ends - k
        ok = at >= start
        running = np.where(ok, W.mix(running * np.uint64(0x9FB21C651E98DF25) + letters[np.maximum(at, 0)]), running)
        keys.append(running)
    return keys


def context_keys(words: list[str], n: int) -> list[np.ndarray]:
    """Like gram_keys, but for the n - 1 characters before each one (orders 0 to n - 1)."""
    text = "\x02" + "\x03\x02".join(words) + "\x03"
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    begin = codes == 2
    ends = np.flatnonzero(~begin)
    start = np.maximum.accumulate(np.where(begin, np.arange(len(codes)), 0))[ends]
    letters = W.mix(codes + np.uint64(0x9E3779B97F4A7C15))
    keys, running = [np.zeros(len(ends), np.uint64)], np.zeros(len(ends), np.uint64)
    for k in range(1, n):
        at = ends - k
        ok = at >= start
        running = np.where(ok, W.mix(running * np.uint64(0x9FB21C651E98DF25) + letters[np.maximum(at, 0)]), running)
        keys.append(running)
    return keys


class Model:
    """Interpolated Kneser-Ney over one language.

    Per order: sorted gram hashes, each with its discounted share of its
    context's total; and sorted context hashes, each with the weight of the
    order below.  So a probability is weight * (that of the order below) + share.
    """

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]], contexts: list[tuple[np.ndarray, np.ndarray]], base: float):
        self.grams, self.contexts, self.base = grams, contexts, base

    @classmethod
    def fit(cls, texts: list[str]) -> "Model":
        words = [w for t in texts for w in _words(t)]
        if not words:
            words = [""]
        g, c = gram_keys(words, ORDER), context_keys(words, ORDER)
        # distinct grams of the highest order with counts; lower orders count distinct left extensions
        key, first, count = np.unique(g[ORDER], return_index=True, return_counts=True)
        grams, contexts = [], []
        at = first
        for n in range(ORDER, 0, -1):
            once, twice = (count == 1).sum(), (count == 2).sum()
            d = min(max(float(once / (once + 2 * twice)) if once else 0.5, 0.1), 0.9)
            ctx, inverse = np.unique(c[n - 1][at], return_inverse=True)
            total, kinds = np.bincount(inverse, count), np.bincount(inverse)
            grams.append((key, ((count - d) / total[inverse]).astype(np.float32)))
            contexts.append((ctx, (d * kinds / total).astype(np.float32)))
            if n > 1:
                lower = g[n - 1][at]
                key, first, count = np.unique(lower, return_index=True, return_counts=True)
                at = at[first]
        return cls(grams[::-1], contexts[::-1], max(FLOOR, 0.1 / (len(grams[-1][0]) + 1)))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]], other: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of several languages and a column of values for each of these; other where it has no such hash."""
    keys = np.unique(np.concatenate([k for k, _ in parts]))
    values = np.full((len(keys) + 1, len(parts)), other, np.float32)  # the last row is of hashes that none has
    for i, (k, v) in enumerate(parts):
        values[np.searchsorted(keys, k), i] = v
    return keys, values


def find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Rows of values at wanted in sorted keys; the last row where it's not there."""
    if not len(keys):
        return values[np.full(len(wanted), -1)]
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return values[np.where(keys[at] == wanted, at, -1)]


class Identifier:
    """Several languages' models in one, with a cache of words' bits."""

    def __init__(self, names: list[str], models: list[Model]):
        self.names = names
        self.base = np.array([m.base for m in models])
        self.grams = [_merged([m.grams[n] for m in models], 0.0) for n in range(ORDER)]
        self.contexts = [_merged([m.contexts[n] for m in models], 1.0) for n in range(ORDER)]
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, len(names) + 1))  # bits under each language, characters

    def entropies(self, words: list[str]) -> np.ndarray:
        """Bits of each word under each language, and its characters with the closing mark; all 0 for a word without a letter."""
        g, c = gram_keys(words, ORDER), context_keys(words, ORDER)
        own = g[0]
        # the same gram often comes again: each distinct one is looked up once
        _, first, inverse = np.unique(W.mix(g[ORDER] ^ (c[ORDER - 1] * np.uint64(0x9E3779B97F4A7C15))), return_index=True, return_inverse=True)
        p = np.tile(self.base, (len(first), 1))
        for n in range(ORDER):
            p = p * find(*self.contexts[n], c[n][first]) + find(*self.grams[n], g[n + 1][first])
        bits = -np.log2(np.maximum(p, FLOOR))
        out = np.zeros((len(words), len(self.names) + 1))
        for i in range(len(self.names)):
            out[:, i] = np.bincount(own, bits[inverse, i], minlength=len(words))
        out[:, -1] = np.bincount(own, minlength=len(words))
        out[[not (w.isalpha() or any(map(str.isalpha, w))) for w in words]] = 0
        return out

    def bits(self, texts: list[str]) -> np.ndarray:
        """Each text's bits under each language and its characters."""
        words, first = [], [0]
        for t in texts:
            words += _words(t)
            first.append(len(words))
        if len(self.place) > CACHE_ENTRIES:
            self.place.clear()
        new = list({w for w in words if w not in self.place})
        if new:
            a, b = len(self.place), len(self.place) + len(new)
            if b > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((b, self.rows.shape[1]))])
            for i in range(0, len(new), 5_000):
                self.rows[a + i : min(a + i + 5_000, b)] = self.entropies(new[i : i + 5_000])
            self.place.update(zip(new, range(a, b)))
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        text = np.repeat(np.arange(len(texts)), np.diff(first))
        return np.stack([np.bincount(text, self.rows[at, i], minlength=len(texts)) for i in range(self.rows.shape[1])], 1)


def _batches(texts: list[str], limit: int = 1 << 21):
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= limit):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


class Languages:
    """Fitted models in groups (names, models as bytes), and limits of bits per character above which a text of each language is rejected."""

    def __init__(self, groups: list[tuple[list[str], object]], key: str):
        self.groups, self.limits, self.key = groups, {}, key


def _pack(m: Model) -> bytes:
    out = io.BytesIO()
    arrays = {f"{kind}{n}{k}": x for kind, orders in (("g", m.grams), ("c", m.contexts)) for n, pair in enumerate(orders) for k, x in enumerate(pair)}
    np.savez(out, base=m.base, **arrays)
    return out.getvalue()


def _unpack(raw: bytes) -> Model:
    z = np.load(io.BytesIO(raw))
    return Model([(z[f"g{n}0"], z[f"g{n}1"]) for n in range(ORDER)], [(z[f"c{n}0"], z[f"c{n}1"]) for n in range(ORDER)], float(z["base"]))


def _sample(docs: DataFrame) -> DataFrame:
    """lang, text, part (fit or calibrate) of the sampled labelled rows; a language of one text has it fitted on."""
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    rows = storage.written(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "languages")
    rows = F.broadcast(rows) if storage.small_enough(rows, LANGUAGES_TO_SEND) else rows
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    # twice the rows needed, then the first of these; repeated rows fall together
    drawn = labelled.join(rows, "lang").withColumn("draw", draw).where(F.col("draw") * F.col("rows") < 2.0 * (SAMPLE_ROWS + CALIBRATION_ROWS)).select("lang", "text", "draw").distinct()
    order = Window.partitionBy("lang").orderBy("draw", F.xxhash64("text"))
    # every third row calibrates
    placed = drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SAMPLE_ROWS + CALIBRATION_ROWS)
    return placed.select("lang", "text", F.when(F.col("place") % 3 == 0, "calibrate").otherwise("fit").alias("part"))


def _groups(models: DataFrame) -> list[tuple[list[str], object]]:
    """(names, broadcast bytes of their models) of groups of languages of at most MODEL_BYTES, or one language each."""
    groups, size = [], 0
    for r in models.select("lang", F.octet_length("model").alias("size")).orderBy("lang").collect():
        if not groups or size + r["size"] > MODEL_BYTES:
            groups.append([])
            size = 0
        groups[-1].append(r["lang"])
        size += r["size"]
    out = []
    for names in groups:
        raw = {r["lang"]: bytes(r["model"]) for r in models.where(F.col("lang").isin(names)).collect()}  # bounded by MODEL_BYTES
        out.append((names, models.sparkSession.sparkContext.broadcast([raw[n] for n in names])))
    return out


def _with_noise(batches):
    """Texts (lang, text) as (0, text, lang) and, with their letters shuffled, as (1, text, lang)."""
    for batch in batches:
        lang = batch.column(0).to_pylist()
        texts = [" ".join(_words(t or "")) for t in batch.column(1).to_pylist()]
        noise = []
        for t in texts:
            letters = np.array(list(t))
            at = np.flatnonzero(letters != " ")
            letters[at] = letters[np.random.Generator(np.random.PCG64(len(t))).permutation(at)]
            noise.append("".join(letters.tolist()))
        flag = [0] * len(texts) + [1] * len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(flag, pa.int64()), pa.array(texts + noise, pa.string()), pa.array(lang * 2, pa.string())], names=["doc_id", "text", "keep"])


def _limit(row) -> float | None:
    """Bits per character above which a text is rejected; None where nothing is known."""
    if not row["known"]:
        return None
    middle, high = row["known"]
    least = middle + SPREADS * max(LEAST_SPREAD, high - middle)
    return max(least, (high + row["noise"]) / 2) if row["noise"] is not None else least


def fit(docs: DataFrame) -> Languages:
    """Models of docs (doc_id, text, lang), from labelled rows that are not held out."""
    sample = storage.written(_sample(docs), "sample")

    def train(table):
        texts = ["" if t is None else t for t in table.column("text").to_pylist()]
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()]), "model": pa.array([_pack(Model.fit(texts))], pa.binary())})

    models = storage.written(sample.where("part = 'fit'").groupBy("lang").applyInArrow(train, "lang string, model binary"), "models")
    out = Languages(_groups(models), uuid.uuid4().hex)
    # doc_id says whether a text's letters are shuffled; written, as two Python steps in a task take two workers
    held = storage.written(sample.where("part = 'calibrate'").select("lang", "text").mapInArrow(_with_noise, "doc_id long, text string, keep string"), "held")
    seen = storage.written(_bits(held, out).where("chars > 0 and (doc_id = 1 or keep = lang_pred)"), "calibration")
    q = (F.count(F.when(F.col("doc_id") == 0, 1)).alias("rows"), F.expr("percentile(bits, array(0.5, 0.95)) filter (where doc_id = 0)").alias("known"), F.expr("percentile(bits, 0.05) filter (where doc_id = 1)").alias("noise"))
    own = {r["keep"]: _limit(r) for r in seen.groupBy("keep").agg(*q).where(F.col("rows") >= LEAST).collect()}
    whole = _limit(seen.agg(*q).first())
    other = max(own.values(), default=whole)
    out.limits = {n: own.get(n, other) for names, _ in out.groups for n in names if other is not None}
    storage.drop(seen, held)
    storage.drop(sample, models)
    return out


def _reader(sent, names: list[str], key: str) -> Identifier:
    """This worker's identifier of the sent models."""
    kept = worker.cache("language")
    if key not in kept:
        kept.clear()
        kept[key] = Identifier(names, [_unpack(x) for x in sent.value])
    return kept[key]


def _best(own: Identifier, column) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Prediction, weight of all languages beside it (for the score), bits per character and characters of each text of an Arrow column."""
    texts = ["" if t is None else t for t in column.to_pylist()]
    total = np.concatenate([own.bits(texts[i:j]) for i, j in _batches(texts)] or [np.zeros((0, len(own.names) + 1))])
    chars = total[:, -1]
    h = total[:, :-1] / np.maximum(chars, 1)[:, None]
    best = h.argmin(1)
    low = h[np.arange(len(h)), best]
    weight = np.exp2((low[:, None] - h) / TEMPERATURE).sum(1)
    return [own.names[b] if c else "und" for b, c in zip(best.tolist(), chars.tolist())], weight, low, chars.astype(np.int64)


def _bits(docs: DataFrame, languages: Languages) -> DataFrame:
    """doc_id, keep, lang_pred, score, bits (per character), chars, of docs (doc_id, text, keep)."""
    worker.small_batches(docs.sparkSession)
    out = docs.select("doc_id", "text", "keep", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("weight"), F.lit(float("inf")).alias("bits"), F.lit(0).cast("long").alias("chars"))
    schema = "doc_id long, text string, keep string, lang_pred string, weight double, bits double, chars long"
    for g, (names, sent) in enumerate(languages.groups):
        last = g == len(languages.groups) - 1

        def run(batches, names=names, sent=sent, key=f"{languages.key}/{g}", last=last):
            own = _reader(sent, names, key)
            for batch in batches:
                for k in range(0, batch.num_rows, 1000):
                    part = batch.slice(k, 1000)
                    pred, weight, low, chars = _best(own, part.column(1))
                    # the lowest so far and this group's
                    old, past, before = part.column(3).to_pylist(), part.column(4).to_numpy(), part.column(5).to_numpy()
                    both = np.minimum(low, before)
                    weight = weight * np.exp2((both - low) / TEMPERATURE) + past * np.exp2(np.where(past > 0, both - before, 0) / TEMPERATURE)
                    pred = [p if now else o for p, o, now in zip(pred, old, (low < before).tolist())]
                    text = pa.nulls(len(pred), pa.string()) if last else part.column(1)
                    yield pa.RecordBatch.from_arrays([part.column(0), text, part.column(2), pa.array(pred, pa.string()), pa.array(weight), pa.array(both), pa.array(chars)], names=["doc_id", "text", "keep", "lang_pred", "weight", "bits", "chars"])

        out = out.mapInArrow(run, schema)
    score = F.when(F.col("chars") > 0, 1 / F.col("weight")).otherwise(F.lit(0.0))
    return out.select("doc_id", "keep", "lang_pred", score.alias("score"), "bits", "chars")


def accepted(docs: DataFrame, languages: Languages) -> DataFrame:
    """The rows of docs (any columns, text among them) that are not rejected, by the rule of predict().

    A text is rejected where it exceeds the limit of the language that fits
    best; with more than one group of languages, it is judged by predict().
    """
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if not languages.groups:
        return docs.where(letter)
    if len(languages.groups) > 1:
        return _accepted_in_passes(docs, languages)
    (names, sent), key, limits, at = languages.groups[0], languages.key + "/0", languages.limits, docs.columns.index("text")
    worker.small_batches(docs.sparkSession)

    def run(batches):
        own = _reader(sent, names, key)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                pred, _, low, chars = _best(own, part.column(at))
                most = np.array([limits.get(p, np.inf) for p in pred])
                yield part.filter(pa.array((chars > 0) & ~(low > most + SHORT_BITS / np.maximum(chars, 1))))

    return docs.mapInArrow(run, docs.schema)


def _accepted_in_passes(docs: DataFrame, languages: Languages) -> DataFrame:
    """accepted() over several groups of languages: rows are judged by their texts' hashes."""
    key = [F.xxhash64(docs["text"]), F.xxhash64(F.lit(1), docs["text"])]
    texts = docs.select(key[0].alias("doc_id"), "text", key[1].cast("string").alias("keep"))
    good = _bits(texts, languages).where(~_rejected(languages)).select(F.col("doc_id").alias("good_a"), F.col("keep").alias("good_b")).distinct()
    return docs.join(good, (key[0] == good["good_a"]) & (key[1].cast("string") == good["good_b"]), "left_semi")


def _rejected(languages: Languages) -> Column:
    """Whether a row of _bits() is rejected."""
    most = F.create_map(*(F.lit(x) for kv in languages.limits.items() for x in kv))[F.col("lang_pred")] if languages.limits else F.lit(None).cast("double")
    return (F.col("chars") == 0) | F.coalesce(F.col("bits") > most + SHORT_BITS / F.greatest(F.col("chars"), F.lit(1)), F.lit(False))


def predict(docs: DataFrame, languages: Languages) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits, rejected of every row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("string").alias("keep"))
    if not languages.groups:
        return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits"), (~F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).alias("rejected"))
    found = _bits(rows, languages)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.when(F.col("chars") > 0, F.col("bits")).otherwise(F.lit(0.0)).alias("bits"), _rejected(languages).alias("rejected"))


def identify(docs: DataFrame) -> DataFrame:
    """predict() of all rows with models fitted on docs (doc_id, text, lang)."""
    return predict(docs, fit(docs))
