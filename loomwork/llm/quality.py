"""Quality rules: counts per text, and robust multivariate outliers among them.

Each text gives a vector of transformed statistics.  Per language and source
(a cell), a minimum-covariance-determinant estimate gives centre and scatter:
the SHARE of the cell's rows whose covariance has the least determinant.  As
usual for large tables, many random starts take their first concentration
steps on at most START_ROWS rows of a cell; the best CANDIDATES of these take
one over all rows, and the best of them goes on over all rows until its
determinant settles (or after STEPS).  A step is one aggregate: rows fall in
bins of equal ratio of distance, and the nearest whole bins that hold SHARE of
the rows give the next estimate.

Scatters carry the factor that makes them consistent for normal data, and a
floor for each statistic.  A cell's estimate is drawn towards its language's,
and that towards the whole table's, with the weight of PRIOR rows; these are
sums of the cells' rows within the estimates.  So a cell's size changes verdicts
gradually.  A text is rejected when its squared Mahalanobis distance is beyond
the QUANTILE of the chi-squared distribution that normal data would follow.

Defined results: a null or blank text has counts of 0 and fails the base rule;
null languages and sources are cells of their own; repeated rows stay.  Texts
that fail the base rule by their length take no part in the estimates; where a
cell has no others, distance is null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm import words as W
from loomwork.llm import worker
from loomwork.plans import storage

WINDOW = 8
FEATURES = ("symbols", "upper", "digits", "marks", "dup_lines", "repeats", "word_len")
P = len(FEATURES)
#: Spread that each transformed statistic has at least, so that statistics which are nearly constant in a cell don't make every other value an outlier.
FLOOR = (0.12, 0.08, 0.20, 0.12, 0.35, 0.35, 0.12)
#: Share of rows within the estimate; rows, random starts and candidates of a cell's beginning; steps at most, and the fall of the logarithm of the determinant below which they end.
SHARE, START_ROWS, STARTS, CANDIDATES, STEPS, SETTLED = 0.75, 400, 40, 3, 30, 1e-3
#: Rows that the prior of a cell's estimate counts as; share of normal data that is not rejected.
PRIOR, QUANTILE = 50.0, 0.999
#: Bins of squared distances to a factor of two, and the outermost bins.
BINS, NEAR, FAR = 16, -160, 640

_CLASS = {name: np.zeros(256, bool) for name in ("symbol", "upper", "letter", "digit", "mark")}
_CLASS["symbol"][[ord(c) for c in "#*$%&|<>"]] = True
_CLASS["upper"][65:91] = True
_CLASS["letter"][[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CLASS["digit"][48:58] = True
_CLASS["mark"][[b for b in range(33, 127) if not chr(b).isalnum()]] = True
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, upper long, letters long, digits long, marks long"


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text."""
    out: dict[str, list[np.ndarray]] = {name: [] for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "upper", "letters", "digits", "marks")}
    for i, j in W.chunks(offsets):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        w = W.Words(part, off, lower=False)

        def per_text(flags: np.ndarray, off: np.ndarray = off) -> np.ndarray:
            total = np.zeros(len(flags) + 1, np.int64)
            np.cumsum(flags, out=total[1:])
            return np.diff(total[off])

        # a code point is a byte that doesn't continue one
        head = ((part & 0xC0) != 0x80) & ~W._IS_SPACE[part]
        n = w.counts()
        out["n_words"].append(n)
        out["word_chars"].append(per_text(head))
        for name, kind in (("n_symbols", "symbol"), ("upper", "upper"), ("digits", "digit"), ("marks", "mark")):
            out[name].append(per_text(_CLASS[kind][part]))
        out["letters"].append(per_text(_CLASS["letter"][part] & head))
        h = w.hashes()
        out["n_repeat_words"].append(_repeats(h, w.first))
        lines, dups = _lines(part, off)
        out["n_lines"].append(lines)
        out["n_dup_lines"].append(dups)
    return {k: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for k, v in out.items()}


def _repeats(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each text within windows that the text has twice or more."""
    grams = W.windows(hashes, WINDOW)
    out = np.zeros(len(first) - 1, np.int64)
    for r, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        m = b - a - WINDOW + 1
        if m < 2:
            continue
        g = grams[a : a + m]
        order = np.argsort(g)
        s = g[order]
        same = s[1:] == s[:-1]
        if not same.any():
            continue
        twice = np.zeros(m, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        mark = np.zeros(b - a + 1, np.int64)
        at = np.flatnonzero(twice)
        np.add.at(mark, at, 1)
        np.add.at(mark, at + WINDOW, -1)
        out[r] = int((np.cumsum(mark[:-1]) > 0).sum())
    return out


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those equal to an earlier line, of each text."""
    rows = len(offsets) - 1
    n = len(data)
    if not n:
        return np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < n]
    ends = np.append(starts[1:], n)
    # without its line feed
    ends = ends - ((ends > starts) & (data[ends - 1] == 10))
    solid = np.zeros(n + 1, np.int64)
    np.cumsum(~W._IS_SPACE[data], out=solid[1:])
    full = solid[ends] > solid[starts]
    starts, ends = starts[full], ends[full]
    text = np.searchsorted(offsets, starts, "right") - 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(W._TABLE[data] * W._power("p", W._P, n), out=total[1:])
    key = W.mix((total[ends] - total[starts]) * W._power("inv", W._P_INV, n)[starts] + (ends - starts).astype(np.uint64) * W._MIX[0]) if len(starts) else np.zeros(0, np.uint64)
    order = np.lexsort((key, text))
    same = (key[order][1:] == key[order][:-1]) & (text[order][1:] == text[order][:-1])
    return np.bincount(text, minlength=rows), np.bincount(text[order][1:][same], minlength=rows)


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every row of docs."""

    worker.small_batches(docs.sparkSession)

    def run(batches):
        worker.cache("quality")
        for batch in batches:
            data, offsets = W.string_buffers(batch.column(3))
            c = text_counts(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(x) for x in c.values())], names=["doc_id", "lang", "source", *c])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(lang as string) lang", "cast(source as string) source", "text").mapInArrow(run, f"doc_id long, lang string, source string, {COUNTS}")


def features() -> list[Column]:
    """The transformed statistics: roots of shares, which a count's noise moves alike at any share, and the log of the mean word length."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    shares = (F.col("n_symbols") / n, F.col("upper") / F.greatest("letters", F.lit(1)), F.col("digits") / chars, F.col("marks") / n, F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), F.col("n_repeat_words") / n)
    return [F.sqrt(s) for s in shares] + [F.log((chars + 5) / (n + 1))]


def _distance(x: str, centre: str, inverse: str) -> Column:
    """Squared Mahalanobis distance; inverse is a flat P x P matrix."""
    d = [F.col(x)[i] - F.col(centre)[i] for i in range(P)]
    return sum((d[i] * d[j] * F.col(inverse)[i * P + j] * (1 if i == j else 2) for i in range(P) for j in range(i, P)), F.lit(0.0))


def chi2_below(x: float, k: int) -> float:
    """Probability that a chi-squared variable of k degrees is below x (series of the incomplete gamma function)."""
    a, h = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= h / n
        total += term
    return total * math.exp(a * math.log(h) - h - math.lgamma(a))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 1e-9, 200.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_below(mid, k) < q else (low, mid)
    return low


#: Makes the covariance of the nearest SHARE of normal data that of all.
CONSISTENT = SHARE / chi2_below(chi2_quantile(SHARE, P), P + 2)
LIMIT = chi2_quantile(QUANTILE, P)


def scatter(n: float, sums: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter (without floors) of n rows within an estimate, by their sums and products (upper triangle, flat)."""
    mean = np.asarray(sums) / n
    cov = np.zeros((P, P))
    cov[np.triu_indices(P)] = np.asarray(products) / n
    cov = cov + np.triu(cov, 1).T - np.outer(mean, mean)
    return mean, CONSISTENT * cov


def solved(cov: np.ndarray) -> tuple[np.ndarray, float]:
    """Inverse and logarithm of the determinant of a scatter with floors."""
    full = cov + np.diag(np.square(FLOOR))
    return np.linalg.inv(full), float(np.linalg.slogdet(full)[1])


def concentrated(x: np.ndarray, centre: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One concentration step over rows x: the next centre, inverse and log determinant."""
    d = np.einsum("ni,ij,nj->n", x - centre, inverse, x - centre)
    h = max(1, math.ceil(SHARE * len(x)))
    near = x[np.argpartition(d, h - 1)[:h]]
    mean, cov = scatter(h, near.sum(0), (near.T @ near)[np.triu_indices(P)])
    return (mean, *solved(cov))


def starts(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """The CANDIDATES best estimates (centre, inverse, log determinant) from random subsets of P + 1 rows, and one from medians."""
    x = x[np.lexsort(x.T)]  # the order of rows doesn't matter
    r = np.random.Generator(np.random.PCG64(len(x)))
    low, mid, high = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    begun = [concentrated(x, mid, solved(np.diag(np.square((high - low) / 1.35)))[0])]
    for _ in range(STARTS):
        some = x[r.choice(len(x), min(P + 1, len(x)), replace=False)]
        begun.append(concentrated(x, some.mean(0), solved(np.cov(some.T, bias=True))[0]))
    begun = sorted((concentrated(x, *e[:2]) for e in begun), key=lambda e: e[2])[: 3 * CANDIDATES]
    out = []
    for e in begun:
        for _ in range(STEPS):
            after = concentrated(x, *e[:2])
            if abs(after[2] - e[2]) < SETTLED:
                break
            e = after
        out.append(e)
    return sorted(out, key=lambda e: e[2])[:CANDIDATES]


_ESTIMATE = "key string, candidate int, centre array<double>, inverse array<double>, det double"
_MOMENTS = f"{_ESTIMATE}, m double, sums array<double>, products array<double>, done boolean"
#: At most so many cells' estimates (under 2 kB each) are broadcast; more are joined.
CELLS_TO_SEND = 5_000


def _begin(vectors: DataFrame) -> DataFrame:
    """Candidates of each cell from at most START_ROWS of its rows; vectors: doc_id, key, x."""
    rows = storage.written(vectors.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), "rows")
    draw = F.pmod(F.xxhash64("doc_id", "x", F.lit("start")), F.lit(1 << 40)) / float(1 << 40)
    drawn = vectors.join(_send(rows), "key").withColumn("draw", draw).where(F.col("draw") * F.col("rows") < 2.0 * START_ROWS)
    # twice the rows needed, then the first of these
    few = drawn.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("draw"))).where(F.col("place") <= START_ROWS).select("key", "x")

    def run(table):
        best = starts(np.array(table.column("x").to_pylist()))
        key = table.column("key")[0].as_py()
        return pa.table({"key": [key] * len(best), "candidate": pa.array(range(len(best)), pa.int32()), "centre": [c.tolist() for c, _, _ in best], "inverse": [i.ravel().tolist() for _, i, _ in best], "det": [d for _, _, d in best]})

    out = storage.written(few.groupBy("key").applyInArrow(run, _ESTIMATE), "mcd")
    missing = rows.join(out.select("key"), "key", "left_anti").select("key")
    if not missing.isEmpty():
        # cells whose rows are copies of few texts may have none drawn: their means begin
        missing = storage.written(missing, "missing")
        mean = F.array(*(F.avg(F.col("x")[i]) for i in range(P)))
        unit = F.array(*(F.lit(1 / FLOOR[i] ** 2 if i == j else 0.0) for i in range(P) for j in range(P)))
        other = vectors.join(_send(missing), "key").groupBy("key").agg(mean.alias("centre")).select("key", F.lit(0).alias("candidate"), "centre", unit.alias("inverse"), F.lit(0.0).alias("det"))
        out = storage.written(out.unionByName(other), "mcd")
    storage.drop(rows)
    return out


def _send(estimates: DataFrame) -> DataFrame:
    return F.broadcast(estimates) if storage.small_enough(estimates, CELLS_TO_SEND * CANDIDATES) else estimates


def _step(vectors: DataFrame, now: DataFrame, first: bool = False) -> DataFrame:
    """The next estimate of each cell: a step for each of its candidates, the one of least determinant stays. first: determinants of before are of other rows."""
    met = vectors.join(_send(now.select("key", "candidate", "centre", "inverse", "det")), "key")
    d = _distance("x", "centre", "inverse")
    place = F.least(F.greatest(F.floor(F.log2(d + 1e-12) * BINS), F.lit(NEAR)), F.lit(FAR)).cast("int")
    products = [F.sum(F.col("x")[i] * F.col("x")[j]) for i in range(P) for j in range(i, P)]
    binned = met.withColumn("bin", place).groupBy("key", "candidate", "bin").agg(F.first("det").alias("det"), F.count(F.lit(1)).alias("n"), *(F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(P)), *(p.alias(f"p{k}") for k, p in enumerate(products)))

    def run(table):
        rows = sorted(zip(*(table.column(c).to_pylist() for c in table.column_names)))
        best = None
        for candidate in sorted({r[1] for r in rows}):
            own = [r for r in rows if r[1] == candidate]
            n = np.array([r[4] for r in own], float)
            use = int(np.searchsorted(np.cumsum(n), SHARE * n.sum() - 1e-9)) + 1
            total = np.array([r[5:] for r in own[:use]], float).sum(0)
            m = n[:use].sum()
            mean, cov = scatter(m, total[:P], total[P:])
            inverse, det = solved(cov)
            if best is None or det < best[4]:
                best = (own[0][0], 0, mean.tolist(), inverse.ravel().tolist(), det, m, total[:P].tolist(), total[P:].tolist(), not first and det > own[0][3] - SETTLED)
        names = [f.split()[0] for f in _MOMENTS.split(", ")]
        types = (pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.bool_())
        return pa.table([pa.array([v], t) for v, t in zip(best, types)], names=names)

    return binned.groupBy("key").applyInArrow(run, _MOMENTS)


def estimates(vectors: DataFrame) -> DataFrame:
    """key, lang, centre, inverse of every cell; vectors: doc_id, key, lang, x (array of P)."""
    begin = _begin(vectors)
    now = storage.written(_step(vectors, begin, first=True), "mcd")
    storage.drop(begin)
    for _ in range(STEPS):
        # settled cells stay as they are
        going = now.where("not done")
        if going.isEmpty():
            break
        after = storage.written(_step(vectors, going).unionByName(now.where("done")), "mcd")
        storage.drop(now)
        now = after
    return now


def _drawn(cells: DataFrame, langs: DataFrame) -> DataFrame:
    """key, centre, inverse of cells, drawn towards their languages' and the whole table's."""
    def totals():
        return (F.sum("m").alias("m"), F.array(*(F.sum(F.col("sums")[i]) for i in range(P))).alias("sums"), F.array(*(F.sum(F.col("products")[k]) for k in range(P * (P + 1) // 2))).alias("products"))

    named = cells.join(langs, "key")
    whole = named.agg(*totals()).first()  # one row
    if whole is None or whole["m"] is None:
        return cells.select("key", "centre", "inverse").limit(0)
    top = scatter(whole["m"], whole["sums"], whole["products"])
    by = named.groupBy("lang").agg(*(c.alias(f"l_{n}") for c, n in zip(totals(), ("m", "sums", "products"))))
    both = named.join(by, named["lang"].eqNullSafe(by["lang"])).select("key", "m", "sums", "products", "l_m", "l_sums", "l_products")

    def towards(n, sums, products, prior):
        centre, cov = scatter(n, sums, products)
        w = n / (n + PRIOR)
        return w * centre + (1 - w) * prior[0], w * cov + (1 - w) * prior[1]

    def run(batches):
        for batch in batches:
            centre, inverse = [], []
            for m, s, p, lm, ls, lp in zip(*(batch.column(i).to_pylist() for i in range(1, 7))):
                c, cov = towards(m, s, p, towards(lm, ls, lp, top))
                centre.append(c.tolist())
                inverse.append(solved(cov)[0].ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(centre, pa.list_(pa.float64())), pa.array(inverse, pa.list_(pa.float64()))], names=["key", "centre", "inverse"])

    return both.mapInArrow(run, "key string, centre array<double>, inverse array<double>")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, distance (squared Mahalanobis) and kept of every row of docs (doc_id, text, lang, source)."""
    name = lambda col: F.concat(F.when(F.col(col).isNull(), "n").otherwise("v"), F.coalesce(F.hex(F.col(col)), F.lit("")))
    c = storage.written(counts(docs).withColumn("x", F.array(*features())).withColumn("key", F.concat(name("lang"), F.lit("/"), name("source"))), "counts")
    # short texts fail the base rule whatever their statistics; these are noise for the estimates
    vectors = c.where("n_words >= 20").select("doc_id", "key", "x")
    cells = estimates(vectors)
    final = storage.written(_drawn(cells, c.where("n_words >= 20").select("key", "lang").distinct()), "cells")
    storage.drop(cells)
    out = c.join(F.broadcast(final) if storage.small_enough(final, CELLS_TO_SEND) else final, "key", "left").withColumn("distance", _distance("x", "centre", "inverse"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "distance", (~failed & ~F.coalesce(F.col("distance") > LIMIT, F.lit(False))).alias("kept"))
