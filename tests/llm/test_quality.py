import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from loomwork.llm import quality
from loomwork.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(grams)
    marked = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(marked)


def cases():
    r = random.Random(5)
    vocabulary = ["a", "the", "é#", "日本", "x|y", "\x0b", "\n", "\n\n", " ", "A!", "7"]
    out = ["".join(r.choice(vocabulary) + r.choice([" ", "", "\n"]) for _ in range(r.randint(0, 120))) for _ in range(400)]
    return [*out, None, "", "\n", " a", "a\na\n a\na", "one two " * 500, "line\r\nline\r\nline", "x" * 100_000]


def test_counts():
    texts = cases()
    c = quality.text_counts(*W.string_buffers(pa.array(texts)))
    got = list(zip(*(c[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))))
    assert got == [brute(t) for t in texts]


def test_judge(spark):
    r = random.Random(6)
    plain = lambda: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(r.randint(30, 200)))
    rows = [(i, plain(), "en", f"s{i % 2}", 0) for i in range(300)]
    rows += [(1000 + i, " ".join(w.upper() + "###" for w in plain().split()), "en", "s0", 0) for i in range(10)]
    rows += [(2000, None, None, None, 0), (2001, "", "en", "s1", 0), (2002, plain(), None, "rare", 0), (2002, plain(), None, "rare", 0), (2003, "few words", "en", "s0", 0), (2004, "a b c d e f g h i " * 30, "en", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key int")
    got = quality.judge(docs).collect()
    assert len(got) == len(rows)
    for row in got:
        if row.doc_id < 1000 or row.doc_id == 2002:
            assert row.kept and not row.base_failed
        elif row.doc_id < 2000:
            assert not row.kept and not row.base_failed
        else:
            assert row.base_failed and not row.kept
    assert quality.judge(docs.limit(0)).collect() == []


def vectors(spark, groups):
    rows = [(i, k, x.tolist()) for k, xs in groups.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "doc_id long, key string, x array<double>")


def brute_mcd(x, seeds=300):
    """The least log determinant over many starts, each concentrated to its end on all rows."""
    r = np.random.default_rng(0)
    h = int(np.ceil(quality.SHARE * len(x)))
    floors = np.diag(np.square(quality.FLOOR))
    best = (np.inf, None, None)
    for _ in range(seeds):
        near = x[r.choice(len(x), quality.P + 1, replace=False)]
        last = np.inf
        while True:
            centre, cov = near.mean(0), quality.CONSISTENT * np.cov(near.T, bias=True) + floors
            det = np.linalg.slogdet(cov)[1]
            if det > last - 1e-9 and len(near) == h:
                break
            last = det if len(near) == h else np.inf
            d = np.einsum("ni,ij,nj->n", x - centre, np.linalg.inv(cov), x - centre)
            near = x[np.argsort(d, kind="stable")[:h]]
        if det < best[0]:
            best = (det, centre, cov)
    return best


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    mixed = rng.normal(0, 1, (quality.P, quality.P))
    groups = {
        "far": np.vstack([rng.normal(0, 1, (800, quality.P)), rng.normal(50, 1, (200, quality.P))]),
        "turned": np.vstack([rng.normal(0, 1, (600, quality.P)) @ mixed, rng.normal(0, 0.3, (150, quality.P)) + 6]),
        "plain": rng.normal(0, 1, (3000, quality.P)),
        "small": rng.normal(3, 2, (60, quality.P)),
    }
    got = {e.key: e for e in quality.estimates(vectors(spark, groups)).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        det, centre, cov = brute_mcd(x, 40 if k == "plain" else 300)
        assert abs(got[k].det - det) < 0.35, k  # whole bins hold somewhat more than SHARE
        near = lambda c, inv: np.einsum("ni,ij,nj->n", x - c, inv, x - c)
        mine = near(np.array(got[k].centre), np.array(got[k].inverse).reshape(quality.P, quality.P))
        assert np.mean((mine > quality.LIMIT) == (near(centre, np.linalg.inv(cov)) > quality.LIMIT)) > 0.98, k
    assert np.abs(np.array(got["far"].centre)).max() < 0.3
    whole = np.array(got["plain"].inverse).reshape(quality.P, quality.P)
    assert np.allclose(np.diag(np.linalg.inv(whole)), 1 + np.square(quality.FLOOR), atol=0.2)  # consistent


def test_chi_squared():
    assert abs(quality.chi2_below(7.344, 8) - 0.5) < 1e-4 and abs(quality.chi2_quantile(0.975, 7) - 16.0128) < 1e-3 and abs(quality.LIMIT - 24.3219) < 1e-3


def test_small_cells_follow_their_language(spark):
    """A cell's verdicts change gradually with its size: one row, ten rows or a hundred like the language's are judged alike."""
    r = random.Random(8)
    plain = lambda: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(r.randint(30, 200)))
    rows = [(i, plain(), "en", "large") for i in range(400)]
    for n in (1, 10, 99, 101):
        rows += [(1000 * n + i, plain(), "en", f"s{n}") for i in range(n)]
    rows += [(500_000, " ".join(w.upper() + "###" for w in plain().split()), "en", "lone")]
    got = {x.doc_id: x.kept for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got.pop(500_000) is False and all(got.values())


def test_copies_alone(spark):
    text = "one two three four five six seven eight nine ten eleven twelve a b c d e f g h i j k l"
    docs = spark.createDataFrame([(1, text, "en", "s")] * 3000, "doc_id long, text string, lang string, source string")
    assert all(x.kept and x.distance < 1e-6 for x in quality.judge(docs).collect())
