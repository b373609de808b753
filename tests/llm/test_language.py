import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from loomwork.llm import language


def slow(texts, n):
    """Probability of a character after a context, by interpolated Kneser-Ney over dictionaries."""
    marked = ["\x02" + w + "\x03" for t in texts for w in t.split()]
    counts = {n: {}}
    for w in marked:
        for e in range(1, len(w)):
            gram = w[max(0, e - n + 1) : e + 1]
            counts[n][gram] = counts[n].get(gram, 0) + 1
    # lower orders count distinct grams of the next order that end in them; a gram cut at a word's first mark ends in itself
    for k in range(n - 1, 0, -1):
        counts[k] = {}
        for gram in counts[k + 1]:
            counts[k][gram[-k:]] = counts[k].get(gram[-k:], 0) + 1
    facts = {}
    for k in range(1, n + 1):
        once, twice = (sum(c == x for c in counts[k].values()) for x in (1, 2))
        d = min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.9)
        total, kinds = {}, {}
        for gram, c in counts[k].items():
            total[gram[:-1]] = total.get(gram[:-1], 0) + c
            kinds[gram[:-1]] = kinds.get(gram[:-1], 0) + 1
        facts[k] = d, total, kinds

    def p(word, e):
        out = max(language.FLOOR, 0.1 / (len(counts[1]) + 1))
        for k in range(1, n + 1):
            gram = word[max(0, e - k + 1) : e + 1]
            d, total, kinds = facts[k]
            if gram[:-1] in total:
                out = (max(counts[k].get(gram, 0) - d, 0) + d * kinds[gram[:-1]] * out) / total[gram[:-1]]
        return max(out, language.FLOOR)

    return p


def test_against_slow_kneser_ney():
    r = random.Random(1)
    texts = [[" ".join("".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(300)) for _ in range(2)] for letters in ("abcd", "bcdeé", "aaaab")]
    own = language.Identifier(["x", "y", "z"], [language._unpack(language._pack(language.Model.fit(t))) for t in texts])
    words = ["", *texts[0][0].split()[:60], "zz", "abézc", "aaaabaaaa", "ébcd" * 5]
    got = own.entropies(words)
    for i, t in enumerate(texts):
        p = slow(t, language.ORDER)
        for k, w in enumerate(words):
            m = "\x02" + w + "\x03"
            want = -sum(np.log2(p(m, e)) for e in range(1, len(m))) if w else 0.0
            assert abs(got[k, i] - want) < 1e-3 * max(want, 1), (t[0][:10], w)
    p = slow(texts[0], language.ORDER)
    for prefix in ("", "a", "ab", "dcb", "zz"):
        assert 0.85 < sum(p("\x02" + prefix + c, len(prefix) + 1) for c in [*"abcd", "\x03"]) < 1.0001  # the rest is for characters never seen


def test_noise_is_rejected(spark):
    r = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    noise = [(10**6 + i, "".join(r.choice("etaoinshrdlucmfwypvbgk    ") for _ in range(r.choice([80, 300, 2000]))), None) for i in range(60)]
    both = docs.unionByName(spark.createDataFrame(noise, "doc_id long, text string, lang string"))
    got = {x.doc_id: x.rejected for x in language.identify(both).collect()}
    assert all(got[d] == (d >= 10**6) for d in got)


def test_many_languages_in_groups(spark, monkeypatch):
    r = random.Random(5)
    rows = []
    for k in range(12):  # each has its own few letters
        letters = [chr(0x4E00 + 40 * k + i) for i in range(5)] + list("ab")
        rows += [(100 * k + i, " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(30)), f"l{k:02}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one = sorted((x.doc_id, x.lang_pred, round(x.score, 9), round(x.bits, 9), x.rejected) for x in language.identify(docs).collect())
    assert [(d, lang) for d, lang, *_ in one] == sorted((d, lang) for d, _, lang in rows)
    monkeypatch.setattr(language, "MODEL_BYTES", 40_000)
    models = language.fit(docs)
    assert len(models.groups) > 2
    assert sorted((x.doc_id, x.lang_pred, round(x.score, 9), round(x.bits, 9), x.rejected) for x in language.predict(docs, models).collect()) == one
    odd = docs.unionByName(spark.createDataFrame([(9000, "ζζζ ηηη θθθ " * 40, None), (9001, None, None), (9002, rows[0][1], "l03"), (9002, rows[0][1], "l03")], docs.schema))
    assert sorted(x.doc_id for x in language.accepted(odd, models).collect()) == sorted([d for d, *_, no in one if not no] + [9002, 9002] * (not one[0][-1]))


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "123", None), (3, None, None)], "doc_id long, text string, lang string")
    assert sorted((x.doc_id, x.lang_pred, x.score, x.rejected) for x in language.identify(docs).collect()) == [(1, "und", 0.0, False), (2, "und", 0.0, True), (3, "und", 0.0, True)]
    assert [x.doc_id for x in language.accepted(docs, language.fit(docs)).collect()] == [1]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in language.identify(docs.drop("source")).collect()}
    true = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(rows) == len(true)
    for d, r in rows.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and not r.rejected
    out = [d for d in rows if rows[d].held_out]
    assert np.mean([rows[d].lang_pred == true[d] for d in out]) > 0.97


def test_odd_rows(spark):
    r = random.Random(2)
    word = lambda a: "".join(r.choice(a) for _ in range(r.randint(2, 8)))
    rows = [(i, " ".join(word("abcde" if i % 2 else "xyzvw") for _ in range(50)), "ab" if i % 2 else "xy", 0.5) for i in range(200)]
    rows += [(900, None, "ab", 0.0), (901, "", None, 0.0), (902, "123 ½ _ ### ²", "ab", 0.0), (903, "abcd", None, 0.0), (903, "abcd", None, 0.0), (904, "日本語のテキスト" * 50, None, 0.0), (905, "abc " * 60_000, None, 0.0), (906, "ab1cd2 ½", None, 0.0), (907, "abcd edcba 6cfd1f1f244d4c4c327ecfd8fd9898497c475388 bead", None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = language.identify(docs).collect()
    assert len(got) == len(rows)
    by = {x.doc_id: x for x in got}
    for d in (900, 901, 902):
        assert (by[d].lang_pred, by[d].score, by[d].rejected) == ("und", 0.0, True)
    assert by[903].lang_pred == "ab" and not by[903].rejected and by[905].lang_pred == "ab"
    assert by[906].lang_pred in ("ab", "xy") and by[907].lang_pred == "ab" and not by[907].rejected
    assert by[904].rejected and by[904].lang_pred in ("ab", "xy")
    assert all(by[i].lang_pred == ("ab" if i % 2 else "xy") for i in range(200))
    assert language.identify(docs.limit(0)).collect() == []
    assert all(x.lang_pred == "und" for x in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect())
