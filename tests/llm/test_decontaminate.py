import math
import random
import re

import numpy as np
from loomwork.llm import decontaminate as D


def words(r, n, size=400):
    return [f"w{int(size * r.random() ** 2)}x" for _ in range(n)]


def bm25(items, text):
    """Ids of the items with a unit whose BM25 against some passage of text is at least THRESHOLD of its score against itself, from the words alone."""
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    units = [(i, w[a : a + D.UNIT]) for i, t in items for w in [split(t)] for a in range(0, len(w), D.UNIT)]
    mean = sum(len(u) for _, u in units) / len(units)
    df = {}
    for _, u in units:
        for t in set(u):
            df[t] = df.get(t, 0) + 1
    words, out = split(text), set()
    for a in range(0, len(words), D.STRIDE):
        passage = set(words[a : a + 2 * D.STRIDE])
        for i, u in units:
            norm = D.K1 * (1 - D.B + D.B * len(u) / mean)
            impact = {t: math.log(1 + (len(units) - df[t] + 0.5) / (df[t] + 0.5)) * u.count(t) * (D.K1 + 1) / (u.count(t) + norm) for t in set(u)}
            if sum(x for t, x in impact.items() if t in passage) >= (D.THRESHOLD - 1e-9) * sum(impact.values()):
                out.add(i)
    return out


def brute(index, text):
    """Units at or above the threshold, of every passage of a text."""
    h = D.hashed_words([text])[0]
    out = set()
    n = -(-len(h) // D.STRIDE)
    for c in range(n):
        terms = np.unique(h[c * D.STRIDE : (c + 2) * D.STRIDE])
        at = np.searchsorted(index.vocabulary, terms)
        for u in range(len(index.owner)):
            score = 0.0
            for k, t in zip(at, terms):
                if k < len(index.vocabulary) and index.vocabulary[k] == t:
                    a, b = index.all.first[k], index.all.first[k + 1]
                    score += index.all.impact[a:b][index.all.unit[a:b] == u].sum()
            if score >= D.THRESHOLD:
                out.add(int(index.ids[index.owner[u]]))
    return out


def test_pruning_loses_nothing(monkeypatch):
    monkeypatch.setattr(D, "QUESTION", 0.0)
    monkeypatch.setattr(D, "ANSWER", 0.0)
    monkeypatch.setattr(D, "SHORT_ITEM", 0)
    r = random.Random(3)
    items = [(i, " ".join(words(r, r.randint(3, 150)))) for i in range(30)]
    index = D.Index(items)
    for _ in range(40):
        text = words(r, r.randint(0, 300))
        for _ in range(r.randint(0, 2)):
            item = r.choice(items)[1].split()
            a = r.randint(0, len(item) // 2)
            text[r.randint(0, len(text)) :][:0] = item
            text += item[a : a + r.randint(3, 90)]
        text = " ".join(text)
        data = np.frombuffer(text.encode(), np.uint8)
        got = {x[1] for x in index.search(data, np.array([0, len(data)]))}
        assert got == brute(index, text) == bm25(items, text)


def test_planted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = {r.item_id: norm(r.text) for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in norm(r.text)}
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()}
    assert want and want <= got and len(got - want) <= 1
    kept = {r.doc_id for r in D.clean(docs, bench).collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()} - {d for d, _ in got}


def test_odd_rows(spark):
    item = "Which river is the longest of all rivers in the northern part of the country?\nAnswer: the winding silver brook near the old mill"
    bench = spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "", 0), (4, "?!", 0), (5, "two words", 0), (5, "two words", 0)], "item_id long, text string, doc_id int")
    filler = "nothing of this kind stands here at all "
    rows = [(1, None), (2, ""), (3, filler * 20 + item.upper() + filler * 20), (3, filler * 20 + item.upper() + filler * 20), (4, filler * 30), (5, item.split("\n")[0]), (6, filler * 20_000 + item), (7, "here are two words alone")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, score string")
    got = sorted((r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect())
    assert [x for x in got if x[1] == 1] == [(3, 1), (3, 1), (6, 1)]
    assert {x for x in got if x[1] != 1} == {(7, 5)}
    assert D.contaminated(docs.limit(0), bench).collect() == [] and D.contaminated(docs, bench.limit(0)).collect() == []
    assert sorted(r.doc_id for r in D.clean(docs, bench).collect()) == [1, 2, 4, 5] and D.clean(docs, bench.limit(0)).count() == len(rows)


def test_case_and_marks(spark):
    item = "Ñandú élève übung señor garçon über straße dónde está la época añil corazón"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item.upper().replace("STRASSE", "straße")), (2, "«" + item.replace(" ", ", ") + "»!"), (3, "otra cosa muy distinta que nada tiene que ver")], "doc_id long, text string")
    assert sorted(r.doc_id for r in D.contaminated(docs, bench).collect()) == [1, 2]


def test_short_questions():
    items = ["Define osmosis.\nAnswer: movement of water through a membrane towards the side with more dissolved matter", "2+2?\nAnswer: 4", "Which?\nA. the winding silver brook near the old mill", "Name three rivers\nAnswer: elbe oder weser"]
    index = D.Index(list(enumerate(items)))
    filler = "nothing of this kind stands here at all "
    for k, item in enumerate(items):
        for text in (item, filler * 20 + item.upper() + " " + filler * 20):
            data = np.frombuffer(text.encode(), np.uint8)
            hits = list(index.search(data, np.array([0, len(data)])))
            assert [(h[1], h[3], h[4]) for h in hits] == [(k, 1.0, 1.0)], item
    for text in (filler * 40, "movement of water through a membrane towards the side with more dissolved matter", "osmosis needs no word of ours, define it"):
        data = np.frombuffer(text.encode(), np.uint8)
        assert list(index.search(data, np.array([0, len(data)]))) == []


def test_unicode(spark):
    items = ["Какая река самая длинная в северной части страны и где она впадает в море", "Ποιος ποταμός είναι ο μεγαλύτερος στη βόρεια χώρα και πού εκβάλλει τελικά", "Ñandú élève übung señor garçon über dónde está la época añil corazón mío", "どの川が一番長いですか 北の国で そして どこで海に 注ぎますか 教えて ください"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    import unicodedata

    rows, want = [], []
    for i, t in enumerate(items):
        for x in (t, t.upper(), "“" + t.replace(" ", "” — “") + "”", "…" + t.replace(" ", " – ") + "、", unicodedata.normalize("NFD", t)):
            rows.append((len(rows), x))
            want.append((len(rows) - 1, i))
    rows.append((len(rows), "совсем другой текст о чём-то ином и без вопросов"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()) == want


def test_items_without_id(spark, monkeypatch):
    monkeypatch.setattr(D, "BYTES_TO_SEND", 60)
    item = "the winding silver brook near the old mill turns north"
    bench = spark.createDataFrame([(None, item), (None, item), (3, "quite another item with words of its own kind and more")], "item_id long, text string")
    docs = spark.createDataFrame([(1, item), (2, "nothing of this kind stands here at all"), (None, item)], "doc_id long, text string")
    assert sorted(((r.doc_id or 0, r.item_id) for r in D.contaminated(docs, bench).collect())) == [(0, None), (1, None)]
    assert [r.doc_id for r in D.clean(docs, bench).collect()] == [2]
