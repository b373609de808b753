import re

import pytest
from loomwork.llm import near_dup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    index = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in index[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(d, least.get(top(i), d))
    return sorted((d, len(sets[i]), least[top(i)], least[top(i)] == d) for i, (d, _) in enumerate(rows))


def run(spark, rows, **more):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string")
    return sorted(map(tuple, near_dup.near_duplicates(df, **more).collect()))


def test_small_cases(spark):
    base = "the quick brown fox jumps over the lazy dog again and again until night falls on the old town square".split()
    rows = [(5, " ".join(base)), (3, " ".join(base).upper()), (9, " ".join([*base[:-1], "place"])), (1, None), (2, ""), (4, " \t\n "), (6, "one two"), (7, "One\ttwo"), (8, "one two three"), (10, "Ünï cödé wörds äre kept"), (11, "ünï cödé wörds äre kept")]
    rows += [(20 + i, " ".join(f"w{j + i}" for j in range(60))) for i in range(12)]
    rows += [(50, "x " * 70_000), (51, "x x x x")]
    for k in (4, 5):
        assert run(spark, rows, k=k) == brute(rows, k, 80)


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("k", [4])
def test_table(spark, k):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    assert sorted(map(tuple, near_dup.near_duplicates(df, k=k).collect())) == brute(rows, k, 80)


def test_rows_without_id_and_of_one_id(spark):
    a, near = " ".join(f"w{i}" for i in range(60)), " ".join([*(f"w{i}" for i in range(59)), "other"])
    b = " ".join(f"x{i}" for i in range(30))
    rows = [(1, a, "k"), (5, a, "k"), (5, b, "k"), (None, near, "k"), (None, "some words of its own that nobody has", "k"), (None, "c c c d d d e e e", "k"), (None, "c c c d d d e e e", "k"), (7, None, "k"), (7, None, "k"), (8, "twice is once in the survivors", "k"), (8, "twice is once in the survivors", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_a string")
    none = lambda r: tuple((x is None, x) for x in r)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect()), key=none)
    assert got == sorted([(1, 1, True), (5, 1, False), (5, 5, True), (None, 1, False), (None, None, True), (None, None, True), (None, None, True), (7, 7, True), (7, 7, True), (8, 8, True), (8, 8, True)], key=none)
    out = near_dup.survivors(df)
    assert out.columns == df.columns
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=none)
    assert kept == sorted([(1, a), (5, b), (None, rows[4][1]), (None, rows[5][1]), (7, None), (7, None), (8, rows[9][1])], key=none)


def test_hot_shingles(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "HOT", 5)
    import random

    r = random.Random(3)
    stem = [f"s{i}" for i in range(40)]
    rows = []
    for i in range(120):  # near and not so near copies of one text, by how many words are changed
        w = list(stem)
        for j in r.sample(range(40), r.randint(0, 4)):
            w[j] = f"c{r.randint(0, 5)}"
        rows.append((i, " ".join(w)))
    assert run(spark, rows, k=2) == brute(rows, 2, 80)


def test_tables_are_dropped(spark):
    from loomwork.plans import storage

    before = len(storage._written)
    near_dup.near_duplicates(spark.createDataFrame([(i, f"a b c d e {i // 2}") for i in range(20)], "doc_id long, text string")).collect()
    left = [p for _, p in storage._written[before:] if __import__("os").path.exists(p.removeprefix("file://"))]
    assert len(left) == 1 and "/classes-" in left[0]


def test_copies_of_a_text_meet_it_once(spark, monkeypatch):
    import random

    r = random.Random(7)
    rows = []
    for i in range(300):  # each is linked with the 250th, hardly any two others are
        w = [f"s{j}" for j in range(60)]
        for j in r.sample(range(60), 0 if i == 250 else 2):
            w[j] = f"c{i}.{j}"
        rows.append((i, " ".join(w)))
    made, confirm = [], near_dup._confirm

    def counted(pairs, sets, percent):
        made.append(pairs.count())
        return confirm(pairs, sets, percent)

    monkeypatch.setattr(near_dup, "_confirm", counted)
    assert run(spark, rows, k=2) == brute(rows, 2, 80)
    assert sum(made) < 5 * len(rows), made  # hubs by node number: 2481
