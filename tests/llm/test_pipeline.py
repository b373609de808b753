import hashlib
import re

import corpus_pipeline
from loomwork.llm import byte_bpe, pii
from loomwork.llm.queries import vocabulary

from tests.llm import test_near_dup as near
from tests.llm.test_native import base

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    # every document here is in a language of the labels
    survivors = [d for d, _, _, kept in near.brute(sorted(rows.items()), 5, 80) if kept]
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d: rows[d] for d in survivors if not any(i in norm(rows[d]) for i in items)}
    for d, text in clean.items():
        at, out = 0, []
        for start, _, kind, end in base(text):
            if start >= at:
                out += [text[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        clean[d] = "".join([*out, text[at:]])
    own = byte_bpe.Vocabulary(vocabulary("byte_bpe_50k.tiktoken"))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(clean)
    for r in got:
        assert r.decoded_sha256 == hashlib.sha256(clean[r.doc_id].encode()).hexdigest()
        assert len(r.ids) == r.n_tokens and own.decode(__import__("numpy").array(r.ids)).decode() == clean[r.doc_id]


def test_columns_stay(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven", "en", "s", 1, "k"), (1, "one two three four five six seven", "en", "s", 1, "k"), (2, None, None, None, None, "k"), (3, "", "en", "s", 0, "k"), (4, "write to a@b.co or call +49 30 1234567", "en", "s", 5, "k")], "doc_id long, text string, lang string, source string, n_chars long, keep string")
    for frame in (docs, docs.limit(0)):
        now = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == docs.columns
        rows = sorted((r.doc_id, r.text, r.n_chars) for r in now.collect())
        if frame is docs:
            assert rows == [(1, "one two three four five six seven", 33), (4, "write to [EMAIL] or call [PHONE]", 32)]
        else:
            assert rows == []
    assert pii.redact(docs).count() == 5
