import hashlib
import random
import re

from loomwork.llm import pii, queries, url_filter

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        t += x - 9 * (x > 9)
    return t % 10 == 0


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [("email", EMAIL, lambda m: True), ("ip", IP, lambda m: all(int(x) <= 255 for x in m.split("."))), ("card", CARD, lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", PHONE, lambda m: 9 <= len(digits(m)) <= 15)]
    out = [(m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(rules) for m in p.finditer(text or "") if ok(m[0])]
    return sorted(out)


def cases():
    r = random.Random(4)
    bits = ["a@b.co", "x.y+z@mail-1.example.com", "@", ".", "1.2.3.4", "256.1.1.1", "010.000.1.99", "4111111111111111", "4111 1111-1111 1111", "+49 (0)30 123456", "+1", "123456789", " ", "-", "é", "日本", "\n", "%", "_", "a@b@c.de", "+", "4", "call ", "GB82 WEST 1234 5698 7654 32", "ssn 123-45-6789", "DE89370400440532013000"]
    out = ["".join(r.choice(bits) + r.choice(["", "", " "]) for _ in range(r.randint(0, 25))) for _ in range(1500)]
    return [*out, None, "", "a" * 50_000, "1" * 50_000, "1 " * 20_000, "1." * 20_000, "a." * 20_000 + "@x.y", "a@b.co " * 3000, "+1 2" * 5000]


def test_base_spans(spark):
    texts = cases()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "a@b.co", "y")], "doc_id long, text string, spans string")
    rows = pii.digest(pii.detect(docs)).collect()
    assert len(rows) == len(texts) + 1
    for row in rows:
        want = base("a@b.co" if row.doc_id is None else texts[row.doc_id])
        names = [f"{name}:{a}:{b}" for a, _, name, b in want]
        assert row.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == i for _, k, _, _ in want) for i in range(4)]
        assert set(names) <= set(row.spans.split(",")) | {""}
    assert pii.detect(docs.limit(0)).collect() == []


def test_validators_and_context(spark):
    docs = spark.createDataFrame([(1, "iban GB82 WEST 1234 5698 7654 32 ok"), (2, "GB82 WEST 1234 5698 7654 33"), (3, "number 123-45-6789"), (4, "social security 123-45-6789"), (5, "social 000-45-6789"), (6, None)], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind in ("iban", "ssn")] for r in pii.detect(docs).collect()}
    assert got == {1: [("iban", 5, 32)], 2: [], 3: [], 4: [("ssn", 16, 27)], 5: [], 6: []}
    text = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert text[4] == "social security [SSN]" and text[6] == "" and text[2].startswith("GB82") and text[1].startswith("iban [IBAN]")


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), v == "block", h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *((max(fit)[2], max(fit)[3]) if fit else (None, "allow"))


def test_url_filter(spark):
    r = random.Random(9)
    urls = [r.choice(["http://", "https://", "", "x://y://"]) + r.choice(["a.example.org", "EXAMPLE.org", "org", "notexample.org", "x.com", "com", "", ".org", "b..org", "x.org:80", "u@x.com"]) + r.choice(["/es/", "/es", "/en/1", "/en/12?x=/de/", "/de/#a", "/fr/x", "", "?q=1", "#z", "/"]) for _ in range(400)]
    urls += [None, "", "://", "http://" + "a." * 300 + "org/" + "p" * 5000]
    pages = spark.createDataFrame([(i % 350, u, "v") for i, u in enumerate(urls)] + [(1, urls[1], "v")], "page_id long, url string, verdict string")
    got = sorted(((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in url_filter.judge(pages, queries.URL_RULES).collect()))
    want = sorted((i % 350, h, p, rule or "", v) for i, u in [*enumerate(urls), (1, urls[1])] for h, p, rule, v in [judge(u)])
    assert got == want
    assert url_filter.judge(pages.limit(0), queries.URL_RULES).collect() == []
    assert {r.verdict for r in url_filter.judge(pages, [], "block").collect()} == {"block"}


def test_rules_meet_by_short_prefix(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SHORT", 1)  # many false meetings, which the digests undo
    urls = ["http://a.example.org/es/", "http://x.com/de/1", "http://x.com/fr", None, "https://org/"]
    pages = spark.createDataFrame([(i % 2, u) for i, u in enumerate(urls * 3)], "page_id long, url string")
    frame = url_filter.judge(pages, queries.URL_RULES)
    got = sorted(((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in frame.collect()))
    want = sorted((i % 2, h, p, rule or "", v) for i, u in enumerate(urls * 3) for h, p, rule, v in [judge(u)])
    assert got == want
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "short" in plan and "(digest" not in [c for c in plan.splitlines() if "Join LeftOuter" in c][0]
    both = url_filter.judge(pages, [("allow", "com", "/de/"), ("block", "com", "/de/")]).where("rule is not null").collect()
    assert {r.verdict for r in both} == {"block"} and len(both) == 3


def test_redact_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "write to a@b.co", "x", "y", "z")], "doc_id long, text string, spans string, __spans string, Spans_ string")
    (row,) = pii.redact(docs).collect()
    assert tuple(row) == (1, "write to [EMAIL]", "x", "y", "z") and pii.redact(docs).columns == docs.columns
