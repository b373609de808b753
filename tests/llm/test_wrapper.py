import random

from loomwork.llm import wrapper


def words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


def page(kind, r, i):
    """(html, main text) under one of three templates."""
    title, paras = words(r, 5), [words(r, r.randint(20, 60)) for _ in range(r.randint(1, 6))]
    main = "\n".join([title, *paras])
    body = "".join(f"<p>{p}</p>\n" for p in paras)
    comment = "".join(f"<div class='comment' id=c{j}><p>{words(r, 15)}</p></div>" for j in range(r.randint(0, 4)))
    if kind == 0:
        return f"<!DOCTYPE html><html><head><title>{title}</title><script>var a='</p><p>no</p>';</script></head><body><header><h2>My site</h2></header><nav><ul><li>Home<li>About</ul></nav><article><header><h1>{title}</h1></header>{body}<!-- no --></article><section class=\"comments\">{comment}</section><footer>&copy; {words(r, 9)}</footer>", main
    if kind == 1:
        aside = f"<div class=sidebar><ul>{''.join(f'<li><a href=x>{words(r, 3)}</a></li>' for _ in range(5))}</ul></div>" if i % 3 else ""
        return f"<html><body><div id='top-menu'><a href=/>Home</a></div><div class='cookie-notice'>We use cookies</div><div id=wrap>{aside}<div class='post-content'><h1>{title}</h1>{body}<form><input name=q><button>Go</button></form></div><div id='comments'>{comment}</div></div></body></html>", main
    ad = f"<div class='ad'>{words(r, 6)}</div>" if i % 2 else ""
    return f"<html><body><table><tr><td class=nav>Menu {words(r, 2)}</td><td><h1>{title}</h1>{body}{ad}<div>Printed by our own site</div></td></tr></table></body></html>", main


def test_templates(spark):
    r = random.Random(8)
    rows, want = [], {}
    for kind in range(3):
        for i in range(60):
            source, text = page(kind, r, i)
            n = kind * 100 + i
            rows.append((n, f"http://h{kind}.x/{i}", source, "t"))
            want[n] = text
    rows += [(900, None, None, "t"), (901, "http://h0.x/e", "", "t"), (902, "no scheme", "<p>a &amp; b<br>c</p>plain &lt;x&gt;", "t"), (903, "http://one.x/", "<body><p>Only &nbsp; one</p><script>x", "t"), (903, "http://one.x/", "<body><p>Only &nbsp; one</p><script>x", "t"), (904, "http://h1.x/long", "<body><div class='post-content'>" + "<p>word</p>" * 30_000, "t"), (905, "http://deep.x", "<div>" * 5000 + "deep", "t")]
    want |= {900: "", 901: "", 902: "a & b c\nplain <x>", 903: "Only one", 904: "\n".join(["word"] * 30_000), 905: "deep"}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = wrapper.extract_pages(pages).collect()
    assert len(got) == len(rows)
    for row in got:
        assert row.text == want[row.page_id], row.page_id
        assert row.n_chars == len(row.text)
    assert wrapper.extract_pages(pages.limit(0)).collect() == []


def test_alignment():
    a, b = (wrapper.express(wrapper.parse(s)) for s in ("<div><p>x</p><p>y</p><b>same</b></div>", "<div><i>new</i><p>z</p><b>same</b></div>"))
    (div,) = wrapper.join(a, b).kids
    assert [(k.sign, k.optional, k.repeated) for k in div.kids] == [("i", True, False), ("p", False, True), ("b", False, False)] or [(k.sign, k.optional, k.repeated) for k in div.kids] == [("p", False, True), ("i", True, False), ("b", False, False)]
    assert div.kids[-1].kids[0].text == "same" and next(k for k in div.kids if k.sign == "p").kids[0].text is None


def test_long_lists_are_aligned_whole():
    r = random.Random(5)
    tags = ["p", "h2", "ul", "table", "pre", "dl", "section"]

    def long_page():
        return "<body><div class=top>" + "".join(f"<{t}>{words(r, 2)}</{t}>" for t in r.choices(tags, k=900)) + "</div><div class=text>" + "".join(f"{words(r, 3)}<b>{words(r, 1)}</b>" if i % 7 else f"<i>{words(r, 1)}</i>" for i in range(900)) + "<blockquote>Printed by our own site</blockquote></div>"

    pages = [long_page() for _ in range(6)]
    assert wrapper.constants(wrapper.infer(pages)) == ["Printed by our own site"]


def test_alignment_is_longest():
    r = random.Random(6)
    for _ in range(200):
        a, b = (r.choices("abcd", k=r.randint(0, 30)) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        got = wrapper._aligned([wrapper.Expr(x, []) for x in a], [wrapper.Expr(x, []) for x in b])
        assert len(got) == len(a) + len(b) - best[0][0]


def test_names_count_whole():
    long = " ".join(["mt-2 flex items-center justify-between rounded-lg border-gray shadow-sm"] * 3)
    r = random.Random(7)
    for mark in (f'class="{long}" id="comments"', f"class='{long} sidebar'", 'data-id="' + "x" * 100 + '" class=newsletter', 'title="a class=b" class="widget"'):
        source = f"<body><div id=main><h1>Title</h1><p>{words(r, 30)}</p><div {mark}><p>Not the article</p></div></div>"
        assert "Not the article" not in wrapper.extract(source, None), mark
    a, b = (wrapper.parse(f'<div class="{long} {x}">x</div>').kids[0].sign for x in ("left", "right"))
    assert a != b
    a, b, c = (wrapper.parse(f"<div {x}>x</div>").kids[0].sign for x in ("class=col-1", "class=col-2", "class='col-1 post-4711'"))
    assert a != b and c == a + " post-"
    assert wrapper.parse('<div data-id="comments" aria-role=menu>x</div>').kids[0].names == ""


def test_rare_template_of_a_large_host(spark):
    r = random.Random(9)
    rows, want = [], {}
    for i in range(340):
        source, text = page(2 if i % 34 == 5 else 0, r, i)
        rows.append((i, f"http://large.x/{i}", source))
        want[i] = text
    rows += [(i, f"http://large.x/again{i}", rows[5][2]) for i in range(400, 420)]
    want |= {i: want[5] for i in range(400, 420)}
    for n in (1, 7):
        got = wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n)).collect()
        assert len(got) == len(rows)
        assert [row.page_id for row in got if row.text != want[row.page_id]] == []


def test_packed_wrappers():
    r = random.Random(10)
    e = None
    for i in range(30):
        x = wrapper.express(wrapper.parse(page(1, r, i)[0]))
        assert wrapper.pack(wrapper.unpack(wrapper.pack(x))) == wrapper.pack(x)
        e = x if e is None else wrapper.join(e, x)
    again = wrapper.unpack(wrapper.pack(e))
    assert wrapper.pack(again) == wrapper.pack(e) and again.pages == 30 and wrapper.read_off(again) == wrapper.read_off(e)


def neutral(r, i, parts=3):
    """(html, main text) of a page whose names say nothing, or the wrong thing."""
    title = words(r, 4)
    paras = [words(r, r.randint(15, 40)) for _ in range(parts)]
    main = "\n".join([title, *paras, "Notice " + paras[0], "Price " + paras[-1]])
    rare = "<div class=zq8><b>Our</b> summer sale has begun, buy now</div>" if i % 3 == 0 else ""
    links = "".join(f"<li><a href=/{j}>{words(r, 3)}</a></li>" for j in range(5))
    return f"""<html><body><div class=zq1><a href=/>Home</a> <a href=/s>Shop</a></div><div class=zq4><ul>{links}</ul></div><div class=zq2><h1>{title}</h1>{rare}{"".join(f"<p>{p}</p>" for p in paras)}
<div class='notice-period'>Notice {paras[0]}</div><p class="share-price">Price {paras[-1]}</p><p>Printed by our own site</p></div><div class=zq3>All rights <i>reserved</i></div></body></html>""", main


def test_neutral_names(spark):
    r = random.Random(11)
    made = [neutral(r, i, 2000 if i == 7 else r.randint(1, 6)) for i in range(60)]
    rows = [(i, f"http://n.x/{i}", source) for i, (source, _) in enumerate(made)]
    got = {row.page_id: row.text for row in wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [i for i, (_, text) in enumerate(made) if got[i] != text] == []


def test_names_in_articles():
    for name, kept in (("share-price", True), ("alert-level", True), ("notice-period", True), ("cookie-notice", False), ("shareButtons", False), ("related-posts", False), ("ad slot-1", False), ("comment-list", False)):
        source = f"<body><article><h1>Title</h1><p>Some text that is longer than the rest of it all.</p><div class='{name}'>Is it</div></article></body>"
        assert ("Is it" in wrapper.extract(source, None)) == kept, name


def test_copies_are_no_template():
    r = random.Random(12)
    same = "".join(f"<p>{words(r, 20)}</p>" for _ in range(5))
    pages = [f"<body><div class=a>{words(r, 2)}</div><div class=b><h1>Same title</h1>{same if i % 9 else '<p>' + words(r, 50) + '</p>'}</div></body>" for i in range(45)]
    reading = wrapper.Reading(wrapper.infer(pages))
    for source in pages:
        text = wrapper.extract(source, reading)
        assert text.startswith("Same title") and source.count("<p>") == text.count("\n")


def test_repeats_on_a_page_are_no_template():
    r = random.Random(14)
    pages = [f"<body><div class=a><h1>{words(r, 3)}</h1>" + "".join(f"<p>{words(r, 9)}</p>" for _ in range(3)) + ("<p>Again</p>" * 400 if i == 8 else "") + "</div></body>" for i in range(20)]
    assert wrapper.extract(pages[8], wrapper.Reading(wrapper.infer(pages))).count("Again") == 400


def test_unclosed_elements():
    for tag in ("svg", "object", "canvas", "noscript", "video", "template"):
        source = f"<body><div><h1>Title</h1><p>Before it <span><{tag} width=1>hidden words</span> behind</p><p>After</p></div></body>"
        assert wrapper.extract(source, None) == "Title\nBefore it behind\nAfter", tag
    assert wrapper.extract("<body><p>Before<p><svg><g><text>hidden</text><p>After</p></body>", None) == "Before\nAfter"
    assert wrapper.extract("<body><p>Before</p><svg><text>hidden</text></svg><p>After</p></body>", None) == "Before\nAfter"


def test_matching():
    where = {"h1": [0], "p": [1, 3], "b": [2], "i": [4]}
    repeated = [False, True, False, True, False]
    assert wrapper.match(["h1", "p", "p", "b", "p", "i"], where, repeated) == [0, 1, 1, 2, 3, 4]
    assert wrapper.match(["p", "x", "i", "p"], where, repeated) == [1, None, 4, 3]


def test_frequent_values():
    r = random.Random(13)
    for _ in range(50):
        seen = r.choices("abcdefghijklmnopqrstuvwxyz", weights=[30, 20] + [1] * 24, k=400)
        places = [wrapper.Expr(wrapper.TEXT, [], v, 1) for v in seen]
        while len(places) > 1:
            places = [wrapper.join(*places[i : i + 2]) if i + 1 < len(places) else places[i] for i in range(0, len(places), 2)]
        (e,) = places
        assert e.seen == 400 and len(e.values) <= wrapper.VALUES
        for v in set(seen):
            n = seen.count(v)
            assert n - 400 / (wrapper.VALUES + 1) <= e.values.get(v, 0) <= n
