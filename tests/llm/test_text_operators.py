"""SentencePiece codec, quality rules, URL filter, HTML, lattice scores, chat and packing: brute force and edges."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from outlake.llm import chat, html_text, lattice_lm, packing, quality, sentencepiece_codec, url_filter
from outlake.llm.queries import op9_chat_format
from outlake.llm.sentencepiece_model import BPE, Codec, Model
from tests.conftest import SF

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "  two  blanks ", "x  y\nfoo two\n\nbar", "a\0b \0", "\n x\n", "tab\tand\n\nlines\r\n", "é 日本語 😀 e\u0301", "<s>x</s><0x0A>", "'s it's. A.B c,, !!. x.,y 12.5,", "<|endoftext|> <|ENDOFTEXT|>", "x" * 3_000]


def odd_docs(spark):
    rows = [(i, t, None if i % 3 == 0 else "en", None, i) for i, t in enumerate(ODD)] + [(None, "no id", "en", "s", 1), (3, ODD[3], "en", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")


def texts_of(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]


def test_codec_parity_and_round_trip(spark):
    import sentencepiece

    own, theirs = Codec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert own.model.kind == BPE and own.model.byte_fallback and len(own.model.pieces) == 32000
    texts = texts_of(spark) + [t for t in ODD if t]
    ids = own.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == theirs.encode(texts)
    assert own.decode(ids) == texts
    whole = own.model.tokenizer()
    assert [e.ids for e in whole.encode_batch(texts[-40:], add_special_tokens=False)] == theirs.encode(texts[-40:])
    out = sentencepiece_codec.encode(odd_docs(spark), PIECES)
    assert out.where("parity and round_trip").count() == out.count() == len(ODD) + 2
    back = {(r.doc_id, r.text) for r in sentencepiece_codec.decode(out, PIECES).collect()}
    assert back == {(r.doc_id, r.text or "") for r in odd_docs(spark).collect()}
    assert sentencepiece_codec.encode(odd_docs(spark).limit(0), PIECES).count() == 0


def test_unigram_models_are_rebuilt(tmp_path):
    """A unigram model made by hand (no training): the library's best segmentation is found again."""
    import struct

    import sentencepiece

    def field(n, wire, data):
        return bytes([n << 3 | wire]) + (bytes([len(data)]) if wire == 2 else b"") + data

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -3.0, 1), ("▁ab", -2.0, 1), ("a", -2.5, 1), ("b", -2.6, 1), ("c", -2.7, 1), ("bc", -1.5, 1), ("▁abc", -6.0, 1)]
    data = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    data += field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(3, 0, b"\x01") + field(4, 0, b"\x01") + field(5, 0, b"\x01"))
    path = str(tmp_path / "m.model")
    with open(path, "wb") as f:
        f.write(data)
    texts = ["abc", "ab c", "  abc   abc ", "cab", ""]
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    assert [np.frombuffer(x, "<u4").tolist() for x in Codec(path).encode(texts)] == sp.encode(texts)
    assert Model.read(path).pieces[4][0] == "▁ab"


def base_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    covered = {i + k for i, t in enumerate(tri) if n[t] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdicts(spark):
    docs = odd_docs(spark).unionByName(spark.createDataFrame([(50, "a b c " * 40 + "\n" + "a b\n" * 3, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_words int"))
    long = " ".join(f"w{i % 70_001}" for i in range(200_000))  # windows repeat, no hash decides
    docs = docs.unionByName(spark.createDataFrame([(51, long, "en", "s", 0)], docs.schema))
    docs = docs.withColumns({c: F.lit(1) for c in ("m", "__m", "__at", "doc", "quality", "kept", "w")})
    out = quality.judged(docs).select("doc.doc_id", "doc.text", "quality.*").collect()
    assert len(out) == docs.count()
    for r in out:
        want = base_counts(r.text)
        assert (r[2], r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.quality_filter(docs.limit(0)).count() == 0
    assert quality.quality_filter(docs).columns == docs.columns


def test_quality_agrees_with_labels(spark):
    d = SF.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    out = quality.judged(spark.read.parquet(f"{d}/documents.parquet")).select("doc.doc_id", F.col("quality").alias("q")).join(labels, "doc_id").where("not q.base_failed").groupBy("quality", "q.kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in out}
    assert n.get((0, True), 0) == 0 and n.get((1, False), 0) <= 0.01 * n[1, True]


def test_url_rules_and_verdicts(spark):
    urls = [
        "http://a.net/x", "http://net/", "http://example.net/en/1", "https://Sub.EXAMPLE.net/en/", "http://example.net/en", "http://x.org/fr/a?b#c", "http://example.com/de/1", "http://net.theory.example.com",
        "http://badexample.com/de/", "no scheme", None, "", "http://casinobets.example.com/a", "http://www.cheap-pills.example.com/en/1", "http://free-pills.example.com", "http://theory.example.com/en/1", "x://h?://y/z",
    ]
    html = "<p>theory of the casino bets and the example com cheap pills free</p>"
    more = [f"http://{h}.example.com/en/{k}" for h in ("www.cheap-pills", "free-bets", "theory") for k in range(10)]
    pages = spark.createDataFrame([(i, u, html, "r") for i, u in enumerate(urls + more)], "page_id long, url string, html string, rule string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).where(f"page_id < {len(urls)}").orderBy("page_id").collect()]
    assert got == [
        ("a.net", "/x", "net/", "block"), ("net", "/", "net/", "block"), ("example.net", "/en/1", "example.net/en/", "allow"), ("sub.example.net", "/en/", "example.net/en/", "allow"),
        ("example.net", "/en", "net/", "block"), ("x.org", "/fr/a", "org/fr/", "allow"), ("example.com", "/de/1", "example.com/de/", "block"), ("net.theory.example.com", "", None, "allow"),
        ("badexample.com", "/de/", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("casinobets.example.com", "/a", None, "block"),
        ("www.cheap-pills.example.com", "/en/1", None, "block"), ("free-pills.example.com", "", None, "block"), ("theory.example.com", "/en/1", None, "allow"), ("h", "", None, "allow"),
    ]
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert url_filter.segment("casinobets", {"casino": 5, "bets": 5, "cas": 9, "in": 90}, 1000) == ["casino", "bets"]


def plain_segment(label, counts, total):
    """The best split by trying all of them."""
    from functools import cache

    @cache
    def best(i):
        if i == len(label):
            return 0.0, ()
        out = None
        for j in range(i + 1, len(label) + 1):
            n = counts.get(label[i:j])
            if n or j == i + 1:
                rest, words = best(j)
                here = (math.log10(n / total) if n else url_filter.UNKNOWN - math.log10(total)) + rest
                if out is None or here > out[0]:
                    out = here, (label[i:j], *words)
        return out

    return [w for w in best(0)[1] if len(w) > 1]


def plain_verdicts(rows):
    counts = Counter(w for _, _, page in rows for w in re.findall("[a-z]+", re.sub(r"(?s)<[^>]*>", " ", page or "").lower()) if 2 <= len(w) <= 63)
    for w in url_filter.STRONG + url_filter.WEAK:
        counts[w] += url_filter.SEED_COUNT
    total, split = sum(counts.values()), {}
    for i, url, _ in rows:
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        split[i] = host, re.findall("[a-z0-9]+", re.sub("[0-9]+", "0", path.lower()))
    pages = Counter((h, tuple(p)) for h, p in split.values())
    words = {h: [w for x in set(re.findall("[a-z0-9]+", h)) for w in plain_segment(x, counts, total)] for h in {h for h, _ in pages} if h}
    strong, weak = set(url_filter.STRONG), set(url_filter.STRONG + url_filter.WEAK)
    bad = {h: bool(strong & set(ws)) or len(weak & set(ws)) > 1 for h, ws in words.items()}
    b, a = Counter(), Counter()
    for (h, p), n in pages.items():
        for w in [*words.get(h, []), *("/" + x for x in p)] if h else []:
            (b if bad[h] else a)[w] += n
    for w in (set(a) | set(b)) & (strong | weak):
        b[w] += url_filter.PRIOR
    nb, every = sum(n for (h, _), n in pages.items() if bad.get(h)), sum(n for (h, _), n in pages.items() if h)
    v, tb, ta = len(set(a) | set(b)), sum(b.values()), sum(a.values())
    weight = lambda x, y: math.log((x + 1) / (tb + v + 1)) - math.log((y + 1) / (ta + v + 1))
    out = {}
    for i, (h, p) in split.items():
        score = math.log((nb + 1) / (every - nb + 1))
        own = Counter(words.get(h, []))
        for w, k in own.items():
            left = a[w] - (0 if bad[h] else k * sum(n for (g, _), n in pages.items() if g == h))
            score += k * weight(b[w], left) if left + b[w] else 0.0
        theirs = {w: a[w] - (own[w] * sum(n for (g, _), n in pages.items() if g == h) if w in weak and not bad[h] else 0) for w in own}
        evidence = any(bad[h] or weight(b[w], theirs[w]) >= math.log(url_filter.EVIDENCE) for w in own)
        score += sum(weight(b["/" + x], a["/" + x]) for x in p if b["/" + x] + a["/" + x])
        out[i] = score, score > 0 and evidence
    return out


def test_url_scores_match_plain_version(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    more = [(10_000, "https://www.casinobets.org/en/1", "<p>casino bets</p>", ), (10_001, None, None), (10_002, "http://Casinobets.org/x?y", "<p>casino</p>"), (10_001, None, None)]
    pages = pages.select("page_id", "url", "html").unionByName(spark.createDataFrame(more, "page_id long, url string, html string"))
    want = plain_verdicts([(r.page_id, r.url, r.html) for r in pages.collect()])
    got = url_filter.judge(pages, rules=()).collect()
    assert len(got) == pages.count()
    for r in got:
        score, block = want[r.page_id]
        assert r.score == pytest.approx(score, abs=1e-9) and (r.verdict == "block") == block


def test_a_weak_word_blocks_unless_harmless_hosts_use_it(spark):
    hosts = {"adult-x.org": True, "casino-bets.org": True, "poker-spam.org": True}
    hosts |= {f"free-{w}.org": False for w in ("theory", "garden", "museum", "river")} | {f"{w}.org": False for w in ("notes", "club", "jungle", "harbour", "theory", "garden")}
    text = "<p>theory garden museum river notes club jungle harbour free adult casino bets</p>"
    rows = [(f"http://{h}/en/{k}", bad) for h, bad in hosts.items() for k in range(20 if "-" in h and "x" not in h else 6)]
    pages = spark.createDataFrame([(i, u, text) for i, (u, _) in enumerate(rows)], "page_id long, url string, html string")
    want = plain_verdicts([(r.page_id, r.url, r.html) for r in pages.collect()])
    got = {r.page_id: r.verdict == "block" for r in url_filter.judge(pages, rules=()).collect()}
    assert [got[i] for i in range(len(rows))] == [bad for _, bad in rows] == [want[i][1] for i in range(len(rows))]


def test_urls_of_any_length_and_none_at_all(spark):
    shape = "page_id long, url string, html string"
    long_path, long_label = "http://a.com/" + "x" * 100_000, "http://" + "ab" * 2_000 + ".com/"
    got = url_filter.judge(spark.createDataFrame([(1, long_path, "<p>ab x</p>"), (2, long_label, None), (3, "http://a.com/de", "")], shape)).collect()
    assert sorted((r.page_id, len(r.host), len(r.path), r.verdict) for r in got) == [(1, 5, 100_001, "allow"), (2, 4_004, 1, "allow"), (3, 5, 3, "allow")]
    none = url_filter.judge(spark.createDataFrame([(1, None, "<p>a b</p>"), (2, None, None)], shape)).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in none) == [(1, "", "", None, "allow"), (2, "", "", None, "allow")]


def test_hosts_without_a_listed_word_are_judged_by_their_company(spark):
    rows = [(f"http://{a}-{b}.org/p/{k}", True) for a in ("casino", "spam", "poker", "pills") for b in ("luckyday", "quickdeal") for k in range(6)]
    rows += [(f"http://{b}-{c}.org/p/1", True) for b in ("luckyday", "quickdeal") for c in ("stone", "cloud", "maple")]
    rows += [(f"http://{a}-{b}.org/p/{k}", False) for a in ("theory", "garden", "museum", "river") for b in ("notes", "club", "jungle", "harbour") for k in range(12)]
    text = "<p>luckyday quickdeal theory garden museum river notes club jungle harbour stone cloud maple</p>"
    pages = spark.createDataFrame([(i, u, text) for i, (u, _) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.verdict == "block" for r in url_filter.judge(pages, rules=()).collect()}
    assert [got[i] for i in range(len(rows))] == [bad for _, bad in rows]


def test_main_text():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header class=top>Site</header><nav><ul><li><a href=x>Home</a></ul></nav>
    <div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p>First&nbsp; para <b>bold<br>x <!-- c --><p>Second &lt;b&gt; &#233; 1 < 2.<ul><li>item</ul>
    <div class='ad'>Buy <div>now</div></div><p>Sh.</p><form>f<input></form></article><section id="comments"><p>A reader comment that is quite long indeed</p></section><footer>&copy; x</footer></body>"""
    assert html_text.main_text(page) == "Head & line\nFirst para bold x\nSecond <b> é 1 < 2.\nitem\nSh."
    soup = "<div><a href=1>One</a> <a href=2>Two</a></div><div>" + "word " * 30 + "</div><div>short end</div><div class=sidebar>aside text</div><foot"
    assert html_text.main_text(soup) == ("word " * 30).strip() + "\nshort end"
    assert html_text.main_text("") == html_text.main_text("<p> </p><script>x") == ""


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_short_lines_of_an_article_stay_after_gaps(n):
    gap = "<li>x" * n
    page = f"<article><h1>Short title</h1><ul class='share'>{gap}</ul><p>{'word ' * 30}</p><ul class='related'>{gap}</ul><p>Short end.</p></article>"
    assert html_text.main_text(page) == f"Short title\n{('word ' * 30).strip()}\nShort end."
    assert html_text.main_text(page.replace("article>", "main>")) == html_text.main_text(page)


@pytest.mark.parametrize("wrapper", ["class='content has-sidebar'", "id='page' class='no-sidebar'", "class='layout-with-header'", "class='sidebar-layout'", "role='banner'", "id=related"])
def test_a_listed_word_voids_no_wrapper(wrapper):
    body, aside = ("word " * 30).strip(), "menu " * 5
    page = f"<div {wrapper}><h1>Title</h1><p>{body}</p><div class='sidebar'>{aside}<div>more</div></div><p>End.</p></div><div class='footer'>{aside}</div>"
    assert html_text.main_text(page) == f"Title\n{body}\nEnd."
    assert html_text.main_text(f"<article><div {wrapper}><p>{body}</p></div></article>") == body


def test_listed_words_around_main_text():
    body = ("word " * 30).strip()
    for header in ("<header>", "<header class='entry-header'>", "<div class='entry-header'>"):
        close = header.split()[0].strip("<>")
        assert html_text.main_text(f"<article>{header}<h1>Title</h1></{close}><p>{body}</p></article>") == f"Title\n{body}"
    assert html_text.main_text(f"<div>{body}<img class='ad' src=x>{body}</div>") == body + body
    assert html_text.main_text(f"<div>{body}</div><div class='comments'>{'reply ' * 90}</div>") == body
    assert html_text.main_text(f"<div class=ad><nav>x</div><p>{body}</p>") == body
    assert html_text.main_text(f"<p>{body}</p>" + "<div class='ad'>" * 20_000 + "x") == body


def test_class_words_void_blocks_outside_the_flow():
    body = ("word " * 30).strip()
    inside = "<p class='header'>Section head</p><div class='related-work'><p>Earlier work.</p></div><p>The <span class='notice'>important</span> thing.</p>"
    gone = "<div class='related-posts'>more</div><div class='ad'>buy</div><div><span class=ad>buy</span></div><div><a class='share' href=x>send</a></div>"
    want = f"{body}\nSection head\nEarlier work.\nThe important thing."
    assert html_text.main_text(f"<article><p>{body}</p>{inside}{gone}</article>") == want
    menu = "<ul>" + "<li><a href=x>menu</a>" * 4 + "</ul>"
    assert html_text.main_text(f"<p>{body}</p>{menu}<p>A short closing paragraph.</p>") == f"{body}\nA short closing paragraph."
    assert html_text.main_text(f"<article><a href=x>Teaser</a> of it</article><p>{body}</p><p>More.</p>") == f"Teaser of it\n{body}\nMore."
    assert html_text.main_text(f"<p>{body} <span class=ad>x</p><p>{body}</p>") == f"{body} x\n{body}"


def plain_distribution(lines):
    """Lines in runs of non-empty windows of which one reaches the threshold, window by window."""
    weight = [w for _, w, _ in lines]
    sums = [sum(weight[i : i + html_text.WINDOW]) for i in range(len(weight))]
    limit = min(html_text.SURGE, max(sums, default=0))

    def surges(i):
        back = next((k for k in range(i, -1, -1) if not sums[k]), -1)
        ahead = next((k for k in range(i, len(sums)) if not sums[k]), len(sums))
        return any(x >= limit for x in sums[back + 1 : ahead])

    return "\n".join(t for i, (t, w, _) in enumerate(lines) if w and surges(i))


def test_main_text_is_the_plain_distribution():
    rng = np.random.default_rng(6)
    blocks = ["<p>%s.</p>", "<div>%s</div>", "<li><a href=x>%s</a>", "<div class=ad>%s</div>", "<footer>%s</footer>", "<pre>%s</pre>"]
    for _ in range(300):
        parts = [blocks[rng.integers(len(blocks))] % ("word " * int(rng.integers(1, 20))) for _ in range(rng.integers(0, 25))]
        page = "".join(f"<div>{x}</div>" for x in parts)
        lines = html_text.lines_of(page)
        assert html_text.main_text(page) == plain_distribution([(x.text, x.weight, x.inside) for x in lines if not x.heading])
        # side by side in one element, what isn't void is kept, as long as anything surges
        assert html_text.main_text("".join(parts)) == "\n".join(x.text for x in html_text.lines_of("".join(parts)) if x.weight)


def test_pages_give_their_articles(spark):
    import html

    def plain(page):
        inner = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
        parts = [re.sub(r"<br>", " ", x) for x in re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", inner)]
        return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in parts) if x)

    for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet").collect():
        assert html_text.main_text(r.html) == plain(r.html)


L = "A long sentence of the main text that stands here for itself and has more than eighty characters in all."


@pytest.mark.parametrize(
    "page, want",
    [
        # reader comments made of articles
        (f"<article><p>{L}</p><section id='comments'><article class='comment'><p>{L} great!</p></article></section><p>{L} end</p></article>", f"{L}\n{L} end"),
        (f"<main><p>{L}</p></main><ol class='comment-list'><li><article><p>{L} I agree!</p></article></li></ol>", L),
        (f"<article><p>{L}</p></article><aside class='comments'><article><p>{L} no</p></article></aside><p>{L} after</p>", f"{L}\n{L} after"),
        (f"<article class='comment'><p>{L} first</p></article><article><p>{L}</p></article>", L),
        # an article in a wrapper whose name says more than comments
        (f"<div class='site comments-enabled'><article><p>{L}</p></article></div>", L),
        # short blocks beside blocks that go
        (f"<body><h1>Short title</h1><nav>4 items</nav><p>{L}</p>", f"Short title\n{L}"),
        (f"<body><p>{L}</p><div class='ad'>Buy</div><div class='ad'>Now</div><h2>Part two</h2><div class='ad'>Buy</div><div class='ad'>Now</div><p>{L}</p>", f"{L}\nPart two\n{L}"),
        (f"<body><p>{L}</p><div class='ad'>Buy</div><div class='ad'>Now</div><div class='ad'>!</div><p>The end</p>", f"{L}\nThe end"),
        (f"<body><h1>Title</h1><nav>a</nav><nav>b</nav><nav>c</nav><div><div><p>{L}</p></div></div>", f"Title\n{L}"),
        (f"<body><div><span>Home, News</span></div><nav>a</nav><nav>b</nav><nav>c</nav><div><p>{L}</p></div>", L),
        # no switch at half of the page
        (f"<article>{L}</article><div class='text'>{L}</div>", f"{L}\n{L}"),
        (f"<article>{L} {L}</article><div class='text'>{L}</div>", f"{L} {L}\n{L}"),
        (f"<article>{L}</article><div class='text'>{L} {L}</div>", f"{L}\n{L} {L}"),
    ],
)
def test_short_blocks_and_comments(page, want):
    assert html_text.main_text(page) == want


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 1), (None, "u", "<article><p>x y</p></article>", 1), (2, None, "", 1), (3, "v", "<p>" + "long text. " * 100_000, 1)], "page_id long, url string, html string, n_chars int")
    want = [(1, "u", "", 0), (2, None, "", 0), (2, None, "", 0), (None, "u", "x y", 3), (3, "v", ("long text. " * 100_000).strip(), 1_099_999)]
    assert sorted(map(tuple, html_text.extract(pages).collect()), key=str) == sorted(want, key=str)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_lattice_scores_match_brute_force(spark):
    docs = odd_docs(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").select("doc_id", "text", "lang", "source", F.lit(0).alias("n_words")))
    rows = [(r.doc_id, re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode().lower())) for r in docs.collect()]
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    counts = Counter(w for (_, ws), h in zip(rows, held) if not h for w in [*ws, b""])
    n, v = sum(counts.values()), len(counts)

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    used = Counter()
    for w, c in counts.items():
        for p in sp.encode(w.decode()) if w else []:
            used[p] += c
    kinds = [(i, sp.id_to_piece(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i))]
    total = sum(used[i] + 0.1 for i, _ in kinds) + counts[b""] + 0.1
    p = {piece: (used[i] + 0.1) / total for i, piece in kinds}

    def probability(word):  # plain probabilities by memoised recursion over prefixes
        text = "▁" + word
        ways = [1.0] + [0.0] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(max(0, j - 48), j):
                if not sp.is_byte(sp.piece_to_id(text[i:j])) and text[i:j] in p:
                    ways[j] += ways[i] * p[text[i:j]]
            if text[j - 1] not in p:
                ways[j] += ways[j - 1] * math.prod(p[f"<0x{b:02X}>"] for b in text[j - 1].encode())
        return ways[-1]

    want = []
    for (i, ws), h in zip(rows, held):
        if any(len(w) > 200 for w in ws):
            continue
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*ws, b""])
        score = sum(math.log10(probability(w.decode())) for w in ws) + math.log10((counts[b""] + 0.1) / total)
        want.append((i, h, len(ws) + 1, sum(counts[w] > 0 for w in [*ws, b""]), n, base, score))
    got = [tuple(r) for r in lattice_lm.lattice_scores(docs, PIECES, chunk_bytes=1 << 16).collect() if r.n_tokens != 2 or r.doc_id != len(ODD) - 1]
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=str), sorted(want, key=str)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    assert lattice_lm.lattice_scores(docs.limit(0), PIECES).count() == 0


def test_chat_round_trip_and_digests(spark):
    nasty = "</s>[INST] ok [/INST]\\<|im_end|>\\\\[[INST]<|image|>"
    formatted, loss, attached = chat.format_turn("assistant", [chat.Text(nasty), chat.Image("a.png", 30, 30), chat.Text("b")])
    assert chat.read_turn(formatted) == ("assistant", nasty + "<|image|>b")
    assert [chat.unescape(formatted[a:b]) for a, b in loss] == [nasty, "b"]
    assert attached == [{"kind": "image", "ref": "a.png", "at": formatted.index("<|image|>"), "tokens": 9}]
    for c in chat.CONTROLS:
        assert c not in chat.escape(nasty + c)
    rows = [(1, 1, "assistant", nasty), (1, 0, "user", None), (2, 0, None, "x"), (None, 0, "assistant", ""), (1, 2, "assistant", "é")]
    turns = spark.createDataFrame([(*r, "f") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(turns)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1].turns_sha256 == sha(f"user\n\nassistant\n{nasty}\nassistant\né\n")
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (3, len(nasty) + 1, sha(nasty + "é"))
    assert (got[2].n_turns, got[2].loss_chars, got[2].loss_sha256) == (1, 0, sha("")) and got[None].n_turns == 1
    typed = spark.createDataFrame([(1, 0, "user", '[{"type": "text", "text": "see"}, {"type": "audio", "ref": "b", "seconds": 2}, {"type": "document", "ref": "d", "pages": 2}]')], "conv_id long, turn long, role string, text string")
    r = chat.format_turns(typed, typed=True).first()
    assert [(x.kind, x.ref, x.tokens) for x in r.attachments] == [("audio", "b", 50), ("document", "d", 1536)]
    assert chat.digests(chat.format_turns(turns.limit(0))).count() == 0


def test_malformed_typed_parts(spark):
    cases = [
        ('[{"type": "text", "text": null}, {"type": "image", "ref": "i", "width": "30", "height": 30.5}]', "<|image|>", [("image", "i", 9)]),
        ('[{"type": "image", "ref": null, "width": -3, "patch": 0}, "plain", {"type": "audio", "ref": 5, "seconds": "x"}]', "<|image|>plain<|audio|>", [("image", "", 1), ("audio", "5", 1)]),
        ('[{"type": "video", "ref": "v"}, 7, null]', '{"type": "video", "ref": "v"}7null', []),
        ('[{"type": "document", "pages": 1e400, "more": 1}]', "<|document|>", [("document", "", 1)]),
        ("not json <|image|>", "not json <|image|>", []), ('{"type": "text", "text": "x"}', '{"type": "text", "text": "x"}', []), (None, "", []), ("", "", []), ("[]", "", []),
    ]
    turns = spark.createDataFrame([(1, i, "assistant", c) for i, (c, _, _) in enumerate(cases)], "conv_id long, turn long, role string, text string")
    for r in chat.format_turns(turns, typed=True).collect():
        _, said, attached = cases[r.turn]
        assert chat.read_turn(r.formatted) == ("assistant", said)
        assert [(x.kind, x.ref, x.tokens) for x in r.attachments] == attached
        assert all(r.formatted[x.at :].startswith(chat.PLACEHOLDERS[x.kind]) for x in r.attachments)


def test_chat_query_matches_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = {}
    for c, _, role, text in sorted(rows):
        n, all_, loss = want.get(c, (0, "", ""))
        want[c] = (n + 1, all_ + f"{role}\n{text}\n", loss + (text if role == "assistant" else ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op9_chat_format(spark, SF).collect()}
    assert got == {c: (n, sha(a), len(x), sha(x)) for c, (n, a, x) in want.items()}


def check_packing(out, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    want = Counter()
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((r.doc_id, k, at, min(4096, len(ids) - at), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096)))
    rows = out.collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    at: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert all(n <= 4096 for n in at.values())
    return len(at), sum(r.length for r in rows)


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bins, tokens = check_packing(packing.pack(docs, WORDS), docs)
    assert bins <= math.ceil(tokens / 4096) + 2
    odd = odd_docs(spark)
    check_packing(packing.pack(odd, WORDS), odd)
    assert packing.pack(odd.limit(0), WORDS).count() == 0


def test_word_ids_of_all_letters_and_marks():
    """Words with every letter and mark of Unicode, bare and before signs, against the tokenizer on whole texts."""
    import unicodedata

    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(WORDS), packing.WordEncoder(WORDS)
    assert encode.by_words
    odd = [chr(c) for c in range(0x80, 0x30000) if unicodedata.category(chr(c))[0] in "LMNZC" and not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b, {c}. x{c}, {c} " for c in odd[i : i + 50]) for i in range(0, len(odd), 50)]
    texts += ["Bugün İstanbul, sonra İ. dedi.", "Aİ, b", "ΟΔΟΣ. ΟΔΟΣ", "e\u0301. \u0301x,", "A<|endoftext|>B, <|END|>. c"]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encode([x.encode() for x in texts]) == want
    assert encode([x.encode() for x in texts[::-1]]) == want[::-1]


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode = packing.WordEncoder(path)
    assert not encode.by_words
    texts = ["Hello  world, it's", "", "İ. x"]
    assert encode([x.encode() for x in texts]) == [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_packing_is_close_to_offline_best_fit(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', int(abs(xxhash64(id)) % 2500))").alias("text"))
    out = packing.pack(docs, WORDS).select("sequence_id", "length").collect()
    rooms: list[int] = []
    for n in sorted((r.length for r in out), reverse=True):  # best-fit decreasing
        at = min((i for i, room in enumerate(rooms) if room >= n), key=rooms.__getitem__, default=None)
        if at is None:
            rooms.append(4096)
            at = -1
        rooms[at] -= n
    assert len({r.sequence_id for r in out}) <= 1.03 * len(rooms)


def test_best_fit_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert bins.place(6) == (0, 0) and bins.place(7) == (1, 0)  # free: 4 and 3
    assert bins.place(8) == (2, 0)  # the fullest open bin (1) closes
    assert bins.place(3) == (0, 6)  # not into bin 1
    assert bins.place(2) == (2, 8)


def test_fences_of_large_groups_are_close_to_exact_quantiles(spark):
    import numpy as np

    n = 100_000
    metrics = "struct(bigint(100) as n_words, bigint(400 + id % 997) as word_chars, bigint(id * 7919 % 100003 % 60) as n_symbols, bigint(id % 31) as n_upper, bigint(id % 5) as n_dup_lines, bigint(20) as n_lines) as m"
    measured = spark.range(n).selectExpr("struct(id, 'en' as lang, if(id % 3 = 0, 'hot', 'rest') as source) as doc", metrics)
    got = {r.source: r for r in quality.fences(measured).collect()}
    ids = np.arange(n)
    for source, of in (("hot", ids[ids % 3 == 0]), ("rest", ids[ids % 3 != 0])):
        ratios = {"symbol_ratio": of * 7919 % 100003 % 60 / 100, "word_length": (400 + of % 997) / 100, "dup_line_ratio": of % 5 / 20}
        for k, x in ratios.items():
            x = np.sort(x)
            # ranks are off by half a percent at most
            at = lambda q: x[min(len(x) - 1, max(0, int(q * len(x))))]  # noqa: B023, E731
            bound = lambda e: at(0.75 + e) + quality.SPREAD * (at(0.75 + e) - at(0.25 - e)) + quality.SLACK[k]  # noqa: B023, E731
            assert bound(-0.005) <= got[source][f"{k}_hi"] <= bound(0.005)
