"""Links and text rules with literal pages and texts."""

import re

from pyspark.sql import functions as F

from outlake.functions import text
from outlake.operators import links
from tests.conftest import SF


def test_links_are_ranked_over_the_whole_page(spark):
    noise = "".join(f"<a href='https://other.org/about/{i}'>x</a><a href='mailto:team{i}@acme.co.uk'>team</a><a href='#team'>t</a><a href='/p/{i}'>p</a>" for i in range(30))
    news = "".join(f"<a href=/news/{i}>n</a>" for i in range(30))
    page = f"""<html>{noise}{news}<a HREF="../about/">About</a><A href="https://www.acme.co.uk/people?x=1#top">x</A><a href='/about'>again</a><a href="/team/login">t</a>
    <a href="//blog.acme.co.uk/x"><b>Our</b> &lt;<i>team</i></a><a href="http://[x/team">x</a><a name=team>x</a><a href="ftp://acme.co.uk/team">x</a><a href="/x">Terms and people</a><a href="/z">contact<script>legal</script>"""
    want = ["https://www.acme.co.uk/people?x=1", "https://blog.acme.co.uk/x", "https://acme.co.uk/about", "https://acme.co.uk/z"] + [f"https://acme.co.uk/news/{i}" for i in range(20)]
    pages = spark.createDataFrame([(1, "https://acme.co.uk/de/", page), (2, None, page), (3, "https://acme.co.uk", None), (4, "https://x.io", "<a href=/team/>")], "page_id long, url string, html string")
    rows = links.page_links(pages).orderBy("page_id", "place").collect()
    assert [tuple(r) for r in rows if r.page_id == 1] == [(1, i, x) for i, x in enumerate(want)]
    assert [tuple(r) for r in rows if r.page_id != 1] == [(4, 0, "https://x.io/team")]


def plain_clean(raw):
    lines = [x.strip() for x in re.sub(r"[^\S\n]+", " ", raw or "").split("\n")]
    lines = [x for x in lines if len(x) >= 20 and not any(w in x.lower() for w in text.NAVIGATION) and len(re.sub(r"[^\w\s]", "", x)) >= len(x) * 0.3]
    seen, out = set(), []
    for s in re.split(r"[.!?]\s+", " ".join(lines)):
        if s.strip() and s.lower().strip() not in seen:
            seen.add(s.lower().strip())
            out.append(s)
    joined = ". ".join(out)
    return (joined[:3000] + "..." if len(joined) > 3000 else joined).strip()


def test_clean_text_matches_plain_version(spark):
    odd = [
        None, "", "short", "We make fine tools here\nSUBSCRIBE to our weekly mail\nAnd we ship them abroad", "-- ** == ++ // -- ** ab\nA line of plain words here", "Is it so? Yes it is! Is it so? yes it is! No. No. The end of it.",
        "many    blanks\t\there\u00a0\u2003and\u3000there\n\n\n  a second  line of words \r\n", "Ünïcödé wörds ünd 日本語の文字 ² ½\n... !!! a b c ??? ... !!!", "x" * 3000 + "\n" + "y" * 20, "a   b               c", "Same line of words!\n" * 5, "long line " * 2 + "\u2028" + "e\u0301 " * 9,
    ]
    assert len(text.NAVIGATION) == 29
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    rows = odd + docs + [f"{x}\n{w.title()} and some more words\n{x}" for x, w in zip(docs, text.NAVIGATION)]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    got = dict(df.select("i", text.clean(F.col("t"))).collect())
    assert [got[i] for i in range(len(rows))] == [plain_clean(x) for x in rows]


def test_references_resolve_as_in_the_standard_library(spark):
    """Random relative references against random pages."""
    import random
    from urllib.parse import urldefrag, urljoin

    rng = random.Random(2)
    bits = ["", "a", "b.html", "..", ".", "x-y", "c;d", ".hidden", "..."]
    path = lambda: "/".join(rng.choice(bits[1:]) for _ in range(rng.randrange(1, 5)))
    pages = [f"https://acme.co.uk{rng.choice(['', '/', '/' + path().replace('..', 'q').replace('./', 'r/')])}{rng.choice(['', '?q=1'])}" for _ in range(40)]
    forms = [lambda: path(), lambda: "/" + path(), lambda: "//other.org/" + path(), lambda: "?x=1", lambda: "../" * rng.randrange(1, 6) + "z", lambda: "", lambda: "http://y.io/a/../b", lambda: "mailto:a@b.c", lambda: path() + "/", lambda: path() + "?k=../v#f", lambda: "./" + path()]
    cases = [(rng.choice(pages), rng.choice(forms)()) for _ in range(600)]
    frame = spark.createDataFrame([(i, b, r) for i, (b, r) in enumerate(cases)], "i int, b string, r string")
    got = dict(frame.select("i", links.resolved(F.col("b"), F.col("r"))).collect())
    wrong = [(b, r, got[i], urldefrag(urljoin(b, r)).url) for i, (b, r) in enumerate(cases) if got[i] != urldefrag(urljoin(b, r)).url]
    assert wrong == []


def test_no_python_worker_finds_links_and_addresses(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for out in (links.page_links(pages), pages.select(text.addresses_in(F.col("html"))), pages.select(text.endpoints(F.col("html"), F.col("url")))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Arrow" not in plan and "Python" not in plan


def test_character_references_in_addresses(spark):
    import html

    rows = ["jane&#x2e;doe&#64;acme.org", "&#98;ea@acme.org", "a&commat;acme&period;org", "x &amp;#64; y@acme.org", "b&#0064;acme.org", "q&lowbar;r@acme.org", "&#106;&#97;n@acme&#46;org &eacute;s", "&notaname; &#xZ; z@acme.org", "p&#64acme.org", "&#99999999999999999999;v@acme.org"]
    frame = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    got = dict(frame.select("i", text.addresses_in(F.col("t"))).collect())
    plain = dict(frame.select("i", text.unreferenced(F.col("t"))).collect())
    for i, x in enumerate(rows):
        whole = html.unescape(x)
        assert "&not" in x or "".join(c for c in plain[i] if c.isascii()) == "".join(c for c in whole if c.isascii())
        assert got[i] == re.findall(r"[\w.+-]+@acme\.org", whole)


def test_names_fold_as_by_compatibility_decomposition(spark):
    import unicodedata

    from outlake.functions import identity

    def plain(name):
        folded = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).replace("'", "").replace("’", "").lower()
        return [t for t in re.split(r"[^a-z0-9]+", folded) if len(t) >= 2 and t not in identity.PERSON_SUFFIXES]

    names = ["Nguyễn Văn Đức", "Ｊａｎｅ Doe", "José O'Brien", "José O’Brien", "Søren Łukasz", "ﬁona Ǆurić", "𝔍𝔞𝔫𝔢 Doe", "Ünal ½ Ⅷ", "김 민수 kim", "Ἀθηνᾶ ana", "ệa ḃb", "ａｂ＇ｃ", ""]
    frame = spark.createDataFrame(list(enumerate(names)), "i int, n string")
    got = dict(frame.select("i", identity.name_tokens(F.col("n"))).collect())
    assert [got[i] for i in range(len(names))] == [plain(x) for x in names]
    # every character that gives a letter or digit
    signs, _, several = identity._folding()
    rows = [(i, f"q{c}q") for i, c in enumerate([*signs, *several])]
    got = dict(spark.createDataFrame(rows, "i int, n string").select("i", identity.name_tokens(F.col("n"))).collect())
    assert [(x, got[i], plain(x)) for i, x in rows if got[i] != plain(x)] == []
