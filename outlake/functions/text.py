"""Text of pages and documents as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases of navigation and footers.
NAVIGATION = (
    "subscribe", "book a demo", "careers", "cookie policy", "privacy policy", "terms of service", "sign up", "log in", "menu", "navigation", "skip to",
    "cookie consent", "accept cookies", "reject cookies", "learn more", "get started", "try free", "contact us", "about us", "our team",
    "follow us", "social media", "linkedin", "twitter", "facebook", "instagram", "youtube", "newsletter", "email updates",
)
BLANKS = r"[\t\x0B-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
SIGNS = r"[^\p{L}\p{N}_ ]"
# Texts that give orders to a model.
INJECTION = (
    r"\b(?:ignore|disregard|forget|override)\b[^.\n]{0,40}\b(?:previous|prior|above|earlier|all)\b[^.\n]{0,20}\b(?:instruction|prompt|rule|direction)s?\b"
    r"|^\s*(?:system|assistant|user)\s*:|\bnew\s+(?:instruction|task|rule)s?\s*:|\byou\s+are\s+now\b"
)
# A body that says something is attached.
ATTACHMENT_CLAIM = (
    r"\b(?:resume|cv|portfolio|deck|attachment)\b[^.\n]{0,40}\b(?:is|are)\s+attached|\battach(?:ed|ing)\b[^.\n]{0,40}?\b(?:resume|cv|portfolio|deck)\b"
    r"|\b(?:find|see)\s+(?:my\s+)?(?:attached|the\s+attached)\b"
)
# Marks of pages that a script fills in.
SHELL_MARKS = ("__next_data__", "window.__nuxt__", "ng-version", "data-reactroot", 'id="__next"', 'id="root"', "id='root'", 'id="app"')
SHELL_TEXT, BARE_TEXT, SHELL_SCRIPT = 800, 120, 4000
# How texts state a number of employees.
EMPLOYEES = (
    r"\b(?:(?:we(?:'re| are)|our|a)\s+(?:growing\s+)?)?(?:team of|company of|staff of|headcount(?:\s+of)?|over|about|approximately|around|nearly)\s+"
    r"(\d{1,4})\+?\s*(?:employees|people|teammates|team members|staff)\b|\b(\d{1,4})\+?\s*(?:employees|teammates|team members)\b"
)
# Hosts of parked domains, and sites that are about companies but not theirs.
PARKED = ("forsale.", "domainmarket", "dan.com", "sedo.com", "afternic", "hugedomains", "buydomains", "godaddy", "namecheap", "parkingcrew", "bodis.com", "above.com", "undeveloped.com")
AGGREGATORS = (
    "linkedin.com facebook.com twitter.com x.com instagram.com indeed.com glassdoor.com crunchbase.com wikipedia.org bloomberg.com yelp.com youtube.com github.com "
    "medium.com angel.co wellfound.com pitchbook.com zoominfo.com apollo.io owler.com cbinsights.com reddit.com forbes.com techcrunch.com ycombinator.com "
    "producthunt.com g2.com capterra.com builtin.com builtinnyc.com levels.fyi quora.com clutch.co goodfirms.co themanifest.com upwork.com fiverr.com google.com "
    "bing.com duckduckgo.com amazon.com apple.com eventbrite.com meetup.com startupsavant.com failory.com explodingtopics.com seedtable.com topstartups.io "
    "welcometothejungle.com spotify.com soundcloud.com vimeo.com tiktok.com pinterest.com substack.com notion.site wordpress.com blogspot.com wixsite.com"
).split()
LONG_STEM = 24
# Words of changes, policies and improvements.
CHANGES = "launch announce expand open hire raise funding series acquire partner release ship".split()
POLICIES = "policy values culture remote hybrid equity dei diversity benefit parental transparency".split()
IMPROVEMENTS = ("improve", "faster", "reduce", "increase", "upgrade", "redesign", "optimize", "new feature")
# Words of list-like titles, and forms of addresses.
LIST_TITLE = r"(?i)\b(top|best|list|guide|companies|startups|\d{4})\b"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
SPELLED = r"(?i)\b([A-Z0-9._%+-]+)\s*(?:\[at\]|\(at\)|\bat\b)\s*([A-Z0-9-]+(?:\.[A-Z0-9-]+)*)\s*(?:\[dot\]|\(dot\)|\bdot\b)\s*([A-Z]{2,24})\b"


def visible_text(html: Column) -> Column:
    """A page's text without scripts, styles and tags, blanks squeezed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), r"\s+", " "))


def is_script_shell(html: Column) -> Column:
    """A page that a script fills in: it has a mark, no mail or profile link outside scripts and little text; or hardly
    any text and much script."""
    markup = F.lower(F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " "))
    text = F.length(visible_text(html))
    lower = F.lower(html)
    marked = F.lit(False)
    for mark in SHELL_MARKS:
        marked |= lower.contains(mark)
    linked = markup.contains("mailto:") | markup.contains("linkedin.com/in/")
    script = F.length(html) - F.length(F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", ""))
    return F.when(F.coalesce(html, F.lit("")) == "", True).when(marked, ~linked & (text < SHELL_TEXT)).otherwise((text < BARE_TEXT) & (script > SHELL_SCRIPT))


def claims_attachment(body: Column) -> Column:
    return F.coalesce(body, F.lit("")).rlike("(?i)" + ATTACHMENT_CLAIM)


def is_junk_site(url: Column) -> Column:
    """Parked pages, aggregators, and hosts of one long word."""
    from outlake.functions.identity import registered_domain

    text, domain = F.lower(F.coalesce(url, F.lit(""))), registered_domain(url)
    parked = F.lit(False)
    for host in PARKED:
        parked |= text.contains(host)
    stem = F.substring_index(F.coalesce(domain, F.lit("")), ".", 1)
    return (text != "") & (parked | F.coalesce(domain.isin(*AGGREGATORS), F.lit(False)) | ((F.length(stem) > LONG_STEM) & stem.rlike(r"^\p{L}+$")))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean(text: Column, chars: int = 3000, least: int = 20) -> Column:
    """Lines of some length that are neither navigation nor mostly signs, blanks squeezed, joined; repeated sentences
    go, the first one stays; cut with an ellipsis."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")
    lines = F.filter(F.transform(F.split(squeezed, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)
    lines = F.filter(lines, lambda x: ~F.lower(x).rlike("|".join(NAVIGATION)) & (F.length(F.regexp_replace(x, SIGNS, "")) >= F.length(x) * F.lit(0.3)))
    sentences = F.filter(F.split(F.array_join(lines, " "), "[.!?] +"), lambda x: x != "")
    # equal sentences side by side, in their order; sorted once, bound by an outer transform
    keyed = F.sort_array(F.transform(sentences, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("x"))))
    first = bound(keyed, lambda s: F.filter(s, lambda x, i: (i == 0) | (x["low"] != F.get(s, F.greatest(i - 1, F.lit(0)))["low"])))
    placed = F.sort_array(F.transform(first, lambda x: F.struct(x["i"].alias("i"), x["x"].alias("x"))))
    joined = F.array_join(F.transform(placed, lambda x: x["x"]), ". ")
    return bound(joined, lambda j: F.trim(F.when(F.length(j) > chars, F.concat(F.substring(j, 1, chars), F.lit("..."))).otherwise(j)))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a[^>]+href="([^"]*)"'), F.lit(1))


def injected(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("(?im)" + INJECTION)


def _one_line(text: Column, chars: int) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"\s*\n\s*", " "), r"^\s+|\s+$", ""), 1, chars)


def as_data(text: Column, chars: int = 600) -> Column:
    """Text of others as data for a prompt: orders go, one line, cut; null is empty."""
    return _one_line(F.regexp_replace(F.coalesce(text, F.lit("")), "(?im)" + INJECTION, "[removed]"), chars)


def quotable(text: Column, chars: int = 300) -> Column:
    """Text of others for an email of ours: null if it tried to give orders, or is empty."""
    return F.when(~injected(text), F.nullif(_one_line(text, chars), F.lit("")))


def employee_estimate(text: Column, least: int = 2, most: int = 50_000) -> Column:
    """The largest stated number of employees in range, null if there is none."""
    found = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?i)" + EMPLOYEES), F.lit(i)) for i in (1, 2)]
    numbers = F.transform(F.concat(*found), lambda x: x.try_cast("int"))
    return F.array_max(F.filter(numbers, lambda x: x.between(least, most)))


def largest_number(text: Column, least: int = 2, most: int = 50_000) -> Column:
    """The largest whole number in range, null if there is none."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d{1,6})\b"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_max(F.filter(found, lambda x: x.between(least, most)))


def sentences(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def has_any(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    lower, out = F.lower(text), F.lit(False)
    for w in words:
        out |= lower.contains(w)
    return out


def company_from_title(title: Column, domain: Column) -> Column:
    """A search result's company: the title up to a separator, unless it is long or like a list; else the domain's stem."""
    t = F.coalesce(title, F.lit(""))
    cut = t
    for sep in (": ", " - ", " — ", " – ", " | "):
        cut = F.when(t.contains(sep), F.substring_index(t, sep, 1)).otherwise(cut)
    cut, stem = F.trim(cut), F.substring_index(domain, ".", 1)
    return F.when(F.length(cut).between(2, 40) & ~cut.rlike(LIST_TITLE), cut).when(F.length(stem) > 2, F.concat(F.upper(F.substring(stem, 1, 1)), F.lower(F.substring(stem, 2, 100))))


def _shielded(hex_text: Column) -> Column:
    """An address whose characters are combined with the first byte by exclusive or, in hexadecimal."""
    byte = lambda i: F.conv(F.substring(hex_text, i, F.lit(2)), 16, 10).cast("int")
    places = F.transform(F.sequence(F.lit(1), F.floor(F.length(hex_text) / 2).cast("int") - 1), lambda k: 2 * k + 1)
    return F.when(F.length(hex_text) >= 4, F.array_join(F.transform(places, lambda i: F.char(byte(i).bitwiseXOR(byte(F.lit(1))))), ""))


#: A character reference: decimal, hexadecimal, named; the oldest names need no semicolon.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|(?:amp|lt|gt|quot|AMP|LT|GT|QUOT))"


def unreferenced(text: Column) -> Column:
    """Character references decoded once, as far as they name characters of ASCII; others become a sign that is part of
    no address."""
    named = [f"&{name} {ord(sign):x}" for name, sign in html5.items() if sign.isascii() and len(sign) == 1]
    by_name = F.transform_values(F.str_to_map(F.lit("\n".join(named)), F.lit("\n"), F.lit(" ")), lambda _, code: F.char(F.conv(code, 16, 10).cast("int")))

    def sign(r: Column) -> Column:
        digits = F.regexp_extract(r, "^&#[xX]?0*([0-9a-fA-F]{1,7});?$", 1)  # longer numbers name no character
        number = F.when(F.lower(r).startswith("&#x"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("decimal(20,0)")
        return F.when(r.startswith("&#"), F.when(number.between(1, 127), F.char(number.cast("int"))).otherwise("\ufffd")).otherwise(F.coalesce(by_name[r], F.lit("\ufffd")))

    whole = F.concat(text, F.lit(" "))  # so that there is a piece after each reference
    pieces, found = F.split(whole, REFERENCE), F.regexp_extract_all(whole, F.lit(f"({REFERENCE})"), F.lit(1))
    joined = F.array_join(F.zip_with(pieces, found, lambda piece, r: F.concat(piece, F.when(r.isNull(), "").otherwise(sign(r)))), "")
    return F.when(text.contains("&"), F.left(joined, F.length(joined) - 1)).otherwise(text)


def addresses_in(html: Column) -> Column:
    """Addresses of a page in order: shielded, in mail links, spelled out, plain; each once, whatever its case; only ones
    that one may write to."""
    from outlake.functions.identity import is_outreach_address

    page = unreferenced(F.coalesce(html, F.lit("")))
    whole = f"^{EMAIL}$"
    all_of = lambda text, pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    shielded = F.transform(all_of(page, r"(?i)(?:data-cfemail=[\"']|/cdn-cgi/l/email-protection#)([0-9a-f]+)", 1), _shielded)
    mailed = F.transform(all_of(page, r"(?i)mailto:([^\"'\s?>]+)", 1), lambda x: F.regexp_replace(x, "[.,;]+$", ""))
    visible = F.trim(F.regexp_replace(F.regexp_replace(page, "<[^>]+>", " "), r"\s+", " "))
    spelled = F.zip_with(
        F.zip_with(all_of(visible, SPELLED, 1), all_of(visible, SPELLED, 2), lambda a, b: F.concat(a, F.lit("@"), b)), all_of(visible, SPELLED, 3), lambda a, b: F.concat(a, F.lit("."), b)
    )
    plain = F.transform(all_of(page, f"({EMAIL})", 1), lambda x: F.regexp_replace(x, "[.,;]+$", ""))
    found = F.filter(F.concat(shielded, mailed, spelled, plain), lambda x: x.rlike(whole) & is_outreach_address(x))
    return bound(found, lambda f: F.filter(f, lambda x, i: ~F.exists(F.slice(f, 1, i), lambda y: F.lower(y) == F.lower(x))))


# Addresses of data in markup and scripts, endings of static files, and paths by what they are good for.
API_URL = r"(?i)(https?://[^\s\"'<>\\]+|/(?:api|graphql|wp-json|data|cms)[^\s\"'<>\\]*|[^\s\"'<>\\]+\.json(?:\?[^\s\"'<>\\]*)?)"
FETCH_CALL = r"(?i)(?:fetch|axios\.(?:get|post)|\$\.(?:get|ajax))\s*\(\s*['\"]([^'\"]+)['\"]"
STATIC = r"(?i)\.(js|css|png|jpg|jpeg|gif|svg|woff|woff2|map)$"
INTERESTING = r"(?i)(\.json$|^/api|/api/|^/wp-json|/wp-json/|/graphql|/data/|/cms/)"
PEOPLE_PATH, ABOUT_PATH = r"(?i)team|people|staff|leadership|employee", r"(?i)about|contact|company"


def endpoints(html: Column, url: Column, most: int = 8) -> Column:
    """Data addresses of a page's own origin that its markup and scripts name, as structs of rank, url and path: people
    first, then about and contact, then wp-json, then others; ``most`` of them."""
    page = F.coalesce(html, F.lit(""))
    origin = F.regexp_extract(url, r"(?i)^(https?://[^/?#]+)", 1)
    # addresses inside scripts are matched along with those of the markup
    raw = F.concat(F.regexp_extract_all(page, F.lit(FETCH_CALL), F.lit(1)), F.regexp_extract_all(page, F.lit(API_URL), F.lit(1)))
    clean = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"[\\)]+$", ""), "#.*$", "")
    whole = lambda x: F.when(x.rlike("(?i)^https?://"), x).when(x.startswith("//"), F.concat(F.regexp_extract(url, "^([a-zA-Z]+:)", 1), x)).when(x.startswith("/"), F.concat(origin, x))
    links = F.filter(F.transform(raw, lambda x: whole(clean(x))), lambda x: x.isNotNull())
    path = lambda x: F.regexp_extract(x, r"(?i)^https?://[^/?#]*([^?#]*)", 1)
    own = F.filter(links, lambda x: (F.lower(F.regexp_extract(x, r"(?i)^(https?://[^/?#]+)", 1)) == F.lower(origin)) & path(x).rlike(INTERESTING) & ~path(x).rlike(STATIC))
    rank = lambda p: F.when(p.rlike(PEOPLE_PATH), 0).when(p.rlike(ABOUT_PATH), 1).when(F.lower(p).contains("wp-json"), 2).otherwise(3)
    once = F.array_distinct(F.transform(own, lambda x: F.regexp_replace(x, "/+$", "")))
    return F.when(origin != "", F.slice(F.array_sort(F.transform(once, lambda x: F.struct(rank(path(x)).alias("rank"), x.alias("url")))), 1, most)).otherwise(F.array())


# What employees' snippets say, and what others' say.
EMPLOYMENT = r"(?i)\b(?:at|with|joining|joined|works?(?:\s+at)?|currently)\b|@"
OTHERS = r"(?i)\b(?:hiring at|open to work|looking (?:for|at)|recruiter for|journalist|job posting|we're hiring|we are hiring)\b"
OTHER_TITLE = r"\b(?:university|college|school|student|engineer|analyst|associate|director|manager|intern|partner|vice president|vp|mba)\b"


def is_employee_snippet(company: Column, title: Column, body: Column) -> Column:
    """A search result on somebody who works at a company: it names the company, is no job advert and not about a former
    employer, has the company in its title or a strong cue, and no other employer as the title's second part."""
    from outlake.functions.people import mentions_company

    t, blob = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))))
    words = F.filter(F.split(F.lower(F.coalesce(company, F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    matches = lambda before, after="": F.exists(words, lambda w: F.rlike(blob, F.concat(F.lit(before), w, F.lit(after))))
    former = matches(r"\b(?:ex|former|previously)\b.{0,30}\b", r"\b")
    in_title = F.exists(words, lambda w: t.contains(w))
    experience = matches(r"experience\s*:\s*[^\n]{0,60}")
    strong = matches(r"(?:at|with|@)\s+") | experience
    second = F.trim(F.get(F.split(t, r"\s*[|\-–—]\s*"), F.lit(1)))
    elsewhere = (F.coalesce(second, F.lit("")) != "") & ~F.exists(words, lambda w: second.contains(w)) & ~second.rlike(OTHER_TITLE) & (F.size(F.split(second, r"\s+")) <= 4)
    sure = (in_title & F.coalesce(title, F.lit("")).rlike(r"\s[-–—|]\s")) | blob.rlike(EMPLOYMENT) | experience
    both = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")))
    return mentions_company(company, both) & ~both.rlike(OTHERS) & ~former & (in_title | strong) & ~F.coalesce(elsewhere, F.lit(False)) & sure
