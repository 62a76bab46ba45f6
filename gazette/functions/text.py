"""Text and URL column expressions; all of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.data import PRIZE_PATTERNS, TITLE_PLATFORMS

#: Texts that mean "not known".
UNKNOWN = ("tba", "tbd", "n/a", "na", "none", "null", "unknown", "not listed", "not specified", "not provided", "-")
#: The characters that Unicode calls space separators.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Words that carry no identity in a title.
STOP_WORDS = ("the", "of", "and", "by", "at", "edition", "annual", "hackathon", "hack", "challenge", "online", "university", "college", "institute", "technology")
#: Short forms in the names of organizers.
SHORT_FORMS = {"univ": "university", "inst": "institute", "tech": "technology"}
#: Character references of markup and what they stand for; & comes last, so that nothing is decoded twice.
MARKUP_REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
REFERENCES = (*MARKUP_REFERENCES[:2], ("&quot;", '"'), ("&#39;", "'"), MARKUP_REFERENCES[2])


def squeezed(text: Column, limit: int = 500) -> Column:
    """White space squeezed, spaces of all scripts trimmed, cut to limit."""
    return F.substring(F.btrim(F.regexp_replace(text, "\\s+", " "), F.lit(SPACES)), 1, limit)


def clean(text: Column, limit: int = 500) -> Column:
    """squeezed; texts that mean "not known" become null."""
    x = squeezed(text, limit)
    return F.when((x == "") | F.lower(x).isin(*UNKNOWN), None).otherwise(x)


def hashtags(text: Column, most: int = 10) -> Column:
    """The distinct words after '#' in lower case, sorted, up to most of them."""
    return F.slice(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("#([A-Za-z0-9_]+)"), F.lit(1)), F.lower))), 1, most)


def tracking_free_query(query: Column) -> Column:
    """A URL query without tracking parameters, the rest sorted by key and otherwise in order."""
    parts = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).rlike("^(utm_.*|fbclid|gclid|msclkid)$"))
    keyed = F.transform(parts, lambda p, i: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("k"), i.alias("i"), p.alias("p")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["p"]), "&")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, default port dropped, '/' for an empty path, tracking
    parameters dropped, parameters in key order, fragment kept. Null if it is no http(s) URL."""
    form = "(?s)^([Hh][Tt][Tt][Pp][Ss]?)://([^/?#]*)([^?#]*)(\\?[^#]*)?(#.*)?$"
    part = lambda k: F.coalesce(F.regexp_extract(url, form, k), F.lit(""))
    scheme = F.lower(part(1))
    host = F.when(scheme == "https", F.regexp_replace(F.lower(part(2)), ":443$", "")).otherwise(F.regexp_replace(F.lower(part(2)), ":80$", ""))
    query = tracking_free_query(F.regexp_replace(part(4), "^\\?", ""))
    path = F.when(part(3) == "", "/").otherwise(part(3))
    whole = F.concat(scheme, F.lit("://"), host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)), part(5))
    return F.when(url.rlike(form) & (host != ""), whole)


def public_url_ok(url: Column) -> Column:
    """Whether a URL may be shown: http(s), a named public host, no credentials, usual ports only."""
    host = F.lower(F.regexp_extract(url, "^[A-Za-z]+://([^/?#:@]*)", 1))
    private = host.rlike("^(localhost|127\\.|10\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|169\\.254\\.|0\\.)|(\\.local|\\.internal|\\.localhost)$")
    shaped = url.rlike("^(?i:https?)://[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+(:(80|443))?([/?#][^\\s\\\\]*)?$")
    return F.coalesce(shaped & ~private & (F.length(url) <= 2048), F.lit(False))


def url_source_name(url: Column) -> Column:
    """The site's name: the label before the last two of the host, capitalised, or the host's first label."""
    host = F.lower(F.regexp_extract(url, "^[A-Za-z]+://([^/?#:]*)", 1))
    bare = F.regexp_replace(host, "^(www|m|blog)\\.", "")
    return F.when(host != "", F.concat(F.initcap(F.split_part(bare, F.lit("."), F.lit(1))), F.lit(" Direct")))


def search_form(text: Column) -> Column:
    """For searching: hyphenated words also joined, lower case, punctuation to spaces, squeezed."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), "\\b([a-zA-Z0-9]+)-([a-zA-Z0-9]+)\\b", "$1$2 $1 $2")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "(?U)[^\\w\\s]", " "), "\\s+", " "))


def words_of(text: Column) -> Column:
    """The words of a text (letters and digits of any script) in lower case, as an array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("(?U)[^\\W_]+"), F.lit(0))


def identity_form(text: Column, organizer: bool = False) -> Column:
    """For comparing: the words joined by one space; short forms of organizers written out."""
    words = words_of(text)
    if organizer:
        long = F.create_map(*[F.lit(x) for pair in SHORT_FORMS.items() for x in pair])
        words = F.transform(words, lambda w: F.coalesce(F.try_element_at(long, w), w))
    return F.array_join(words, " ")


def title_tokens(form: Column, most: int = 12) -> Column:
    """Distinct informative words of an identity_form, sorted, up to most of them."""
    return F.slice(F.sort_array(F.array_distinct(F.filter(F.split(form, " "), lambda w: (w != "") & ~w.isin(*STOP_WORDS) & ~w.rlike("^[0-9]+$")))), 1, most)


def clean_tags(tags: Column, most: int = 40) -> Column:
    """Of the first most tags, trimmed and in lower case, the distinct ones that are not empty, in order."""
    return F.array_distinct(F.filter(F.transform(F.slice(tags, 1, most), lambda t: F.trim(F.lower(t))), lambda t: t != ""))


def decoded(text: Column, references: tuple[tuple[str, str], ...] = REFERENCES) -> Column:
    """text with these character references replaced in turn; others stay as they are written."""
    for entity, char in references:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def html_title(html: Column, references: tuple[tuple[str, str], ...] = REFERENCES) -> Column:
    title = decoded(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1), references)
    return F.trim(F.regexp_replace(title, "\\s+", " "))


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def bare_url(url: Column) -> Column:
    """A URL without its query and fragment."""
    return F.regexp_replace(url, "(?s)[?#].*$", "")


def url_slug(url: Column, platform: str) -> Column:
    """The name after /hackathons/, else the subdomain of the platform's host; '' if neither."""
    by_path = F.regexp_extract(url, "/hackathons/([^/?#]+)", 1)
    by_host = F.regexp_extract(url, f"https?://([^.]+)\\.{platform}\\.co", 1)
    return F.coalesce(F.when(by_path != "", by_path).when(~by_host.isin("www", "api", platform), by_host), F.lit(""))


def platform_free_title(title: Column) -> Column:
    """A page title without the platform's name behind a dash, bar or colon."""
    return F.trim(F.regexp_replace(title, f"(?is)[\\-|–—:]\\s*(?:{'|'.join(TITLE_PLATFORMS)}).*$", ""))


def prize_in_prose(text: Column) -> Column:
    """The prize that a text names, by the first pattern that fits; amounts in lakh or crore without a
    sign come after, and TBA where there is none."""
    named = [F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in PRIZE_PATTERNS]
    lakh = F.regexp_extract(F.lower(text), "(\\d+(?:\\.\\d+)?)\\s*(?:lakh|lac)s?", 1)
    crore = F.regexp_extract(F.lower(text), "(\\d+(?:\\.\\d+)?)\\s*(?:crore|cr)s?", 1)
    words = F.when(lakh != "", F.concat(F.lit("₹"), lakh, F.lit(" Lakh"))).when(crore != "", F.concat(F.lit("₹"), crore, F.lit(" Cr")))
    return F.coalesce(*named, words, F.lit("TBA"))


def caption_title(caption: Column, account: Column) -> Column:
    """The first sentence of a caption (10 to 80 characters), else its first 80 characters, without
    tags and mentions; a title made of the account where too little is left."""
    first = F.regexp_extract(caption, "(?s)^(.{10,80}?)(?:\\n|\\.|!|\\?)", 1)
    whole = F.when(first != "", first).otherwise(F.substring(caption, 1, 80))
    title = F.trim(F.regexp_replace(F.regexp_replace(whole, "(?U)[#@]\\w+", ""), "\\s+", " "))
    return F.when(F.length(title) >= 5, title).otherwise(F.concat(F.lit("Hackathon by @"), account))


def user_agent(agent: Column) -> Column:
    """device, os and browser of a user agent; Unknown where there is none."""
    a = F.lower(agent)
    has = lambda *words: reduce(lambda x, y: x | y, [a.contains(w) for w in words])
    none = F.coalesce(agent, F.lit("")) == ""
    device = F.when(none, "Unknown").when(has("mobile", "android", "iphone", "ipod"), "Mobile").when(has("ipad", "tablet"), "Tablet").otherwise("Desktop")
    system = F.when(none, "Unknown").when(has("iphone", "ipad"), "iOS").when(has("android"), "Android").when(has("windows"), "Windows").when(has("mac os", "macintosh"), "macOS").when(has("linux"), "Linux").otherwise("Other")
    browser = F.when(none, "Unknown").when(has("edg/"), "Edge").when(has("chrome/") & has("safari/"), "Chrome").when(has("firefox/"), "Firefox").when(has("safari/"), "Safari").otherwise("Other")
    return F.struct(device.alias("device"), system.alias("os"), browser.alias("browser"))
