"""Text functions on columns: names, titles, ids, slugs, formats.

All are expressions inside code generation but the two Unicode normal forms, which Spark SQL lacks and which run as
Arrow-batched functions.  Every function gives null for null unless it says otherwise.
"""

from __future__ import annotations

import html
import unicodedata as ud

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names that stand for no artist.
PLACEHOLDER_NAMES = [
    "various artists", "various artists - topic", "unknown", "unknown artist", "curator", "community curator", "spotify",
    "youtube", "youtube music", "music", "artist", "soundtrack", "va",
]
# Accounts whose lists are made by machines, and marks of such lists.
SYSTEM_AUTHORS = ["youtube music", "spotify", "various artists - topic", "youtube", "music", "vevo"]
SYSTEM_TOKENS = ["rdampl", "my supermix", "supermix"]
SYSTEM_TITLES = [r"\bthe sound of\b", r"\bsound of\b", r"^intro to\b", r"^pulse of\b", r"^edge of\b"]
# Titles of things that are no single track.
NO_TRACK_TITLES = [
    r"\bplaylist\b", r"\bcompilation\b", r"\b\d+\s*hours?\b", r"\b\d+\s*hrs?\b", r"\bfull album\b", r"\bbest of 20\d\d\b",
    r"\btop \d+ songs\b", r"\bcontinuous mix\b", r"\bdj mix\b", r"\bdj set\b", r"\bnonstop\b",
]
# Words of titles that say nothing about a song.
STOP_WORDS = [
    "the", "and", "for", "you", "with", "that", "this", "from", "all", "your", "what", "don", "can", "out", "one", "let", "get",
    "like", "just", "not", "are", "was", "have", "had", "has", "her", "his", "him", "who", "how", "where", "when", "why",
    "which", "about", "into", "over", "after", "beneath", "under", "above", "remix", "mix", "feat", "ft", "version", "edit",
    "radio", "live", "acoustic", "original", "deluxe", "remaster", "remastered", "instrumental", "song", "music", "video",
    "official", "audio", "club", "intro", "outro",
]
# Words of labels that are written in a case of their own.
ACRONYMS = {
    "r&b": "R&B", "ccm": "CCM", "edm": "EDM", "k-pop": "K-Pop", "j-pop": "J-Pop", "j-rock": "J-Rock", "ost": "OST", "uk": "UK",
    "idm": "IDM", "opm": "OPM", "mpb": "MPB", "nz": "NZ", "v-pop": "V-Pop",
}
DATE_LIKE = r"(?i)^(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2},?\s+\d{2,4}$"


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else ud.normalize("NFKC", v))


@F.pandas_udf(T.StringType())
def fold_compatible(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    return s.map(lambda v: None if v is None else "".join(c for c in ud.normalize("NFKD", v) if not ud.combining(c)))


@F.pandas_udf(T.StringType())
def fold_accents(s: pd.Series) -> pd.Series:
    """Canonical decomposition without the marks U+0300 to U+036F."""
    return s.map(lambda v: None if v is None else "".join(c for c in ud.normalize("NFD", v) if not "̀" <= c <= "ͯ"))


def sanitise_name(name: Column, normalised: bool = False) -> Column:
    """A credited name in clean form, or null where it names no artist.

    Compatibility form, trimmed; 1 to 100 characters; a final "- Topic" or "Topic" goes; at least one letter; no
    placeholder and no date.  ``normalised`` says that the input is in compatibility form already.
    """
    s = F.trim(name if normalised else nfkc(name))
    low = F.lower(s)
    cut = F.when(low.endswith(" - topic"), F.trim(F.substring(s, F.lit(1), F.length(s) - 8)))
    cut = cut.when(low.endswith(" topic"), F.trim(F.substring(s, F.lit(1), F.length(s) - 6))).otherwise(s)
    ok = F.length(s).between(1, 100) & cut.rlike(r"\p{L}") & ~F.lower(cut).isin(*PLACEHOLDER_NAMES) & ~cut.rlike(DATE_LIKE)
    return F.when(ok, cut)


def split_names(name: Column) -> Column:
    """Names of a joint credit in order, each once regardless of case: cut at "feat." and "ft.", and at commas unless
    what follows is an epithet ("Tyler, The Creator") or a suffix ("Jr").  An empty array for an empty or null text."""
    parts = F.split(F.trim(name), r"(?i)\s+(?:ft\.?|feat\.?)\s+")
    epithet = r"(?i)^[^,]+,\s*(?:the\s+\w+|jr\.?|sr\.?|ii|iii|iv)$"
    cut = F.flatten(F.transform(parts, lambda p: F.when(F.trim(p).rlike(epithet), F.array(F.trim(p))).otherwise(F.split(F.trim(p), ","))))
    clean = F.filter(F.transform(cut, lambda p: sanitise_name(p, normalised=True)), lambda p: p.isNotNull())
    # First of each name regardless of case.
    kept = F.aggregate(
        clean, F.array().cast("array<string>"),
        lambda acc, p: F.when(F.exists(acc, lambda q: F.lower(q) == F.lower(p)), acc).otherwise(F.concat(acc, F.array(p))))
    return F.coalesce(kept, F.array().cast("array<string>"))


def song_key(title: Column, normalised: bool = False) -> Column:
    """Title without bracketed notes and guests, for matching a song across uploads."""
    head = F.split(title, r"(?i)\s*[\(\[【]|\s+(?:ft\.?|feat\.?)\s+", 2)[0]
    return F.lower(F.trim(head if normalised else nfkc(head)))


def artist_key(name: Column, channel: Column) -> Column:
    """Stable id of a credit: by its channel where that is an artist channel, else by its typed name."""
    by_channel = F.trim(channel).startswith("UC") & channel.startswith("UC")
    return F.when(F.coalesce(by_channel, F.lit(False)), F.concat(F.lit("yt_"), F.trim(channel))).otherwise(
        F.concat(F.lit("name_"), F.substring(F.md5(F.lower(F.trim(name))), 1, 12)))


def title_sides(title: Column) -> tuple[Column, Column]:
    """Both sides of an "X - Y" title: numbering off the left, trailing notes off the right; nulls without " - "."""
    has = F.contains(title, F.lit(" - "))
    left = F.trim(F.regexp_replace(F.trim(F.substring_index(title, " - ", 1)), r"^\d+[\.\-_–—]+\s*", ""))
    rest = F.substring(title, F.instr(title, " - ") + 3, F.length(title))
    right = F.trim(F.split(rest, r"\s+[-|/]+\s+|\s*[\(\[【]", 2)[0])
    return F.when(has, left), F.when(has, right)


def seconds(duration: Column) -> Column:
    """Seconds of "MM:SS" or "HH:MM:SS"; 0 for anything else and for null."""
    p = F.transform(F.split(F.trim(duration), ":"), lambda x: F.when(x.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(x).try_cast("int")))
    whole = F.size(p)
    two = p[0] * 60 + F.try_element_at(p, F.lit(2))
    three = p[0] * 3600 + F.try_element_at(p, F.lit(2)) * 60 + F.try_element_at(p, F.lit(3))
    return F.coalesce(F.when(whole == 2, two).when(whole == 3, three), F.lit(0))


def is_system_list(title: Column, author: Column, list_id: Column) -> Column:
    """Whether a list was made by a machine: by its id, its author, or tokens and patterns of its title."""
    t, a, i = (F.coalesce(c, F.lit("")) for c in (title, author, list_id))
    t, a, low = F.lower(F.trim(t)), F.lower(F.trim(a)), F.lower(F.trim(i))
    out = F.contains(low, F.lit("rdclak")) | a.isin(*SYSTEM_AUTHORS)
    for token in SYSTEM_TOKENS:
        out = out | F.contains(low, F.lit(token)) | F.contains(t, F.lit(token))
    for pattern in SYSTEM_TITLES:
        out = out | t.rlike(pattern)
    return out


def is_no_track(title: Column) -> Column:
    """Whether a title names a compilation, a mix or the like; false for null."""
    return F.coalesce(title.rlike("(?i)" + "|".join(NO_TRACK_TITLES)), F.lit(False))


def is_catalogue_track(title: Column, secs: Column) -> Column:
    """A single track by its title and, where known and positive, a length of 30 to 600 seconds."""
    return ~is_no_track(title) & (secs.isNull() | (secs <= 0) | secs.between(30, 600))


def phrase_form(text: Column, folded: bool = False) -> Column:
    """Lower case, no accents, words parted and padded by single blanks, for whole-phrase containment tests."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = t if folded else fold_compatible(t)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def list_key(list_id: Column) -> Column:
    """List id with its ``VL`` prefix."""
    return F.when(list_id.startswith("VL"), list_id).otherwise(F.concat(F.lit("VL"), list_id))


def author_of(name: Column, author_id: Column, list_id: Column) -> tuple[Column, Column]:
    """Name and id of a list's author; without id an anonymous one made of the list's id."""
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(blank(name), F.lit("")), F.coalesce(blank(author_id), F.concat(F.lit("anon_"), F.substring(list_id, 1, 8)))


def joint_credit_parts(side: Column) -> Column:
    """The whole credit first, then its parts at ``&``, commas, ``x``, ``feat`` and ``ft``, cleaned."""
    parts = F.split(side, r"(?i)\s*(?:&|,|\bx\b|\bfeat\.?|\bft\.?)\s*")
    return F.filter(F.transform(F.concat(F.array(side), parts), lambda p: sanitise_name(p, normalised=True)), lambda p: p.isNotNull())


def match_form(text: Column, folded: bool = False) -> Column:
    """Name for exact comparison: styled letters plain, no accents, lower case, no dots or blanks around; '' for null."""
    t = F.translate(F.coalesce(text, F.lit("")), "яЯ$øØ", "rrsoo")
    t = t if folded else fold_compatible(t)
    return F.trim(F.btrim(F.trim(F.lower(t)), F.lit(".")))


def letters_form(form: Column) -> Column:
    """:func:`match_form` without anything but letters and digits."""
    return F.regexp_replace(form, r"[^\p{L}\p{N}]+", "")


def without_article(form: Column) -> Column:
    """:func:`match_form` without a leading article."""
    return F.trim(F.regexp_replace(form, r"^(?:the|a)\s+", ""))


def content_words(title: Column) -> Column:
    """Distinct words of three or more letters outside brackets that are no stop words, sorted."""
    bare = F.lower(F.regexp_replace(title, r"[\(\[\{].*?[\)\]\}]", ""))
    return F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all(bare, F.lit(r"[a-z]{3,}"), F.lit(0))), F.array(*map(F.lit, STOP_WORDS))))


def _capitals(word: Column) -> Column:
    runs = F.regexp_extract_all(word, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 20)))), "")


def display_name(label: Column) -> Column:
    """Label as shown: every run of letters capitalised, acronyms in their own case."""
    table = F.create_map(*[F.lit(x) for kv in ACRONYMS.items() for x in kv])
    words = F.filter(F.split(F.trim(F.coalesce(label, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.coalesce(table[F.lower(w)], _capitals(w))), " ")


def search_form(text: Column) -> Column:
    """Text for searching: no accents, lower case, trimmed; '' for null."""
    return F.trim(F.lower(fold_accents(F.coalesce(text, F.lit("")))))


def slug(form: Column) -> Column:
    """URL part of a :func:`search_form`; may be empty."""
    return F.regexp_replace(F.regexp_replace(form, "[^a-z0-9]+", "-"), "^-|-$", "")


def letter_of(form: Column) -> Column:
    """A to Z by the first letter of a :func:`search_form`, else ``#``."""
    first = F.upper(F.substring(form, 1, 1))
    return F.when(first.rlike("^[A-Z]$"), first).otherwise("#")


def page_path(node_id: Column, slug_: Column, repeated: Column) -> Column:
    """Path of a node's page: its slug; with the id where the slug is shared; the id alone where there is none."""
    bare = F.regexp_replace(node_id, "^dz_", "")
    return F.concat(F.lit("/artist/"), F.when(slug_ == "", bare).when(repeated, F.concat_ws("-", slug_, bare)).otherwise(slug_), F.lit("/"))


def https(url: Column) -> Column:
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)


# Fixed value: hash of the placeholder picture.
PLACEHOLDER_IMAGE = "d41d8cd98f00b204e9800998ecf8427e"


def thumbnail_url(url: Column) -> Column:
    """Small picture of a node; '' for null and the placeholder."""
    u = https(F.trim(url))
    small = F.regexp_replace(u, "^(.*?)\\d+x\\d+-", "$164x64-")
    return F.when(url.isNull() | F.contains(url, F.lit(PLACEHOLDER_IMAGE)), "").when(F.contains(u, F.lit("dzcdn.net")), small).otherwise(u)


def large_url(url: Column) -> Column:
    """Large picture of a node, by the rules of its host; '' for null."""
    u = https(F.trim(url))
    out = F.when(url.isNull() | (url == ""), "")
    out = out.when(F.contains(u, F.lit("dzcdn.net")), F.regexp_replace(u, "^(.*?)\\d+x\\d+-", "$1500x500-"))
    google = F.contains(u, F.lit("googleusercontent.com")) | F.contains(u, F.lit("ggpht.com"))
    out = out.when(google, F.concat(F.substring_index(u, "=", 1), F.lit("=s512-c-k-c0x00ffffff-no-rj")))
    return out.when(F.contains(u, F.lit("mzstatic.com")), F.regexp_replace(u, "^(.*?)\\d+x\\d+bb", "$1600x600bb")).otherwise(u)


def escape_html(text: Column) -> Column:
    out = text
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


@F.pandas_udf(T.StringType())
def unescape_html(s: pd.Series) -> pd.Series:
    """Text with its named and numbered character references resolved."""
    return s.map(lambda v: v if v is None or "&" not in v else html.unescape(v))


def possessive(name: Column) -> Column:
    return F.concat(name, F.when(name.rlike("(?i)s$"), "'").otherwise("'s"))


def fit(sentences: Column, most: int = 160) -> Column:
    """Sentences in order up to the first that would exceed ``most`` characters; always the first."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def step(acc: Column, s: Column) -> Column:
        longer = F.when(acc["text"] == "", s).otherwise(F.concat_ws(" ", acc["text"], s))
        stop = acc["full"] | ((acc["text"] != "") & (F.length(longer) > most))
        return F.struct(F.when(stop, acc["text"]).otherwise(longer).alias("text"), stop.alias("full"))

    return F.aggregate(sentences, start, step, lambda acc: acc["text"])


def inception(year: Column, precision: Column) -> Column:
    """"1965", "1960s", "9th century", "1999 BCE" from a year and its precision (9 year, 8 decade, else century)."""
    y, era = F.abs(year), F.when(year < 0, " BCE").otherwise("")
    century = F.ceil(y / 100).cast("int")
    ending = F.when((century % 100).between(11, 13), "th").otherwise(
        F.element_at(F.create_map(F.lit(1), F.lit("st"), F.lit(2), F.lit("nd"), F.lit(3), F.lit("rd")), century % 10))
    return (
        F.when(precision >= 9, F.concat(y.cast("string"), era))
        .when(precision == 8, F.concat((F.floor(y / 10) * 10).cast("string"), F.lit("s"), era))
        .otherwise(F.concat(century.cast("string"), F.coalesce(ending, F.lit("th")), F.lit(" century"), era))
    )


def filter_label(place: Column, low: Column, high: Column, links: Column) -> Column:
    """Short text of the active filters: place, rank slice and share of links; "Filters" where there is none."""
    ranks = (
        F.when(low.isNull() | ((low <= 0) & (high >= 100)), None)
        .when(low <= 0, F.format_string("Top %d%%", high)).when(high >= 100, F.format_string("Top %d%%–100%%", low))
        .otherwise(F.format_string("%d%%–%d%%", low, high))
    )
    strong = F.when(links > 0, F.format_string("Connections: Top %d%%", 100 - links))
    return F.coalesce(F.nullif(F.concat_ws(" · ", place, ranks, strong), F.lit("")), F.lit("Filters"))


def map_link(params: dict[str, Column]) -> Column:
    """Fragment link to a view: form-encoded parameters in order."""
    pairs = [F.concat(F.lit(f"{k}="), F.url_encode(v)) for k, v in params.items()]
    return F.concat(F.lit("/#"), F.concat_ws("&", *pairs))


def view_of(href: Column) -> Column:
    """Parameters of a link made by :func:`map_link`: a map of names to values, the last of a name; empty without any."""
    pairs = F.filter(F.split(F.regexp_replace(href, "^[^#]*#?", ""), "&"), lambda p: p != "")
    one = F.transform(pairs, lambda p: F.struct(F.url_decode(F.substring_index(p, "=", 1)).alias("k"), F.url_decode(F.regexp_replace(p, "^[^=]*=?", "")).alias("v")))
    last = F.filter(one, lambda x, i: ~F.exists(F.slice(one, i + 2, F.size(one)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def separation(hops: Column) -> Column:
    """Text of a path's length; null hops are no path."""
    some = F.when(hops == 0, "Same artist").when(hops == 1, "1 degree of separation").otherwise(F.concat(hops.cast("string"), F.lit(" degrees of separation")))
    return F.when(hops.isNull(), "No connection found").otherwise(some)


def collation_key(text: Column, folded: bool = False) -> Column:
    """Sort key regardless of case and accents, with runs of digits in order of their numbers (up to 20 digits)."""
    low = F.lower(text if folded else fold_accents(text))
    return F.regexp_replace(F.regexp_replace(low, r"(\d+)", "0" * 20 + "$1"), r"0+(\d{20})(?!\d)", "$1")


def clock(secs: Column) -> Column:
    """Minutes and seconds, "3:07"."""
    s = F.floor(secs).cast("int")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def last_path_part(uri: Column) -> Column:
    return F.substring_index(uri, "/", -1)


def year_of(iso: Column) -> Column:
    """Year of an ISO date, negative before the common era; null where there is none."""
    return F.nullif(F.regexp_extract(iso, r"^(-?\d+)-", 1), F.lit("")).try_cast("int")
