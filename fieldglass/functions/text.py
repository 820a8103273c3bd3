"""Columns over text: keys, addresses, publishers, contacts and narratives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Public suffixes of several labels. Fixed values.
SUFFIXES = ("co.uk", "org.uk", "gov.uk", "ac.uk", "com.au", "org.au", "co.nz", "com.br", "co.jp", "k12.mo.us", "k12.ks.us", "k12.co.us", "state.co.us", "state.mo.us", "state.ks.us")
#: Hosts of one publisher. Fixed values.
ALIASES = {"nschdata.org": "childhealthdata.org", "kschildrenscabinet.gov": "ks.gov"}


def area_key(name: Column) -> Column:
    """Letters of an area's name without its state, kind, and with all saints alike."""
    steps = ((r",.*$", ""), (r"\b(saint|sainte|ste)\b\.?", "st"), (r"\b(county|parish)\b", ""), (r"[^a-z]", ""))
    return reduce(lambda x, s: F.regexp_replace(x, *s), steps, F.lower(name))


def host(url: Column) -> Column:
    """The host in lower case without www and port; null where there is none."""
    found = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(F.regexp_replace(found, r"^www\.", ""), r"\.$", ""), F.lit(""))


def publisher(domain: Column) -> Column:
    """The registrable domain, about; the empty string where a host isn't one."""
    h = F.regexp_replace(F.regexp_replace(F.lower(F.trim(domain)), r"^www\.", ""), r"\.$", "")
    parts = F.filter(F.split(h, r"\."), lambda x: x != "")
    size = reduce(lambda out, s: F.when(h.endswith(f".{s}"), F.lit(s.count(".") + 2)).otherwise(out), reversed(SUFFIXES), F.lit(2))
    taken = F.array_join(F.slice(parts, F.greatest(F.size(parts) - size, F.lit(0)) + 1, size), ".")
    out = F.when(~h.rlike(r"^[a-z0-9.-]+$") | (F.size(parts) < 2), F.lit("")).otherwise(taken)
    return reduce(lambda x, kv: F.when(h == kv[0], F.lit(kv[1])).otherwise(x), ALIASES.items(), out)


def clean_url(url: Column) -> Column:
    """The address without fragment, tracking parameters and trailing slash, its scheme and host in lower case."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    rest = F.substring(bare, F.length(head) + 1, F.length(bare))
    path, question = F.substring_index(rest, "?", 1), F.when(F.contains(rest, F.lit("?")), F.regexp_replace(rest, r"^[^?]*\?", "")).otherwise(F.lit(""))
    kept = F.filter(F.split(question, "&"), lambda x: (x != "") & ~F.lower(x).rlike(r"^(utm_[^=]*|fbclid|gclid|msclkid|mc_cid|mc_eid)(=|$)"))
    path = F.regexp_replace(path, r"/+$", "")
    return F.when(head != "", F.concat(head, F.when(path == "", F.lit("/")).otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))))


#: Named entities. Fixed values.
ENTITIES = {"amp": "&", "quot": '"', "apos": "'", "lt": "<", "gt": ">", "nbsp": " ", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "hellip": "…", "middot": "·", "bull": "•", "copy": "©", "reg": "®", "trade": "™"}


def decoded(text: Column) -> Column:
    """Entities as characters, in one pass: what a decoded entity and its surroundings spell is left alone. Numbers of no character are kept as they are, those of surrogates become U+FFFD."""
    named = F.create_map(*(F.lit(x) for kv in ENTITIES.items() for x in kv))

    def piece(x: Column) -> Column:
        body = F.regexp_extract(x, "^(#[xX][0-9a-fA-F]+|#[0-9]+|[a-zA-Z]+);", 1)
        rest = F.substring(x, F.length(body) + 2, F.length(x))
        digits = F.regexp_replace(F.when(F.lower(body).startswith("#x"), F.substring(body, 3, 100)).otherwise(F.substring(body, 2, 100)), "^0+(?=.)", "")
        code = F.when(F.length(digits) > 7, F.lit(-1)).when(F.lower(body).startswith("#x"), F.conv(digits, 16, 10).cast("long")).otherwise(digits.try_cast("long"))
        valid = code.between(1, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(code.between(0xD800, 0xDFFF), F.lit(0xFFFD)).otherwise(code)), 8, "0")), "UTF-32")
        whole = F.concat(F.lit("&"), x)
        by_name = F.try_element_at(named, F.lower(body))
        return F.when(body == "", whole).when(body.startswith("#"), F.when(valid, F.concat(F.when(valid, char), rest)).otherwise(whole)).otherwise(F.coalesce(F.concat(by_name, rest), whole))

    return F.array_join(F.transform(F.split(text, "&"), lambda x, i: F.when(i == 0, x).otherwise(piece(x))), "")


def html_text(page: Column) -> Column:
    """What a page says, without comments, scripts, styles and tags, entities decoded."""
    steps = [(r"(?s)<!--.*?-->", " "), (r"(?is)<(script|style|noscript|template|svg)\b.*?</\1>", " "), (r"(?s)<[^>]+>", " ")]
    return F.trim(F.regexp_replace(decoded(reduce(lambda x, s: F.regexp_replace(x, *s), steps, page)), r"[\x20\x09-\x0D\u00a0]+", " "))


#: Addresses that are no mailboxes: files, placeholder domains, placeholder names. Fixed values.
NO_MAILBOX = (
    r"(?i)\.(png|jpe?g|gif|svg|webp|avif|ico|bmp|css|js|mjs|json|map|woff2?|ttf|eot|mp4|webm|pdf)$",
    r"(?i)@(example\.(com|org|net)|domain\.com|email\.com|yourdomain\.com|yoursite\.com|sentry\.io|[\w-]*sentry[\w.-]*|wixpress\.com)$",
    r"(?i)^(your|name|email|user|username|first\.?last|john\.?doe|jane\.?doe|test)@",
    r"@\d+x\.",
)
MAILBOX = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9-]+(?:\.[A-Z0-9-]+)*\.[A-Z]{2,24}"


def emails(html: Column, most: int = 10) -> Column:
    """The first distinct addresses in lower case, entities and mailto: addresses decoded, without those that are no mailboxes."""
    head = lambda x: F.regexp_extract(x, "^[^\"'?>\\s]+", 0)
    after = lambda x: F.when(head(x) == "", F.concat(F.lit("mailto:"), x)).otherwise(F.concat(F.lit(" "), F.coalesce(F.try_url_decode(F.replace(head(x), F.lit("+"), F.lit("%2B"))), head(x)), F.lit(" "), F.substring(x, F.length(head(x)) + 1, F.length(x))))
    source = F.array_join(F.transform(F.split(decoded(html), "(?i)mailto:"), lambda x, i: F.when(i == 0, x).otherwise(after(x))), "")
    found = F.transform(F.regexp_extract_all(source, F.lit(f"({MAILBOX})"), F.lit(1)), lambda x: F.regexp_replace(F.lower(x), r"^[._%+-]+", ""))
    kept = F.filter(found, lambda x: ~reduce(Column.__or__, (x.rlike(p) for p in NO_MAILBOX)) & (F.length(F.substring_index(x, "@", 1)) <= 64))
    return F.slice(F.array_distinct(kept), 1, most)


#: A number as it is written: with a separator before the last four digits. A fixed value.
PHONE = r"(?<!\d)(?:\+?1[\s.-]?)?(?:\(\d{3}\)|\d{3})[\s.-]?\d{3}[\s.-]\d{4}\b"


def phones(text: Column, most: int = 10) -> Column:
    """The first distinct ten-digit numbers as (999) 999-9999: no area or exchange begins with 0 or 1 or ends with 11, no digit ten times, no reserved 555-01xx."""
    digits = F.transform(F.regexp_extract_all(text, F.lit(f"({PHONE})"), F.lit(1)), lambda x: F.regexp_replace(F.regexp_replace(x, "[^0-9]", ""), r"^1(?=\d{10}$)", ""))
    bad = r"^[01]|^...[01]|^(\d)\1{9}$|^\d11|^...\d11|^...55501"
    kept = F.array_distinct(F.filter(digits, lambda x: (F.length(x) == 10) & ~x.rlike(bad)))
    return F.transform(F.slice(kept, 1, most), lambda x: F.concat(F.lit("("), F.substring(x, 1, 3), F.lit(") "), F.substring(x, 4, 3), F.lit("-"), F.substring(x, 7, 4)))


def slug(x: Column, most: int = 100) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, most)


def narrative(text: Column, most: int | None = 1500) -> Column:
    """What two copies of a text have in common: lower-case words without addresses and stock phrases, the first 1,500 characters of them (None: all)."""
    steps = ((r"https?://[^\x20\x09-\x0D]+", " "), (r"\b(copyright|all rights reserved|read more|click here)\b", " "), (r"[^a-z0-9 ]+", " "), (" +", " "))
    told = F.trim(reduce(lambda x, s: F.regexp_replace(x, *s), steps, F.lower(text)))
    return told if most is None else F.substring(told, 1, most)


def has_word(text: Column, term: str) -> Column:
    """Whether a lower-case text has the term as whole words."""
    import re

    return text.rlike(rf"(^|[^a-z0-9]){re.escape(term)}([^a-z0-9]|$)")


def age_years(text: Column) -> Column:
    """Years from text such as '2 YRS 6 MOS', '6 WKS' or '12', to two decimals; null where there is none, or a bare number over 21."""
    low = F.lower(F.trim(text))
    pattern = F.lit(r"([0-9]+(?:\.[0-9]+)?)\s*(y(?:ea)?rs?|y|mo(?:nth)?s?|m|w(?:ee)?ks?|w)\b")
    numbers, units = F.regexp_extract_all(low, pattern, F.lit(1)), F.regexp_extract_all(low, pattern, F.lit(2))
    per = lambda u: F.when(u.startswith("y"), 1.0).when(u.startswith("m"), 12.0).otherwise(52.0)
    parts = F.zip_with(numbers, units, lambda n, u: n.cast("double") / per(u))
    years = F.floor(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) * 100 + 0.5) / 100
    bare = F.when(low.rlike(r"^[0-9]{1,9}(\.[0-9]{1,9})?$"), low.try_cast("double"))
    return F.when(F.size(numbers) > 0, years).otherwise(F.when(bare <= 21, bare))
