"""Values, times, URLs and identifiers as Spark expressions."""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import json
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

#: Words that read as true or false.
TRUE_WORDS = ("true", "1", "yes", "y", "是", "真")
FALSE_WORDS = ("false", "0", "no", "n", "否", "假")


def to_boolean(c: Column) -> Column:
    word = F.lower(strip(c))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def to_number(c: Column) -> Column:
    """Double; null where it is none (spaces around and ``_`` between digits are allowed)."""
    return F.regexp_replace(strip(c), r"(?<=\d)_(?=\d)", "").try_cast("double")


def canonical_number(c: Column) -> Column:
    """A decimal, or its text, as text without an exponent or trailing zeros. Texts without an exponent
    keep all digits; with one, what a decimal of 18 places (or of none) holds."""
    t = strip(c.cast("string"))
    at = F.coalesce(t.try_cast("decimal(38,18)").cast("string"), t.try_cast("decimal(38,0)").cast("string"))
    text = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), F.regexp_replace(F.regexp_replace(t, r"^\+", ""), r"^(-?)0*(?=\.)", "$10")).otherwise(at)
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", ""), r"^(-?)0+(?=\d)", "$1")
    return F.when(short == "-0", "0").otherwise(short)


def utc_datetime(c: Column) -> Column:
    """An ISO date-time in UTC to the second, with its offset written out; null if it is none."""
    at = F.try_to_timestamp(c)
    return F.date_format(F.convert_timezone(F.expr("current_timezone()"), F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def filter_value(kind: Column, value: Column, folded: Column | None = None) -> Column:
    """(value_type, normalized_value, numeric_value, datetime_value) of a filterable scalar
    given as text with its kind; containers and unknown kinds give null. Date-times are
    brought to UTC. ``folded`` is the text under compatibility folding (``unicode.nfkc``), which
    strings are compared by; without it they are taken as they are."""
    number, at = value.try_cast("double"), utc_datetime(value)
    norm = (
        F.when(kind == "null", "").when(kind == "number", canonical_number(value)).when(kind == "boolean", F.lower(value))
        .when(kind == "datetime", at).otherwise(value if folded is None else folded)
    )
    return F.when(
        kind.isin("null", "boolean", "number", "string", "datetime"),
        F.struct(kind.alias("value_type"), norm.alias("normalized_value"), F.when(kind == "number", number).alias("numeric_value"), F.when(kind == "datetime", at).alias("datetime_value")),
    )


def clock(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from one hour on."""
    s = F.floor(seconds).cast("long")
    two = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    short = F.concat_ws(":", two(F.floor(s / 60) % 60), two(s % 60))
    return F.when(s >= 3600, F.concat_ws(":", two(F.floor(s / 3600)), short)).otherwise(short)


def clock_seconds(c: Column) -> Column:
    """Seconds of ``SS``, ``MM:SS`` or ``HH:MM:SS`` with ``.`` or ``,`` before fractions."""
    parts = F.reverse(F.split(F.replace(c, F.lit(","), F.lit(".")), ":"))
    at = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("double"), F.lit(0.0))
    return at(0) + 60 * at(1) + 3600 * at(2)


def epoch_or_zero(c: Column) -> Column:
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(c)), F.lit(0)).cast("long")


def chunk_id(doc: Column, index: Column, content: Column) -> Column:
    return F.concat_ws(":", doc.cast("string"), index.cast("string"), F.substring(F.sha2(content, 256), 1, 16))


def record_chunk_id(doc: Column, record: Column, ordinal: Column, content: Column, embedding_text: Column) -> Column:
    digest = F.substring(F.sha2(F.concat(content, F.lit("\0"), embedding_text), 256), 1, 12)
    return F.concat_ws(":", doc.cast("string"), record, ordinal.cast("string"), digest)


def chunk_index(chunk_id: Column) -> Column:
    return F.split_part(chunk_id, F.lit(":"), F.lit(2)).try_cast("int")


def chunk_offset(chunk_id: Column) -> Column:
    return F.coalesce(F.regexp_extract(chunk_id, r"#(\d+)$", 1).try_cast("int"), F.lit(0))


def fallback_record_id(source_hash: Column, pointer: Column, record_type: Column) -> Column:
    return F.sha2(F.concat_ws("\0", source_hash, pointer, record_type), 256)


def normalized_url(c: Column) -> Column:
    """Scheme and host in lower case, no ``www.``, no trailing slashes, query pairs sorted by
    key (stable by value), fragment dropped. Percent-encoding is left as it is."""
    part = lambda i: F.regexp_extract(c, r"(?s)^([^:/?#]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", i)
    path = F.when(part(3).endswith("/"), F.coalesce(F.nullif(F.rtrim(part(3), F.lit("/")), F.lit("")), F.lit("/"))).otherwise(part(3))
    pairs = F.filter(F.split(part(4), "&"), lambda p: p != "")
    query = F.array_join(F.transform(F.array_sort(F.transform(pairs, lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("k"), p.alias("p")))), lambda s: s.p), "&")
    return F.concat(F.lower(part(1)), F.lit("://"), F.regexp_replace(F.lower(part(2)), r"^www\.", ""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


#: Host fragments of the video sources, by name, and the start of one more host.
VIDEO_HOSTS = {
    "weixin": ("weixin.qq.com", "finder.video.qq.com"),
    "bilibili": ("bilibili.com", "b23.tv"),
    "douyin": ("douyin.com", "iesdouyin.com"),
    "youtube": ("youtube.com", "youtu.be"),
}
WEIXIN_START = "sph"


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[^:/?#]+://([^/?#]*)", 1))


def source_class(c: Column) -> Column:
    """Class of a video's source by the host of an http(s) URL; what is no such URL is ``local``."""
    host = F.lower(F.regexp_extract(strip(F.coalesce(c, F.lit(""))), r"^https?://([^/]+)", 1))
    kind = F.when(host == "", "local")
    for name, parts in VIDEO_HOSTS.items():
        for p in parts:
            kind = kind.when(F.contains(host, F.lit(p)), name)
        if name == "weixin":
            kind = kind.when(host.startswith(WEIXIN_START), name)
    return kind.otherwise("other")


def video_id(c: Column) -> Column:
    """BV number, modal_id, id in the path, ``v=`` or short link; null if there is none."""
    tries = (r"(BV[0-9A-Za-z]{10})", r"[?&]modal_id=([^&#]+)", r"/(?:video|note)/(\d+)", r"[?&]v=([\w-]+)", r"youtu\.be/([\w-]+)")
    return F.coalesce(*(F.nullif(F.regexp_extract(c, t, 1), F.lit("")) for t in tries))


#: Networks that are not global, and parts of them that are.
NOT_GLOBAL = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
    "::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10",
)
STILL_GLOBAL = ("192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")


def _range(network: str) -> tuple[str, str]:
    """First and last address as hexadecimal digits; IPv4 as the 8 digits it has."""
    n = ipaddress.ip_network(network)
    digits = n.max_prefixlen // 4
    return tuple(f"{int(x):0{digits}x}" for x in (n.network_address, n.broadcast_address))


def ipv4_digits(c: Column) -> Column:
    """Eight hexadecimal digits of a dotted address, null if it is none (leading zeros are refused)."""
    part = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    digits = F.array_join(F.transform(F.split(c, r"\."), lambda p: F.lpad(F.lower(F.hex(p.try_cast("int"))), 2, "0")), "")
    return F.when(c.rlike(rf"^{part}\.{part}\.{part}\.{part}$"), digits)


def ipv6_digits(c: Column) -> Column:
    """32 hexadecimal digits of an IPv6 address, null if it is none. ``::`` stands for as many zero
    groups as are missing; the last two groups may be a dotted address."""

    def plain(text: Column) -> Column:
        tail = let(ipv4_digits(F.regexp_extract(text, r":([\d.]+)$", 1)), lambda t: F.concat(F.regexp_replace(text, r"[\d.]+$", ""), F.substring(t, 1, 4), F.lit(":"), F.substring(t, 5, 4)))
        return F.when(F.contains(text, F.lit(".")), tail).otherwise(text)

    groups = lambda h: F.when(h == "", F.array().cast("array<string>")).otherwise(F.split(h, ":", -1))

    def filled(halves: Column) -> Column:
        left, right = groups(F.get(halves, 0)), groups(F.get(halves, 1))
        missing = F.lit(8) - F.size(left) - F.size(right)
        return F.when(F.size(halves) == 1, left).when((F.size(halves) == 2) & (missing > 0), F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right))

    def digits(every: Column) -> Column:
        fine = (F.size(every) == 8) & F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(fine, F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    text = F.lower(F.regexp_replace(c, r"%.*$", ""))
    return let(let(let(text, plain), lambda t: let(F.split(t, "::", -1), filled)), digits)


def is_global(digits: Column) -> Column:
    """Whether an address (``ipv4_digits`` or ``ipv6_digits``) is global; addresses of one kind compare as texts. An
    IPv4 address in IPv6 form is judged as the former. Null stays null."""

    def judged(own: Column) -> Column:
        def within(networks: tuple[str, ...]) -> Column:
            return functools.reduce(operator.or_, [(F.char_length(own) == len(low)) & own.between(low, high) for low, high in map(_range, networks)])

        return ~within(NOT_GLOBAL) | within(STILL_GLOBAL)

    plain = lambda d: F.when((F.char_length(d) == 32) & d.startswith("0" * 20 + "ffff"), F.substring(d, 25, 8)).otherwise(d)
    return let(let(digits, plain), judged)


def is_public_url(c: Column) -> Column:
    """An http(s) URL whose host is a name other than localhost or a global address. Names are not
    resolved; numbers that are no address are refused."""
    host = F.lower(F.regexp_extract(c, r"(?i)^https?://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1))
    digits = lambda h: F.when(h.startswith("["), ipv6_digits(F.regexp_extract(h, r"^\[(.*)\]$", 1))).otherwise(ipv4_digits(h))
    named = lambda h: (h != "") & (h != "localhost") & ~h.endswith(".localhost")
    return let(host, lambda h: F.when(h.rlike(r"^\[|^[\d.]+$"), F.coalesce(is_global(digits(h)), F.lit(False))).otherwise(F.coalesce(named(h), F.lit(False))))


def media_cost(seconds: Column, tokens: Column) -> Column:
    """Price of a second of audio, and of a token."""
    return F.round(seconds * 0.00022 + tokens * 0.00010875, 4)


def half_up(c: Column, digits: int = 2) -> Column:
    return F.floor(c * 10**digits + 0.5) / 10**digits


def default_margin(cost: Column) -> Column:
    """Middle of the target range in per cent: 50 to 60 under a cost of 30, else 35 to 45."""
    return F.when(cost < 30, 55.0).otherwise(40.0)


def price_quote(cost: Column, rate: Column, commission: Column, promo: Column, margin: Column, msrp_multiple: Column) -> dict[str, Column]:
    """Buyer, platform and list price in the foreign currency and the profit at home, all
    rounded half up to 2 digits. Commission, promotion and margin are per cent; the first two
    are held within 0 to 95, the margin stays 5 under what the commission leaves and at most
    75. A rate that is not positive is replaced by 6.77, a cost by 0."""
    within = lambda c, high: F.least(F.greatest(c, F.lit(0.0)), high if isinstance(high, Column) else F.lit(high))
    cost, rate = F.greatest(cost, F.lit(0.0)), F.when(rate > 0, rate).otherwise(6.77)
    fee, cut = within(commission, 95.0) / 100, within(promo, 95.0) / 100
    most = half_up(F.least(F.lit(75.0), (1 - fee) * 100 - 5), 1)
    share = within(margin, most) / 100
    left = rate * (1 - fee - share)
    buyer = F.when(left > 0, cost / left).otherwise(0.0)
    gross = buyer * rate
    profit = gross * (1 - fee) - cost
    return {
        "buyer_price": half_up(buyer), "platform_price": half_up(buyer / (1 - cut)), "msrp": half_up(buyer * msrp_multiple), "profit": half_up(profit),
        "net_revenue": half_up(gross * (1 - fee)), "commission_amount": half_up(gross * fee), "margin": half_up(F.when(gross > 0, profit / gross * 100).otherwise(0.0)),
    }


#: Document states as stored, by the state shown.
SHOWN_STATES = {
    "pending": ("pending", "queued"),
    "running": ("running", "processing", "profiling", "previewing", "mapping", "chunking", "embedding", "indexing_lexical", "indexing_dense", "activating"),
    "awaiting_mapping": ("uploaded", "awaiting_mapping"),
    "done": ("done", "completed", "success"),
    "done_with_warnings": ("done_with_warnings",),
    "failed": ("failed", "error"),
    "deleting": ("deleting",),
}


def shown_state(c: Column) -> Column:
    lookup = F.create_map(*(F.lit(x) for shown, raw in SHOWN_STATES.items() for r in raw for x in (r, shown)))
    return F.coalesce(F.try_element_at(lookup, F.lower(c)), F.lit("pending"))


def http_error(status: Column) -> Column:
    """(code, retryable) of a failed HTTP call: only 429 and 5xx may be tried again."""
    code = (
        F.when(status.isin(401, 403), "MODEL_AUTH_FAILED").when(status == 404, "MODEL_NOT_FOUND").when(status == 429, "MODEL_RATE_LIMITED")
        .when(status >= 500, "MODEL_UPSTREAM_ERROR").when(status == 422, "MODEL_INVALID_REQUEST").otherwise("MODEL_UNEXPECTED")
    )
    return F.struct(code.alias("code"), ((status == 429) | (status >= 500)).alias("retryable"))


def frame_target(seconds: Column, most: int = 100) -> Column:
    """Frames to take from a video, by its length."""
    wanted = (
        F.when(seconds <= 0, 1).when(seconds <= 30, F.greatest(F.lit(12), F.bround(seconds).cast("int")))
        .when(seconds <= 60, 40).when(seconds <= 180, 60).when(seconds <= 600, 80).otherwise(most)
    )
    return F.least(wanted, F.lit(most))


def joined(c: Column, separator: str = ", ") -> Column:
    """Items of an array as one text; a null item reads ``None``."""
    return F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("None"))), separator)


def source_fingerprint(url: Column) -> Column:
    """24 hex digits that name a source: of its video id, or of its normalised URL."""
    return F.substring(F.sha2(F.concat(F.lit("url\0"), F.coalesce(video_id(url), normalized_url(url))), 256), 1, 24)


def is_safe_name(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[\w-][\w.-]{0,127}$") & ~F.contains(c, F.lit("..")), F.lit(False))


def starts_with_array(c: Column) -> Column:
    """Whether a JSON text's root is an array, by its first visible character in 64."""
    return F.substring(c, 1, 64).rlike(r"^\s*\[")


#: Permissions of local roles ("*" is all), and transforms by inferred type.
LOCAL_PERMISSIONS = {"user": ("project:view", "chat:use"), "account_admin": ("*",)}
TRANSFORMS_BY_TYPE = {
    "string": ("trim", "normalize_whitespace", "normalize_newlines", "strip_html", "to_number", "to_boolean", "parse_datetime"),
    "number": ("to_string", "to_boolean"), "boolean": ("to_string",), "array": ("join", "deduplicate", "remove_child_echo"),
    "object": (), "null": ("to_string",), "mixed": ("to_string",),
}


def may(role: Column, permission: Column) -> Column:
    own = F.create_map(*(x for r, p in LOCAL_PERMISSIONS.items() for x in (F.lit(r), F.array(*map(F.lit, p)))))
    held = F.coalesce(F.try_element_at(own, role), F.array().cast("array<string>"))
    return F.array_contains(held, "*") | F.array_contains(held, permission)


def allowed_transforms(kind: Column, applied: Column) -> Column:
    """Transforms for an inferred type that are not applied yet."""
    empty = F.array().cast("array<string>")
    by = F.create_map(*(x for k, names in TRANSFORMS_BY_TYPE.items() for x in (F.lit(k), F.array(*map(F.lit, names)) if names else empty)))
    return F.array_except(F.try_element_at(by, kind), applied)


def inferred_type(types: Column, container: Column, nulls: Column, observed: Column) -> Column:
    return (
        F.when(F.contains(types, F.lit(",")), "mixed").when(container.isin("array", "object"), container)
        .when((nulls > 0) & (nulls == observed), "null").otherwise("string")
    )


def trimmed_items(c: Column) -> Column:
    """Items of an array stripped, blank ones dropped; null is empty."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), strip), lambda x: x != "")


def captions_by_clock(c: Column) -> Column:
    """A map of time stamps to captions: blank captions dropped, times in clock form."""
    kept = F.map_filter(c, lambda k, v: strip(v) != "")
    time = lambda k: F.when(k.rlike(r"^\d+(:\d{1,2}){0,2}(\.\d+)?$"), clock(clock_seconds(k))).otherwise(strip(k))
    pairs = F.transform(F.map_entries(kept), lambda e: F.struct(time(e.key).alias("k"), strip(e.value).alias("v")))
    return F.aggregate(pairs, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p.k), F.create_map(p.k, p.v)))


def labelled_sections(*sections: tuple[str, Column]) -> Column:
    """Sections under their labels, joined by blank lines; empty ones are left out."""
    return F.concat_ws("\n\n", *(F.when(strip(text) != "", F.concat(F.lit(f"【{label}】\n"), text)) for label, text in sections))


def bullets(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")


def content_hash(title: Column, keywords: Column, content: Column) -> Column:
    """SHA-256 of title, keywords and content with a zero character between; null is empty."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.sha2(F.concat(text(title), F.lit("\0"), text(keywords), F.lit("\0"), text(content)), 256)


def definition_fingerprint(definition: dict) -> str:
    """SHA-256 of a definition as compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(definition, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


#: Unicode's white space and the separators U+001C to U+001F.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def is_iso_datetime(c: Column) -> Column:
    """Whether a text is an ISO date or date-time: calendar or week dates, basic or extended,
    any one character before a time of hours to fractions, and an offset. Every such text has a
    value in ``unicode.parsed_datetime``, which also takes odd fractions (``T0930.5``, ``T09301512``)."""
    t = F.replace(F.btrim(c, F.lit(SPACES)), F.lit("Z"), F.lit("+00:00"))
    day = r"(?:\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}(?:-[1-7])?|\d{4}W\d{2}[1-7]?)"
    hour, sixty, part = r"(?:[01]\d|2[0-3])", r"[0-5]\d", r"(?:[.,]\d+)?"
    clock = f"{hour}(?::{sixty}(?::{sixty}{part})?|{sixty}(?:{sixty}{part})?)?"
    shaped = t.rlike(f"(?s)^{day}(?:.{clock}(?:[+-]{clock})?)?$(?!\n)")
    digits = F.when(F.substring(t, 5, 1) == "-", F.concat(F.substring(t, 1, 4), F.substring(t, 6, 2), F.substring(t, 9, 2))).otherwise(F.substring(t, 1, 8))
    year, week = F.substring(t, 1, 4).try_cast("int"), F.when(F.contains(F.substring(t, 5, 2), F.lit("W")), F.regexp_extract(t, r"^\d{4}-?W(\d{2})", 1)).otherwise("")
    calendar = F.try_to_date(digits, "yyyyMMdd").isNotNull()
    last = F.weekofyear(F.make_date(F.when(year.between(1, 9999), year).otherwise(1), F.lit(12), F.lit(28)))
    real = F.when(week != "", week.try_cast("int").between(1, last)).otherwise(calendar) & (year >= 1)
    return F.coalesce(F.when(shaped, real), F.lit(False))
