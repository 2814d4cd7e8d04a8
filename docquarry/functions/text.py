"""Text expressions. All are built from Spark's own functions, so they stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that end a sentence of a transcript.
SENTENCE_END = "。！？；!?;"
#: Character ranges that count as CJK, by the counter that uses them.
CJK_CONTEXT = r"[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]"
CJK_CHUNK = r"[\x{4E00}-\x{9FFF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]"
CJK_ANALYZER = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x3040, 0x30FF), (0xF900, 0xFAFF))
EMOJI_OR_SPACE = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\s]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def one_spaced(c: Column) -> Column:
    """Runs of Unicode white space become one space; none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def unix_lines(c: Column) -> Column:
    """CRLF and lone CR become LF."""
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def without_tags(c: Column) -> Column:
    """Tags dropped, then &amp; &lt; &gt; decoded in this order, then stripped. Bodies of
    scripts and styles stay."""
    text = F.regexp_replace(c, r"<[^>]+>", "")
    for entity, plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return strip(text)


def distinct_lines(c: Column) -> Column:
    """Each different line once, where it first stands."""
    return F.array_join(F.array_distinct(F.split(c, "\n", -1)), "\n")


def without_lines(c: Column, echoes: Column) -> Column:
    """Lines that equal, stripped, one of the array ``echoes`` (stripped, not blank) dropped."""
    blanked = F.filter(F.transform(echoes, strip), lambda e: e != "")
    return F.array_join(F.filter(F.split(c, "\n", -1), lambda x: ~F.coalesce(F.array_contains(blanked, strip(x)), F.lit(False))), "\n")


def only_emoji(c: Column) -> Column:
    return F.regexp_replace(c, EMOJI_OR_SPACE, "") == ""


def count_matches(c: Column, pattern: str) -> Column:
    return F.char_length(c) - F.char_length(F.regexp_replace(c, pattern, ""))


def token_estimate(c: Column, cjk: str = CJK_CONTEXT) -> Column:
    """Tokens without a tokenizer: two for each CJK character, one for each four others, and one."""
    n = count_matches(c, cjk)
    return (2 * n + F.floor((F.char_length(c) - n) / 4) + 1).cast("long")


def speech_token_estimate(c: Column) -> Column:
    """CJK characters, plus words or quarters of the other visible characters, if more."""
    cjk = count_matches(c, CJK_CONTEXT)
    other = F.char_length(F.regexp_replace(c, r"(?U)[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\s]", ""))
    words = F.regexp_count(c, F.lit("[A-Za-z0-9]+"))
    return F.greatest(F.lit(1), cjk + F.greatest(words, F.ceil(other / 4))).cast("long")


def sentences(c: Column) -> Column:
    """Sentences with their closing marks, stripped. Runs of marks or line ends close one, and
    so do full stops before white space or the end; what would have one visible character at
    most goes to the next. A text without any is its own one sentence."""
    parts = _sentence_parts(c)
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, part: Column) -> Column:
        now = F.concat(acc.open, part)
        closed = F.char_length(strip(now)) > 1
        return F.struct(F.when(closed, "").otherwise(now).alias("open"), F.when(closed, F.concat(acc.done, F.array(strip(now)))).otherwise(acc.done).alias("done"))

    found = F.aggregate(parts, start, step, lambda acc: F.when(strip(acc.open) != "", F.concat(acc.done, F.array(strip(acc.open)))).otherwise(acc.done))
    return F.when(F.size(found) > 0, found).otherwise(F.array(strip(c)))


def _sentence_parts(c: Column) -> Column:
    """Pieces up to and with their closing marks. Runs of other characters are taken at once, and
    a full stop is looked at where it stands only."""
    inside = f"(?:[^{SENTENCE_END}\n.]++|\\.(?!\\.*+(?:\\s|\\z)))*+"
    return F.regexp_extract_all(c, F.lit(f"(?U)(?s).{inside}(?:[{SENTENCE_END}\n]++|\\.++(?=\\s|\\z)|\\z)"), F.lit(0))


def sentence_count(c: Column) -> Column:
    """The number of ``sentences``, without making them: the fold carries what is open and a number."""
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("done"))

    def step(acc: Column, part: Column) -> Column:
        now = F.concat(acc.open, part)
        closed = now.rlike(r"(?U)\S\s*+\S")  # two visible characters
        return F.struct(F.when(closed, "").otherwise(now).alias("open"), (acc.done + closed.cast("int")).alias("done"))

    found = F.aggregate(_sentence_parts(c), start, step, lambda acc: acc.done + acc.open.rlike(r"(?U)\S").cast("int"))
    return F.greatest(found, F.lit(1))  # named once, so computed once


def topic_slices(c: Column, size: int = 500) -> Column:
    """Retrieval entries of a topic: its distinct sentences, cut to ``size`` characters."""
    parts = F.transform(F.split(c, r"[\n。！？；]+"), lambda s: F.btrim(s, F.lit(" ，。！？；:：")))
    kept = F.filter(parts, lambda s: s != "")
    return F.array_distinct(F.flatten(F.transform(kept, lambda s: slices(s, size))))


def slices(c: Column, size: int) -> Column:
    """Array of consecutive slices of ``size`` characters; none of an empty text."""
    starts = F.when(F.char_length(c) > 0, F.sequence(F.lit(0), F.char_length(c) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(c, i + 1, F.lit(size)))


def snippet(c: Column, size: int = 500) -> Column:
    return F.substring(c, 1, size)


def short_title(c: Column, size: int = 20) -> Column:
    return F.when(F.char_length(c) <= size, c).otherwise(F.concat(F.substring(c, 1, size), F.lit("…")))


def redacted(c: Column, secret: str | None = None) -> Column:
    """Credentials in log lines replaced: signature and nonce headers, bearer tokens, session
    cookies, and ``secret`` itself if given."""
    if secret:
        c = F.replace(c, F.lit(secret), F.lit("[REDACTED]"))
    for kept, value in (("X-Signature[:=]\\s*", "[\\w+/=-]+"), ("X-Nonce[:=]\\s*", "[\\w+/=-]+"), ("Authorization[:=]\\s*Bearer\\s+", "[\\w.~+/=-]+"), ("\\w*session=", "[^;,\\s]+")):
        c = F.regexp_replace(c, f"({kept}){value}", "$1[REDACTED]")
    return c


def json_object(c: Column) -> Column:
    """From the first ``{`` to the last ``}``, null without one."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def citations(c: Column, count: Column) -> Column:
    """Distinct citation numbers ``[n]`` or ``【n】`` between 1 and ``count``, in order."""
    found = F.regexp_extract_all(c, F.lit(r"[\[【](\d{1,6})[\]】]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: x.cast("int")), lambda n: (n >= 1) & (n <= count)))


def bigrams(c: Column) -> Column:
    """The different pairs of neighbouring characters; the text is cut into characters once, so
    the cost is linear."""
    chars = F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    pairs = F.greatest(F.size(chars) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(chars, F.lit(1), pairs), F.slice(chars, F.lit(2), pairs), lambda a, b: F.concat(a, b)))


def dice(query: Column, content: Column, query_pairs: Column, content_pairs: Column) -> Column:
    """Lexical score of normalised texts, given their ``bigrams``: 1 if contained, else Dice
    over these sets; 0 if either is empty, equality if either has one character."""
    n = F.size(query_pairs) + F.size(content_pairs)
    overlap = F.when(n > 0, 2.0 * F.size(F.array_intersect(query_pairs, content_pairs)) / n).otherwise(0.0)
    return (
        F.when((query == "") | (content == ""), 0.0)
        .when(F.contains(content, query), 1.0)
        .when((F.char_length(query) == 1) | (F.char_length(content) == 1), (query == content).cast("double"))
        .otherwise(overlap)
    )


def letters_and_digits(c: Column) -> Column:
    """Lower-cased, nothing but letters and digits (no compatibility folding, see ``unicode``)."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
