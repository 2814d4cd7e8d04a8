"""Citations of an answer outside of markup: protected spans are taken out before the marks
inside them can count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The forms of citations, and the elements that have no closing tag.
CITATION = r"【\d+】|【\d+(?:##\d+)*#】?|\[\d+\]|\[\d+(?:##\d+)*#\]?"
VOID_ELEMENTS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
_CODE = r"```(?:(?!```)[\s\S])*+(?:```|\z)|`[^`\n]++`"
_SPECIAL = r"<!--(?:(?!-->)[\s\S])*+(?:-->|\z)|<!\[CDATA\[(?:(?!\]\]>)[\s\S])*+(?:\]\]>|\z)|<\?(?:(?!\?>)[\s\S])*+(?:\?>|\z)|<![^>]*+(?:>|\z)"
_TAG = r"</?[A-Za-z][A-Za-z0-9:-]*+(?=[\s/>])(?:[^>\"']++|\"[^\"]*+(?:\"|\z)|'[^']*+(?:'|\z))*+(?:>|\z)"
_LINK = r"!?\[(?:[^\[\]]|\[[^\[\]]*+\])*+\]\([^()\s]*+(?:\s++\"[^\"]*+\")?\)|https?://[^\s<>【】]++"
#: The leftmost match wins, so a mark inside a protected span is never looked at. Where none
#: can begin, one class says so.
_TOKEN = f"(?=[`<!\\[h【])(?:{_CODE}|{_SPECIAL}|{_TAG}|{_LINK}|{CITATION})"


def citation_numbers(c: Column, count: Column) -> Column:
    """The numbers that an answer cites, in order and with repeats: ``[n]``, ``【n】`` and the older
    chains ``[1##2#]``; a mark counts only if all its numbers lie between 1 and ``count``.
    Code, links, addresses, comments, tags and whole elements (an opening tag with its
    closing one) are protected; an opening tag that is never closed protects only itself.
    Null for a null answer, none for a null count.

    One expression: tokens, then a fold from the end that finds which tags are closed, then one
    from the start that skips the spans. Its state holds tags and numbers, not text."""
    tokens = F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(0))
    name = lambda t: F.lower(F.regexp_extract(t, r"^</?([A-Za-z][A-Za-z0-9:-]*)", 1))
    kinds = F.transform(tokens, lambda t: F.struct(
        t.alias("t"), F.when(t.rlike(r"^</?[A-Za-z]"), name(t)).otherwise("").alias("element"), t.startswith("</").alias("closing"),
        t.rlike(r"/\s*>$").alias("alone"), t.rlike(f"^(?:{CITATION})$").alias("cites"),
    ))
    opens = lambda k: (k.element != "") & ~k.closing & ~k.alone
    shape = "struct<ends:array<string>,paired:array<boolean>>"
    empty = F.struct(F.array().cast("array<string>").alias("ends"), F.array().cast("array<boolean>").alias("paired")).cast(shape)

    def back(a: Column, k: Column) -> Column:
        at = F.array_position(a.ends, k.element)  # the nearest end of that name comes first
        known = opens(k) & (at > 0)
        without = F.concat(F.slice(a.ends, F.lit(1), (at - 1).cast("int")), F.slice(a.ends, (at + 1).cast("int"), F.greatest(F.size(a.ends), F.lit(1))))
        ends = F.when(k.closing & (k.element != ""), F.concat(F.array(k.element), a.ends)).when(known, without).otherwise(a.ends)
        return F.struct(ends.alias("ends"), F.concat(a.paired, F.array(known & ~k.element.isin(*VOID_ELEMENTS))).alias("paired")).cast(shape)

    paired = F.reverse(F.aggregate(F.reverse(kinds), empty, back, lambda a: a.paired))
    both = F.zip_with(kinds, paired, lambda k, p: F.struct(k.alias("k"), p.alias("p")))
    state = "struct<inside:string,depth:int,ids:array<int>>"
    start = F.struct(F.lit("").alias("inside"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("ids")).cast(state)

    def ahead(a: Column, x: Column) -> Column:
        k = x.k
        free = a.inside == ""
        numbers = F.transform(F.regexp_extract_all(k.t, F.lit(r"\d+"), F.lit(0)), lambda n: n.try_cast("int"))
        good = F.coalesce(F.forall(numbers, lambda n: F.coalesce(n.between(1, count), F.lit(False))), F.lit(False))
        ids = F.when(free & k.cites & good, F.concat(a.ids, numbers)).otherwise(a.ids)
        step = F.when(k.element != a.inside, 0).when(k.closing, -1).when(~k.alone, 1).otherwise(0)
        depth = F.when(free, x.p.cast("int")).otherwise(a.depth + step)
        inside = F.when(free & x.p, k.element).when(depth == 0, "").otherwise(a.inside)
        return F.struct(inside.alias("inside"), depth.alias("depth"), ids.alias("ids")).cast(state)

    return F.aggregate(both, start, ahead, lambda a: a.ids)
