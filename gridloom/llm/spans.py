"""Places of pattern matches in code points, by built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OUT = "array<struct<s:int,e:int,v:string,l:string,r:string>>"


def scanned(values: Column, join) -> Column:
    """Running results of ``join`` (associative, of an earlier and a later value) over an array.

    In round k every value is joined with the one 2 ** k places before it: n log n steps, and no array grows by single values.
    """

    def _round(acc, k):
        back = F.pow(F.lit(2.0), k).cast("int")
        return F.transform(acc, lambda x, i: F.when(i >= back, join(F.get(acc, i - back), x)).otherwise(x))

    rounds = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, values, _round)


def matches(text: Column, pattern: str, context: bool = False) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, match, text before, text after), the texts up to the matches beside it where ``context`` asks for them.

    The pieces between matches and the matches alternate, so places are running sums of their lengths.
    """
    both = F.array(F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("h")))

    def place(r):
        # the end of each match
        ends = scanned(F.transform(r["h"], lambda h, i: F.length(h) + F.length(F.get(r["p"], i))), lambda x, y: x + y)

        def span(h, i, ends):
            left, right = (F.get(r["p"], i), F.get(r["p"], i + 1)) if context else (F.lit(""), F.lit(""))
            end = F.get(ends, i)
            return F.struct((end - F.length(h)).alias("s"), end.alias("e"), h.alias("v"), left.alias("l"), right.alias("r"))

        return F.transform(F.array(ends), lambda ends: F.transform(r["h"], lambda h, i: span(h, i, ends)))[0]

    return F.when(text.rlike(pattern), F.transform(both, place)[0]).otherwise(F.array().cast(_OUT))


def overlapping(spans: Column, others: Column) -> Column:
    """For each of ``spans``, sorted and apart, whether one of ``others`` overlaps it: an array of booleans.

    Both are sorted into one array, others before spans that begin together. A span overlaps an
    other that begins before its end where one that began at or before it ends after its
    beginning, or where the next one begins before its end.
    """
    far = F.lit(2**31 - 1)
    event = lambda x, span: F.struct(x["s"].alias("s"), F.lit(span).alias("k"), x["e"].alias("e"))
    events = F.array(F.array_sort(F.concat(F.transform(others, lambda x: event(x, 0)), F.transform(spans, lambda x: event(x, 1)))))

    def found(ev):
        reach = scanned(F.transform(ev, lambda x: F.when(x["k"] == 0, x["e"]).otherwise(-1)), lambda x, y: F.greatest(x, y))
        ahead = F.reverse(scanned(F.reverse(F.transform(ev, lambda x: F.when(x["k"] == 0, x["s"]).otherwise(far))), lambda x, y: F.least(x, y)))
        marked = lambda rs: F.transform(F.filter(F.transform(ev, lambda x, i: F.struct(x.alias("x"), F.get(rs["a"], i).alias("a"), F.get(rs["b"], i).alias("b"))), lambda y: y["x"]["k"] == 1), lambda y: (y["a"] > y["x"]["s"]) | (y["b"] < y["x"]["e"]))
        return F.transform(F.array(F.struct(reach.alias("a"), ahead.alias("b"))), marked)[0]

    return F.when(F.size(others) > 0, F.transform(events, found)[0]).otherwise(F.transform(spans, lambda x: F.lit(False)))


def kinds(found: dict[str, Column]) -> Column:
    """Spans of several kinds as one array of (s, k, e, v), k the place of the kind, in order."""

    def of_kind(spans: Column, k: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["v"].alias("v")))

    return F.array_sort(F.concat(*(of_kind(spans, k) for k, spans in enumerate(found.values()))))


def listed(spans: Column, names: list[str]) -> Column:
    """``kind:start:end`` of sorted spans (s, k, e, ...), comma-joined."""
    name = F.array(*map(F.lit, names))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
