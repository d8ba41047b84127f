"""Positions of regular expression matches as SQL expressions.

Spark returns the matched strings and, by a split, what lies between them. Their lengths, added
up in order, are the positions, in code points. Matches are summed in blocks, so a text with
very many of them does not cost their square.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


_SPAN = "array<struct<start:int,end:int,hit:string,before:string,after:string>>"


def _running(items: Column) -> Column:
    """struct(at, out): `items` (gap, size, hit, before, after) summed up in order, `out` with
    their positions."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["size"]
        span = F.struct(
            begin.alias("start"), end.alias("end"), *[x[c].alias(c) for c in ("hit", "before", "after")]
        )
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(items, start, step)


def _starts(sizes: Column) -> Column:
    """The sum of what precedes each element of an int array, and the whole sum at its end."""
    return F.aggregate(
        sizes,
        F.array(F.lit(0)),
        lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)),
    )


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def match_spans(text: Column, pattern: str, before: int = 0, after: int = 0) -> Column:
    """array<struct<start, end, hit, before, after>>: leftmost non-overlapping matches.

    Positions are in code points, the end exclusive. `before` and `after` hold at most so many
    characters of what stands between a match and its neighbours. `text` must not be null and
    `pattern` must not match the empty string.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def interleaved(gaps: Column) -> Column:
        return F.zip_with(
            F.zip_with(hits, gaps, lambda h, g: F.struct(h.alias("hit"), g.alias("gap"))),
            F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0))),
            lambda x, g: F.struct(
                F.length(x["gap"]).alias("gap"),
                F.length(x["hit"]).alias("size"),
                x["hit"].alias("hit"),
                (F.substring(x["gap"], -before, before) if before else F.lit("")).alias("before"),
                (F.substring(g, 1, after) if after else F.lit("")).alias("after"),
            ),
        )

    # the last gap has no match
    items = F.filter(
        _let(F.split(text, pattern, -1), interleaved), lambda x: x["hit"].isNotNull()
    )

    def blocks(all_items: Column) -> Column:
        last = F.floor((F.size(all_items) - 1) / BLOCK).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last), lambda b: _running(F.slice(all_items, b * BLOCK + 1, F.lit(BLOCK)))
        )

    def moved(parts: Column) -> Column:
        ahead = _starts(F.transform(parts, lambda p: p["at"]))

        def shift(starts: Column) -> Column:
            return F.flatten(
                F.zip_with(
                    parts,
                    starts,
                    lambda p, s: F.transform(
                        p["out"],
                        lambda x: F.struct(
                            (x["start"] + s).alias("start"),
                            (x["end"] + s).alias("end"),
                            *[x[c].alias(c) for c in ("hit", "before", "after")],
                        ),
                    ),
                )
            )

        # as many starts as blocks; the whole sum is left out
        return _let(ahead, lambda a: shift(F.slice(a, 1, F.size(parts))))

    none = F.array().cast(_SPAN)
    found = _let(
        items, lambda i: F.when(F.size(i) > 0, _let(blocks(i), moved)).otherwise(none)
    )
    return F.when(text.rlike(pattern), found).otherwise(none)


def span_text(spans: Column) -> Column:
    """`kind:start:end` of each, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def merged(spans: Column) -> Column:
    """Spans sorted by start, as array<struct<start, end>> without overlaps."""
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))),
        )
        return F.when((F.size(acc) > 0) & (x["start"] < last["end"]), joined).otherwise(
            F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))
        )

    return F.aggregate(spans, empty, step)


def replace_spans(text: Column, spans: Column, mark: str) -> Column:
    """`text` with `mark` in place of each of its spans (sorted by start, may overlap)."""

    def cut(flat: Column) -> Column:
        n = F.size(flat)
        pieces = F.transform(
            F.sequence(F.lit(0), n),
            lambda i: F.substring(
                text,
                F.when(i == 0, 0).otherwise(F.get(flat, i - 1)["end"]) + 1,
                F.when(i == n, F.length(text)).otherwise(F.get(flat, i)["start"])
                - F.when(i == 0, 0).otherwise(F.get(flat, i - 1)["end"]),
            ),
        )
        return F.array_join(pieces, mark)

    return F.when(F.size(spans) > 0, _let(merged(spans), cut)).otherwise(text)
