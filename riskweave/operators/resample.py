"""Bootstrap intervals.

Every row gets an independent Poisson(1) count per resample, the distributed form of the
bootstrap. Equal rows are summed up first, and a group of c rows gets one Poisson(c) count. The
counts come from the group's own hash, so they do not depend on where or how often they are
drawn. They never become rows: a task draws the counts of its groups as a matrix and adds them
up per resample. Statistics that need an order are computed in score buckets, each of which
knows from a first pass what precedes it.

`drawn_rows` draws with replacement row by row instead, from md5("seed:window:r:block"), so any
engine gets the same rows. It makes n rows per resample; the `*_of_draws` functions take them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from riskweave.functions.scores import confidence, ratio
from riskweave.operators.ordered import row_positions
from riskweave.operators.ranking import (
    ranking_metrics,
    score_groups,
    weighted_calibration_error,
)
from riskweave.options import CI_LEVELS, PER
from riskweave.session import store

# one md5 holds two draws of 60 bits
PER_DIGEST = 2
# rows of a window beyond which 60 bits would draw unevenly by more than one in a million
MOST_ROWS = 2**40
# positions whose rows one task holds, and resamples that it counts for
PAGE = 1 << 18
SLAB = 32
# groups whose counts are held as one matrix
SLICE = 1024
# digests that a task draws and sorts as one array, and those drawn at a time
_BLOCKS = 1 << 23
_DIGESTS = 1 << 16
# rows that a task sends on at a time, or somewhat more
_OUT = 1 << 16


def drawn_rows(
    rows: DataFrame,
    columns: Sequence[str],
    resamples: int,
    seed: int,
    within: str | None = None,
    tie: str = "transaction_id",
) -> DataFrame:
    """(resample, within, *columns, w): how often each distinct row is drawn, n draws with
    replacement per resample and `within` window. Windows over 2^40 rows are an error."""
    parts = drawn_parts(rows, columns, resamples, seed, within, tie)
    keys = [c for c in parts.columns if c != "w"]
    return parts.groupBy(*keys).agg(F.sum("w").alias("w"))


def drawn_parts(
    rows: DataFrame,
    columns: Sequence[str],
    resamples: int,
    seed: int,
    within: str | None = None,
    tie: str = "transaction_id",
) -> DataFrame:
    """`drawn_rows` before the counts of equal rows are added up, enough for what sums them.

    Draws never become rows. A task draws some blocks of a resample and sends the positions that
    fall into one page of the window as an array. The rows of a page are sent as one array as well,
    once for some resamples at a time, to where those are counted page by page. So what is written
    is about four bits per draw, and the counts that leave a task are added up over all pages."""
    by = [within] if within else []
    if within:
        rows = rows.where(F.col(within).isNotNull())
    window = F.col(within).cast("string") if within else F.lit("")
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("_name", window)
    sizes = sizes.withColumn(
        "n",
        F.when(F.col("n") <= MOST_ROWS, F.col("n")).otherwise(
            F.raise_error(F.lit("too many rows to draw one by one")).cast("long")
        ),
    )
    blocks = F.ceil(F.col("n") / PER_DIGEST)
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    spread = (
        sizes.where("n > 0")
        .withColumn("_of", F.explode(F.sequence(F.lit(0), F.greatest(blocks - 1, F.lit(0)), F.lit(_BLOCKS))))
        .withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
        .withColumn("_to", F.least(F.col("_of") + _BLOCKS, blocks))
        .select(*by, "_name", "n", "resample", F.col("_of").cast("long"), F.col("_to").cast("long"))
        .repartition(tasks, *by, "resample", "_of")
    )

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for unit in b.to_dict("records"):
                head = f"{seed}:{unit['_name']}:{unit['resample']}:"
                drawn = np.concatenate(
                    [
                        _positions(head, at, min(at + _DIGESTS, unit["_to"]), unit["n"])
                        for at in range(unit["_of"], unit["_to"], _DIGESTS)
                    ]
                )
                drawn.sort()
                pages = np.arange(drawn[0] // PAGE, drawn[-1] // PAGE + 1, dtype=np.int64)
                cuts = np.r_[0, np.searchsorted(drawn, (pages[1:] * PAGE).astype(drawn.dtype)), len(drawn)]
                some = np.flatnonzero(cuts[1:] > cuts[:-1])
                held = [_squeezed(drawn[cuts[i] : cuts[i + 1]] % PAGE) for i in some]
                out = pd.DataFrame({"_page": pages[some], "_at": held})
                yield out.assign(resample=unit["resample"], **{c: unit[c] for c in by})

    kinds = {c: rows.schema[c].dataType.simpleString() for c in by}
    named = "".join(f", `{c}` {k}" for c, k in kinds.items())
    draws = spread.mapInPandas(draw, f"_page long, _at binary, resample int{named}").withColumn(
        "_slab", F.floor(F.col("resample") / SLAB).cast("int")
    )
    wanted = list(dict.fromkeys([*by, *columns]))
    placed = row_positions(rows.select(*dict.fromkeys([*wanted, tie])), [tie], "_position", by)
    paged = placed.select(
        *wanted,
        F.floor(F.col("_position") / PAGE).cast("long").alias("_page"),
        (F.col("_position") % PAGE).cast("int").alias("_place"),
    )

    def pack(page):
        """One row: the codes of the page's rows in their places, and its distinct rows."""
        import pyarrow as pa

        group, firsts = _row_groups(page.select(wanted))
        at = np.empty(page.num_rows, np.uint32)
        at[page["_place"].to_numpy()] = group
        known = page.select(wanted).take(pa.array(firsts)).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, known.schema) as out:
            out.write_table(known)
        if len(firsts) <= 1 << 16:
            at = at.astype(np.uint16)
        one = {"_page": page["_page"][:1], "_at": pa.array([zlib.compress(at.tobytes(), 1)], pa.binary())}
        one["_rows"] = pa.array([zlib.compress(sink.getvalue().to_pybytes(), 1)], pa.binary())
        return pa.table(one | {c: page[c][:1] for c in by})

    of_page = T.StructType(
        [T.StructField("_page", LongType()), T.StructField("_at", T.BinaryType()), T.StructField("_rows", T.BinaryType())]
        + [placed.schema[c] for c in by]
    )
    slabs = F.sequence(F.lit(0), F.lit((resamples - 1) // SLAB))
    pages = (
        paged.groupBy(*by, "_page")
        .applyInArrow(pack, of_page)
        .withColumn("_slab", F.explode(slabs))
        .withColumn("resample", F.lit(-1))
    )
    schema = StructType(
        [StructField("resample", IntegerType()), *[paged.schema[c] for c in wanted], StructField("w", LongType())]
    )

    def count(batches):
        """Counts of one page and resample after another. A page comes ahead of its draws."""
        import pyarrow as pa

        codes, known, held, held_of, made, size = None, None, [], -1, [], 0

        def counted():
            w = np.bincount(codes.take(np.concatenate(held)), minlength=known.num_rows)
            hit = np.flatnonzero(w)
            out = known.take(pa.array(hit))
            out = out.add_column(0, "resample", pa.array(np.full(len(hit), held_of, np.int32)))
            return out.append_column("w", pa.array(w[hit], pa.int64()))

        for b in batches:
            for resample, at, rows_ in zip(b["resample"].to_pylist(), b["_at"], b["_rows"]):
                if held and (resample != held_of or rows_.is_valid):
                    made.append(counted())
                    size, held = size + made[-1].num_rows, []
                    if size >= _OUT:
                        yield from pa.concat_tables(made).combine_chunks().to_batches()
                        made, size = [], 0
                if rows_.is_valid:
                    known = pa.ipc.open_stream(zlib.decompress(rows_.as_py())).read_all()
                    kind = np.uint16 if known.num_rows <= 1 << 16 else np.uint32
                    codes = np.frombuffer(zlib.decompress(at.as_py()), kind)
                else:
                    held_of = resample
                    held.append(_unsqueezed(at.as_py()))
        if held:
            made.append(counted())
        if made:
            yield from pa.concat_tables(made).combine_chunks().to_batches()

    keys = [*by, "_slab", "_page", "resample"]
    both = pages.select(*keys, "_at", "_rows").unionByName(draws.select(*keys, "_at", F.lit(None).cast("binary").alias("_rows")))
    # all pages of a window's slab meet in one task, neighbouring slabs in different ones
    task = F.pmod(F.xxhash64(*by) + F.col("_slab"), F.lit(tasks)) if by else F.pmod("_slab", F.lit(tasks))
    met = both.repartitionById(tasks, task.cast("int")).sortWithinPartitions(*keys)
    return met.mapInArrow(count, schema)


def _squeezed(places: np.ndarray) -> bytes:
    """Ascending places as gaps of one byte (255: more follows), in Huffman code."""
    gaps = np.diff(places.astype(np.int64), prepend=0)
    longer = gaps // 255
    out = np.full(len(gaps) + int(longer.sum()), 255, np.uint8)
    out[np.cumsum(longer + 1) - 1] = gaps % 255
    coder = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    return coder.compress(out) + coder.flush()


def _unsqueezed(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(zlib.decompress(data, -15), np.uint8)
    return np.cumsum(gaps, dtype=np.int64)[gaps < 255]


def _positions(head: str, first: int, last: int, n: int) -> np.ndarray:
    """The draws of blocks first to last - 1 from n positions: 60 bits each, two in an md5."""
    start, whole = hashlib.md5(head.encode()), []
    for block in range(first, last):
        one = start.copy()
        one.update(b"%d" % block)
        whole.append(one.digest())
    bits = np.frombuffer(b"".join(whole), ">u8").astype(np.uint64) >> np.uint64(4)
    kind = np.uint32 if n <= 1 << 32 else np.uint64
    return (bits % np.uint64(n)).astype(kind)[: n - PER_DIGEST * first]


def _row_groups(rows) -> tuple[np.ndarray, np.ndarray]:
    """The number of each Arrow row's group of equal rows, and a row of every group. Values that
    Spark holds for equal may be apart: counts are added up later."""
    import pyarrow.compute as pc

    group = np.zeros(rows.num_rows, np.int64)
    firsts = np.zeros(min(rows.num_rows, 1), np.int64)
    for column in rows.columns:
        coded = pc.dictionary_encode(column.combine_chunks(), null_encoding="encode")
        key = group * (len(coded.dictionary) + 1) + coded.indices.to_numpy()
        _, firsts, group = np.unique(key, return_index=True, return_inverse=True)
    return group, firsts


def _uniforms(keys: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """A number in (0, 1) for each key and resample: the SplitMix64 finaliser of their mix."""
    with np.errstate(over="ignore"):
        step = np.uint64(0x9E3779B97F4A7C15)
        base = keys.astype(np.int64).view(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed) * step
        z = base[:, None] + (np.arange(1, resamples + 1, dtype=np.uint64) * step)[None, :]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _poisson_steps(mean: int) -> np.ndarray:
    """Cumulative probabilities of a Poisson law up to where the rest is below double precision."""
    k = np.arange(int(mean + 12 * np.sqrt(mean) + 40))
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, len(k))))])
    return np.cumsum(np.exp(k * np.log(mean) - mean - logs))


def poisson_counts(keys: np.ndarray, sizes: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """Counts (groups x resamples, 64-bit) of groups of `sizes` rows. Small groups are looked up
    in the law's steps, all at once; for large ones a generator is seeded by their key."""
    out = np.empty((len(keys), resamples), np.int64)
    small = sizes <= 256
    if small.any():
        uniforms = _uniforms(keys[small], resamples, seed)
        part = np.empty(uniforms.shape, np.int64)
        for n in np.unique(sizes[small]):
            at = sizes[small] == n
            part[at] = np.searchsorted(_poisson_steps(int(n)), uniforms[at])
        out[small] = part
    for i in np.flatnonzero(~small):
        rng = np.random.Generator(np.random.Philox(key=[seed, int(keys[i]) & (2**64 - 1)]))
        out[i] = rng.poisson(float(sizes[i]), resamples)
    return out


def grouped(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(*columns, n, key): equal rows summed up, and the hash that their counts come from."""
    sums = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return sums.withColumn("key", F.xxhash64(*columns))


def poisson_sums(
    groups: DataFrame, sums: dict[str, Column], resamples: int, seed: int
) -> DataFrame:
    """(resample, *sums): each expression times the counts, added up over all groups. A task
    sends one row per resample."""
    names = list(sums)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(names), resamples))
        for b in batches:
            values = b[names].to_numpy(float)
            keys, sizes = b["_key"].to_numpy(np.int64), b["_size"].to_numpy(np.int64)
            for a in range(0, len(b), SLICE):
                z = slice(a, a + SLICE)
                total += values[z].T @ poisson_counts(keys[z], sizes[z], resamples, seed)
        yield pd.DataFrame(dict(zip(names, total))).assign(resample=np.arange(resamples))

    schema = ", ".join(f"{n} double" for n in names) + ", resample int"
    parts = groups.select(
        F.col("key").alias("_key"),
        F.col("n").alias("_size"),
        *[v.cast("double").alias(k) for k, v in sums.items()],
    )
    added = parts.mapInPandas(draw, schema)
    return added.groupBy("resample").agg(*[F.sum(n).alias(n) for n in names])


def _slices(rows: pd.DataFrame, resamples: int, seed: int):
    """Counts of a bucket's groups in order of score, some rows at a time."""
    rows = rows.sort_values(["score", "y", "key"])
    keys, sizes = rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    for a in range(0, len(rows), SLICE):
        z = slice(a, a + SLICE)
        yield rows.iloc[z], poisson_counts(keys[z], sizes[z], resamples, seed)


def _average_precision_part(rows, before_n, before_pos, resamples, seed) -> np.ndarray:
    """Sum over the scores of a bucket of (positives of a score) x (precision up to it)."""
    out = np.zeros(resamples)
    n, pos = before_n.astype(float), before_pos.astype(float)
    score, gained = None, np.zeros(resamples)

    def close():
        nonlocal out
        out += gained * np.divide(pos, n, out=np.zeros(resamples), where=n > 0)

    for part, counts in _slices(rows, resamples, seed):
        scores, y = part["score"].to_numpy(), part["y"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, scores[1:] != scores[:-1]])
        all_n = np.add.reduceat(counts, cuts, axis=0)
        all_pos = np.add.reduceat(counts * (y == 1)[:, None], cuts, axis=0)
        for i, at in enumerate(cuts):
            if score is None or scores[at] != score:
                close()
                score, gained = scores[at], np.zeros(resamples)
            n, pos = n + all_n[i], pos + all_pos[i]
            gained = gained + all_pos[i]
    close()
    return out


def _calibration_part(rows, before_n, total_n, bins, resamples, seed) -> np.ndarray:
    """(bins x 2 x resamples): score and label sums of the equal-count bins in this bucket. Bins
    follow (score, label); a group that crosses an edge is divided there."""
    out = np.zeros((bins, 2, resamples))
    small, longer = total_n // bins, total_n % bins
    at = before_n.astype(np.int64)
    edges = np.stack([b * small + np.minimum(b, longer) for b in range(bins + 1)])
    for part, counts in _slices(rows, resamples, seed):
        score, y = part["score"].to_numpy(float), part["y"].to_numpy(float)
        ends = at + np.cumsum(counts, axis=0)
        starts = ends - counts
        first, last = starts[0], ends[-1]
        for b in range(bins):
            hit = (edges[b] < last) & (edges[b + 1] > first)
            if hit.any():
                held = np.minimum(ends[:, hit], edges[b + 1][hit]) - np.maximum(starts[:, hit], edges[b][hit])
                held = np.maximum(held, 0)
                out[b, 0, hit] += score @ held
                out[b, 1, hit] += y @ held
        at = ends[-1]
    return out


def ranked_samples(
    groups: DataFrame, resamples: int, seed: int, bins: int | None = None
) -> DataFrame:
    """Per `ranking` and resample: n, pos and, without `bins`, average_precision; with them the
    calibration error `ece`.

    `groups` holds (ranking, score, y, n, key) in ascending order of score: what comes first is
    what has the smallest score, so the negative of a probability for average precision.
    """
    spark = groups.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = store(
        groups.select("ranking", "score", "y", "n", "key")
        .repartitionByRange(parts, "ranking", "score")
        .withColumn("bucket", F.spark_partition_id()),
        "resample",
    )

    def totals(rows: pd.DataFrame) -> pd.DataFrame:
        n = pos = np.zeros(resamples, np.int64)
        for part, counts in _slices(rows, resamples, seed):
            n = n + counts.sum(axis=0)
            pos = pos + counts[(part["y"] == 1).to_numpy()].sum(axis=0)
        return pd.DataFrame({"n": n, "pos": pos}).assign(
            ranking=rows["ranking"].iat[0], bucket=rows["bucket"].iat[0], resample=np.arange(resamples)
        )

    head = "ranking string, bucket int, resample int"
    sums = ranged.groupBy("ranking", "bucket").applyInPandas(totals, f"n long, pos long, {head}")
    sums = store(sums, "resample-sums")
    # a row per bucket and resample
    series = Window.partitionBy("ranking", "resample")
    ahead = series.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(
        "ranking",
        "bucket",
        "resample",
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("pos").over(ahead), F.lit(0)).alias("pos_before"),
        F.sum("n").over(series).alias("n_total"),
    )

    def finish(rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        before = before.sort_values("resample")
        n, pos, total = (before[c].to_numpy() for c in ("n_before", "pos_before", "n_total"))
        out = pd.DataFrame({"resample": np.arange(resamples)}).assign(ranking=before["ranking"].iat[0])
        if bins is None:
            return out.assign(bin=0, a=_average_precision_part(rows, n, pos, resamples, seed), b=0.0)
        found = _calibration_part(rows, n, total, bins, resamples, seed)
        return pd.concat([out.assign(bin=i, a=found[i, 0], b=found[i, 1]) for i in range(bins)])

    pieces = (
        ranged.groupBy("ranking", "bucket")
        .cogroup(carry.groupBy("ranking", "bucket"))
        .applyInPandas(finish, "resample int, ranking string, bin int, a double, b double")
    )
    keys = ["ranking", "resample"]
    whole = sums.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    added = pieces.groupBy(*keys, "bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    if bins is None:
        value = added.select(*keys, "a").join(whole, keys)
        return value.select(*keys, "n", "pos", F.when(F.col("pos") > 0, F.col("a") / F.col("pos")).alias("average_precision"))
    gap = added.groupBy(*keys).agg(F.sum(F.abs(F.col("a") - F.col("b"))).alias("gap"))
    return gap.join(whole, keys).select(*keys, "n", "pos", ratio(F.col("gap"), F.col("n")).alias("ece"))


def intervals(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """Percentile interval per group of `value`; nulls are degenerate resamples. A group holds
    one value per resample, so the percentile buffer is bounded by the resample count."""
    lo, hi = (F.percentile("value", F.lit(q)) for q in CI_LEVELS)
    return samples.groupBy(*by).agg(
        lo.alias("ci_lower"),
        hi.alias("ci_upper"),
        (hi - lo).alias("ci_width"),
        F.stddev_samp("value").alias("std_error"),
        F.count_if(F.col("value").isNull()).alias("degenerate"),
    )


def _melt(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    entries = [F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names]
    return df.withColumn("_e", F.explode(F.array(*entries))).select(*keys, "_e.*")


def _headline(samples: DataFrame, rows: DataFrame) -> DataFrame:
    names = ["average_precision", "recall"]
    point = _melt(ranking_metrics(score_groups(rows)), [], names)
    return intervals(_melt(samples, ["resample"], names), ["metric"]).join(
        point.withColumnRenamed("value", "point"), "metric"
    )


def headline_bootstrap(scored: DataFrame, resamples: int, seed: int) -> DataFrame:
    """Average precision and recall at 0.5 with percentile intervals, one row per metric."""
    groups = store(grouped(scored, ["p", "y"]), "groups")
    ranking = groups.select(F.lit("p").alias("ranking"), (-F.col("p")).alias("score"), "y", "n", "key")
    ap = ranked_samples(ranking, resamples, seed)
    caught = ((F.col("p") >= 0.5) & (F.col("y") == 1)).cast("int")
    hits = poisson_sums(groups, {"hits": caught}, resamples, seed)
    samples = ap.join(hits, "resample").withColumn("recall", ratio(F.col("hits"), F.col("pos")))
    return _headline(samples, scored)


def headline_of_draws(scored: DataFrame, resamples: int, seed: int) -> DataFrame:
    """`headline_bootstrap` of rows drawn one by one."""
    drawn = drawn_parts(scored, ["p", "y"], resamples, seed)
    return _headline(ranking_metrics(score_groups(drawn, ["resample"], "w"), ["resample"]), scored)


def _both(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    scorers = F.array(
        F.struct(F.lit("incumbent").alias("scorer"), F.col("p_incumbent").alias("p")),
        F.struct(F.lit("challenger").alias("scorer"), F.col("p_challenger").alias("p")),
    )
    return scored.withColumn("_s", F.explode(scorers)).select(*keys, "_s.*")


def _delta(by: Sequence[str], ap: DataFrame) -> DataFrame:
    def of(name: str) -> Column:
        return F.max(F.when(F.col("scorer") == name, F.col("average_precision")))

    return ap.groupBy(*by).agg((of("challenger") - of("incumbent")).alias("value"))


def _paired(samples: DataFrame, scored: DataFrame) -> DataFrame:
    point = _delta([], ranking_metrics(score_groups(_both(scored, ["y"]), ["scorer"]), ["scorer"]))
    wins = F.avg(F.when(F.col("value").isNotNull(), (F.col("value") > 0).cast("double")))
    lo, hi = (F.percentile("value", F.lit(q)) for q in CI_LEVELS)
    return samples.agg(
        lo.alias("ci_lower"),
        hi.alias("ci_upper"),
        wins.alias("win_share"),
        ((lo > 0) | (hi < 0)).alias("excludes_zero"),
    ).withColumn("delta", point.scalar())


PAIR = ["y", "p_incumbent", "p_challenger"]


def paired_delta_bootstrap(scored: DataFrame, resamples: int, seed: int) -> DataFrame:
    """Challenger minus incumbent average precision on the same counts. `scored` holds
    (transaction_id, y, p_incumbent, p_challenger)."""
    both = _both(grouped(scored, PAIR), ["y", "n", "key"])
    ranking = both.select(F.col("scorer").alias("ranking"), (-F.col("p")).alias("score"), "y", "n", "key")
    ap = ranked_samples(ranking, resamples, seed).withColumnRenamed("ranking", "scorer")
    return _paired(_delta(["resample"], ap), scored)


def paired_delta_of_draws(scored: DataFrame, resamples: int, seed: int) -> DataFrame:
    """`paired_delta_bootstrap` of rows drawn one by one."""
    both = _both(drawn_parts(scored, PAIR, resamples, seed), ["resample", "y", "w"])
    keys = ["resample", "scorer"]
    return _paired(_delta(["resample"], ranking_metrics(score_groups(both, keys, "w"), keys)), scored)


POLICY = ["y", "amount", "a", "c", "q"]


def _policy_rows(scored: DataFrame, t: float) -> DataFrame:
    p = F.col("p")
    return scored.select(
        "transaction_id",
        "y",
        "amount",
        (p >= 0.5).alias("a"),
        ((confidence(p) >= t) & (p >= 0.5)).alias("c"),
        (confidence(p) < t).alias("q"),
    )


def _policy_sums() -> tuple[dict[str, Column], dict[str, Column]]:
    """Conditions whose rows are counted, and those whose amounts are added up."""
    fraud, a, c, q = F.col("y") == 1, F.col("a"), F.col("c"), F.col("q")
    counted = {
        "n": F.lit(True),
        "frauds": fraud,
        "fa_a": a & ~fraud,
        "fa_c": c & ~fraud,
        "flags_c": c,
        "hits_c": c & fraud,
        "queue": q,
        "queue_legit": q & ~fraud,
        "missed_a": ~a & fraud,
        "missed_c": ~c & ~q & fraud,
    }
    worth = {
        "amt": fraud,
        "amt_missed_a": ~a & fraud,
        "amt_missed_c": ~c & ~q & fraud,
        "amt_caught_c": c & fraud,
        "amt_surfaced_c": (c | q) & fraud,
        "amt_surfaced_a": a & fraud,
    }
    return counted, worth


def policy_bootstrap(scored: DataFrame, t: float, resamples: int, seed: int) -> DataFrame:
    """Intervals on the differences between one cut at 0.5 (A) and the review band at t (C),
    taken within each resample. A resample without fraud, without a false alert of A or without
    a flag of C is degenerate for every metric."""
    counted, worth = _policy_sums()
    amount = F.coalesce(F.col("amount"), F.lit(0.0))
    sums = {k: F.coalesce(v, F.lit(False)).cast("double") for k, v in counted.items()}
    sums |= {k: F.when(v, amount).otherwise(0.0) for k, v in worth.items()}
    groups = grouped(_policy_rows(scored, t), POLICY)
    return _policy_intervals(poisson_sums(groups, sums, resamples, seed))


def policy_of_draws(scored: DataFrame, t: float, resamples: int, seed: int) -> DataFrame:
    """`policy_bootstrap` of rows drawn one by one."""
    counted, worth = _policy_sums()
    w = F.col("w")
    money = F.col("amount").cast("decimal(20,6)") * w

    def total(where: Column, what: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, what)), F.lit(0)).cast("double")

    drawn = drawn_parts(_policy_rows(scored, t), POLICY, resamples, seed)
    return _policy_intervals(
        drawn.groupBy("resample").agg(
            *[total(v, w).alias(k) for k, v in counted.items()],
            *[total(v, money).alias(k) for k, v in worth.items()],
        )
    )


def _policy_intervals(s: DataFrame) -> DataFrame:
    col = F.col
    usable = (col("frauds") > 0) & (col("fa_a") > 0) & (col("flags_c") > 0)
    metrics = {
        "a_false_alerts_per_10k": col("fa_a") * PER / col("n"),
        "c_false_alerts_per_10k": col("fa_c") * PER / col("n"),
        "false_alert_reduction_share": ratio(col("fa_a") - col("fa_c"), col("fa_a")),
        "c_review_queue_per_10k": col("queue") * PER / col("n"),
        "c_precision_on_alerts": ratio(col("hits_c"), col("flags_c")),
        "a_fraud_share_missed": ratio(col("missed_a"), col("frauds")),
        "c_fraud_share_missed": ratio(col("missed_c"), col("frauds")),
        "a_fraud_amount_share_missed": ratio(col("amt_missed_a"), col("amt")),
        "c_fraud_amount_share_missed": ratio(col("amt_missed_c"), col("amt")),
        "c_fraud_amount_share_caught_auto": ratio(col("amt_caught_c"), col("amt")),
        "c_fraud_amount_share_surfaced": ratio(col("amt_surfaced_c"), col("amt")),
        "c_legit_flagged_or_queued_per_10k": (col("fa_c") + col("queue_legit"))
        * PER
        / col("n"),
        "paired_a_minus_c_frauds_cleared": col("missed_a") - col("missed_c"),
        "paired_c_minus_a_amount_share_surfaced": ratio(
            col("amt_surfaced_c") - col("amt_surfaced_a"), col("amt")
        ),
        "paired_reduction_share_of_a_cleared": ratio(
            col("missed_a") - col("missed_c"), col("missed_a")
        ),
    }
    table = s.select("resample", *[F.when(usable, v).alias(k) for k, v in metrics.items()])
    return intervals(_melt(table, ["resample"], list(metrics)), ["metric"]).select(
        "metric", "ci_lower", "ci_upper", "degenerate"
    )


WINDOW = ["y", "p", "p_calibrated"]


def _window_intervals(ap: DataFrame, ece: DataFrame, scored: DataFrame, bins: int) -> DataFrame:
    """Interval, width and the value of the rows themselves, per fold and metric."""
    names = ["average_precision", "ece"]

    def melted(ap: DataFrame, ece: DataFrame, keys: Sequence[str]) -> DataFrame:
        joined = ap.select(*keys, "average_precision", "pos").join(ece.select(*keys, "ece"), keys)
        joined = joined.withColumn("ece", F.when(F.col("pos") > 0, F.col("ece")))
        return _melt(joined, keys, names)

    pooled = _pooled(scored.groupBy("fold", *WINDOW).agg(F.count(F.lit(1)).alias("w")), scored)
    point = melted(*_window_values(pooled, ["fold"], bins), ["fold"])
    out = intervals(melted(ap, ece, ["resample", "fold"]), ["fold", "metric"])
    return out.join(point.withColumnRenamed("value", "point"), ["fold", "metric"]).select(
        "fold", "metric", "point", "ci_lower", "ci_upper", "ci_width", "degenerate"
    )


def _pooled(weighted: DataFrame, scored: DataFrame) -> DataFrame:
    """Every row for its own fold and once more for fold 0."""
    zero = F.lit(0).cast(scored.schema["fold"].dataType)
    return store(weighted.withColumn("fold", F.explode(F.array(F.col("fold"), zero))), "pooled")


def _window_values(both: DataFrame, keys: Sequence[str], bins: int) -> tuple[DataFrame, DataFrame]:
    cells = both.groupBy(*keys, F.col("p_calibrated").alias("p"), "y").agg(F.sum("w").alias("w"))
    return ranking_metrics(score_groups(both, keys, "w"), keys), weighted_calibration_error(cells, bins, keys)


def window_bootstrap(scored: DataFrame, resamples: int, seed: int, bins: int = 10) -> DataFrame:
    """Average precision of `p` and calibration error of `p_calibrated` per `fold` and pooled
    (fold 0) over the same counts. `scored` holds (transaction_id, fold, y, p, p_calibrated)."""
    kind = scored.schema["fold"].dataType
    groups = grouped(scored, ["fold", *WINDOW])
    # every count stands for its own window and once for the pool
    both = store(
        groups.withColumn("ranking", F.explode(F.array(F.col("fold").cast("string"), F.lit("0")))), "groups"
    )

    def samples(score: Column, bins: int | None = None) -> DataFrame:
        found = ranked_samples(both.withColumn("score", score), resamples, seed, bins)
        return found.withColumn("fold", F.col("ranking").cast(kind))

    return _window_intervals(samples(-F.col("p")), samples(F.col("p_calibrated"), bins), scored, bins)


def window_of_draws(scored: DataFrame, resamples: int, seed: int, bins: int = 10) -> DataFrame:
    """`window_bootstrap` of rows drawn one by one."""
    # written below, so counts of equal rows are added up over all pages first
    drawn = drawn_rows(scored, WINDOW, resamples, seed, within="fold")
    ap, ece = _window_values(_pooled(drawn, scored), ["resample", "fold"], bins)
    return _window_intervals(ap, ece, scored, bins)


def points_per_positive(scored: DataFrame) -> DataFrame:
    """Recall points that one more caught positive adds."""
    return scored.agg(
        F.sum("y").alias("positives"), ratio(F.lit(100), F.sum("y")).alias("points")
    )
