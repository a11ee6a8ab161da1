"""Exact cut points of a total order, without ranking the rows.

A split or fold is a comparison with a few cut keys: "the first 20 % in this
order".  So instead of numbering every row (a global window is one task, a
range-partitioned one is a full shuffle) we find the key that sits at each
wanted rank and compare rows with it in a narrow projection.

A cut is found by narrowing.  Each round histograms the rows that may still
hold the cut into at most ``BINS`` equal-width bins and keeps one bin; once few
enough rows are left they alone are ranked.  Only ``BINS`` counts per cut reach
the driver, ties are broken by the later order columns, and a third of all rows
sharing one time or date just moves the search on to the next column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.functions.keys import hex_number
from cohortspark.functions.literals import sql_literal
from cohortspark.session import materialize

BINS = 4096
RANKABLE = 200_000
#: Rows of a stratum that are ranked for a cut.
ROWS_TOGETHER = 2000
TEXT_BLOCK = 7  # bytes of a text key that are narrowed at a time, to the end of the longest text

Ranks = Callable[[dict[Any, int]], dict[Any, list[int]]]


@dataclass(frozen=True)
class _Search:
    """One wanted rank: which stratum, which rank inside the rows still possible."""

    stratum: Any
    rank: int
    local: int
    size: int
    fixed: tuple[int, ...] = ()
    bounds: tuple[int, int] | None = None

    @property
    def window(self) -> tuple:
        return (self.stratum, self.fixed, self.bounds)


@dataclass(frozen=True)
class Cuts:
    """Cut keys per stratum, in the order of the wanted ranks."""

    order: tuple[str, ...]
    keys: dict[Any, list[tuple]] = field(default_factory=dict)
    sizes: dict[Any, int] = field(default_factory=dict)


def _text_block(col: Column, block: int) -> Column:
    raw = F.hex(F.encode(col, "UTF-8"))
    piece = F.rpad(F.substring(raw, 1 + 2 * TEXT_BLOCK * block, 2 * TEXT_BLOCK), 2 * TEXT_BLOCK, "0")
    return F.conv(piece, 16, 10).cast("bigint")


def _fraction_digits(x: Column) -> list[Column]:
    """Whole part and fraction; what these cannot tell apart is ranked at the end."""
    held = F.greatest(F.least(x, F.lit(9e18)), F.lit(-9e18))
    return [F.floor(held).cast("bigint"), F.floor((held - F.floor(held)) * F.lit(2.0**53)).cast("bigint")]


def _text_blocks(keyed: DataFrame, names: Sequence[str]) -> dict[str, int]:
    """How many blocks the longest text of each text column has: one aggregate."""
    texts = [n for n in names if n != "key" and isinstance(keyed.schema[n].dataType, T.StringType)]
    if not texts:
        return {}
    row = keyed.agg(*[F.max(F.octet_length(n)).alias(n) for n in texts]).first()
    return {n: -(-(row[n] or 0) // TEXT_BLOCK) for n in texts}


def _digits(keyed: DataFrame, names: Sequence[str], blocks: dict[str, int]) -> list[Column]:
    """Order-preserving integers, most significant first.  A ``key`` column is hex text."""
    out: list[Column] = []
    for name in names:
        if name == "key":
            out.append(hex_number(F.col(name)))
        elif isinstance(keyed.schema[name].dataType, T.StringType):
            out += [_text_block(F.col(name), b) for b in range(blocks.get(name, 0))]
        elif isinstance(keyed.schema[name].dataType, T.FractionalType):
            out += _fraction_digits(F.col(name).cast("double"))
        else:
            out.append(F.col(name).cast("bigint"))
    return out


def _inside(search: _Search, digits: list[Column], stratified: bool) -> Column:
    where = F.col("stratum").eqNullSafe(F.lit(search.stratum)) if stratified else F.lit(True)
    for digit, value in zip(digits, search.fixed, strict=False):
        where = where & (digit == F.lit(value))
    if search.bounds is not None:
        low, high = search.bounds
        where = where & digits[len(search.fixed)].between(low, high)
    return where


def _narrow(
    keyed: DataFrame, digits: list[Column], open_searches: list[_Search], stratified: bool
) -> dict[tuple, list[tuple[int, int, int]]]:
    """One job: (bin start, bin end, rows) of every window still being searched."""
    windows = {s.window: s for s in open_searches}
    spans = {}
    unbounded = [w for w in windows if windows[w].bounds is None]
    if unbounded:
        aggs = []
        for i, w in enumerate(unbounded):
            s = windows[w]
            digit = F.when(_inside(s, digits, stratified), digits[len(s.fixed)])
            aggs += [F.min(digit).alias(f"lo{i}"), F.max(digit).alias(f"hi{i}")]
        row = keyed.agg(*aggs).first()
        spans = {w: (row[f"lo{i}"], row[f"hi{i}"]) for i, w in enumerate(unbounded)}
    chain = None
    layout = {}
    for i, (w, s) in enumerate(windows.items()):
        low, high = spans.get(w) or s.bounds
        width = -(-(high - low + 1) // BINS)
        layout[i] = (w, low, high, width)
        wide = digits[len(s.fixed)].cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")
        cell = F.struct(
            F.lit(i).alias("w"), F.floor(wide / F.lit(width).cast("decimal(20,0)")).cast("bigint").alias("bin")
        )
        hit = _inside(s, digits, stratified)
        chain = F.when(hit, cell) if chain is None else chain.when(hit, cell)
    counted = (
        keyed.select(chain.alias("cell")).where("cell is not null").groupBy("cell").count().collect()
    )
    found: dict[tuple, list[tuple[int, int, int]]] = {w: [] for w in windows}
    for row in counted:
        w, low, high, width = layout[row["cell"]["w"]]
        start = low + row["cell"]["bin"] * width
        found[w].append((start, min(high, start + width - 1), row["count"]))
    return {w: sorted(bins) for w, bins in found.items()}


def _step(search: _Search, bins: list[tuple[int, int, int]]) -> _Search:
    before = 0
    for start, end, n in bins:
        if search.local <= before + n:
            moved = replace(search, local=search.local - before, size=n, bounds=(start, end))
            if start == end:
                moved = replace(moved, fixed=(*search.fixed, start), bounds=None)
            return moved
        before += n
    raise AssertionError("rank lies outside its window")


def stratum_totals(df: DataFrame, stratum: str, key: Column) -> DataFrame:
    """Rows, and rows with a key, per stratum."""
    return (
        df.select(F.col(stratum).alias("stratum"), key.alias("key"))
        .groupBy("stratum")
        .agg(F.count(F.lit(1)).alias("n"), F.count("key").alias("keyed"))
    )


def cut_points(
    df: DataFrame,
    order: dict[str, Column],
    wanted: Ranks,
    *,
    stratum: Column | None = None,
    null_key: str | None = None,
    rankable: int | None = None,
    totals: list | None = None,
) -> Cuts:
    """Keys at the wanted 1-based ranks of ``df`` ordered by ``order`` within ``stratum``.

    ``wanted`` maps the row count per stratum to the ranks to look up.  A rank of
    0 has no key and yields ``None``.  With ``null_key`` a NULL in the first order
    column is an error with that message.  ``totals`` are the ``stratum_totals``, if
    already known.
    """
    rankable = RANKABLE if rankable is None else rankable
    names = tuple(order)
    stratified = stratum is not None
    strat = stratum if stratified else F.lit(None).cast("string")
    keyed = df.select(strat.alias("stratum"), *[c.alias(n) for n, c in order.items()])
    if totals is None:
        totals = stratum_totals(keyed, "stratum", F.col(names[0])).collect()
    if null_key and any(r["n"] != r["keyed"] for r in totals):
        raise ValueError(null_key)
    sizes = {r["stratum"]: r["n"] for r in totals}
    if not stratified and not sizes:
        sizes = {None: 0}
    ranks = wanted(dict(sizes))
    searches = {
        (s, r): _Search(s, r, r, sizes[s]) for s, rs in ranks.items() for r in rs if 0 < r <= sizes[s]
    }
    large = any(s.size > rankable for s in searches.values())
    digits = _digits(keyed, names, _text_blocks(keyed, names) if large else {})
    while True:
        busy = {
            k: s for k, s in searches.items() if s.size > rankable and len(s.fixed) < len(digits)
        }
        if not busy:
            break
        bins = _narrow(keyed, digits, list(busy.values()), stratified)
        searches.update({k: _step(s, bins[s.window]) for k, s in busy.items()})
    found = _rank_rest(keyed, digits, names, searches, stratified)
    keys = {s: [found.get((s, r)) for r in rs] for s, rs in ranks.items()}
    return Cuts(names, keys, sizes)


def _rank_rest(keyed, digits, names, searches, stratified) -> dict[tuple, tuple]:
    if not searches:
        return {}
    windows: dict[tuple, int] = {}
    for s in searches.values():
        windows.setdefault(s.window, len(windows))
    chain = None
    seen = set()
    for s in searches.values():
        i = windows[s.window]
        if i in seen:
            continue
        seen.add(i)
        hit = _inside(s, digits, stratified)
        chain = F.when(hit, F.lit(i)) if chain is None else chain.when(hit, F.lit(i))
    places: dict[int, list[int]] = {}
    for s in searches.values():
        places.setdefault(windows[s.window], []).append(s.local)
    pick = None
    for i, locals_ in places.items():
        cond = (F.col("w") == i) & F.col("rn").isin(sorted(set(locals_)))
        pick = cond if pick is None else pick | cond
    ranked = (
        keyed.withColumn("w", chain)
        .where("w is not null")
        .withColumn("rn", F.row_number().over(Window.partitionBy("w").orderBy(*names)))
        .where(pick)
        .collect()
    )
    at = {(r["w"], r["rn"]): tuple(r[n] for n in names) for r in ranked}
    return {k: at[windows[s.window], s.local] for k, s in searches.items()}


def _at_or_before(cols: Sequence[str], key: tuple | None) -> str:
    """Lexicographic ``cols <= key``; nothing is before a missing key."""
    if key is None:
        return "false"
    verdict = f"{cols[-1]} <= {sql_literal(key[-1])}"
    for col, value in reversed(list(zip(cols, key, strict=True))[:-1]):
        bound = sql_literal(value)
        verdict = f"({col} < {bound} or ({col} = {bound} and {verdict}))"
    return verdict


def _banded(cols: Sequence[str], keys: Sequence[tuple | None], labels: Sequence[Any]) -> str:
    last = sql_literal(labels[-1])
    arms = [
        f"when {_at_or_before(cols, key)} then {sql_literal(label)}"
        for key, label in zip(keys, labels, strict=False)
    ]
    return f"case {' '.join(arms)} else {last} end" if arms else last


def strata(df: DataFrame, stratum: str, key: Column, *, null_key: str | None = None) -> DataFrame:
    """``(stratum, n)`` of every stratum, as a written table. A NULL key is an error with the message ``null_key``."""
    totals = materialize(stratum_totals(df, stratum, key), "strata")
    if null_key and not totals.where("n <> keyed").isEmpty():
        raise ValueError(null_key)
    return totals.select("stratum", "n")


def running_total(table: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``table`` with the sum of ``value`` over all rows before in ``order``; ranges are summed first, so no task sees all rows."""
    ranged = table.repartitionByRange(order).withColumn("__part", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    sums = ranged.groupBy("__part").agg(F.sum(value).alias("__sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = sums.select(F.col("__part").alias("__of"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = summed.join(starts, F.col("__part") == F.col("__of"))
    return joined.select(*table.columns, (F.col("__start") + F.col("__inside")).alias(name))


def stratum_cuts(df: DataFrame, order: dict[str, Column], ranks: DataFrame, stratum: Column) -> DataFrame:
    """``(stratum, cuts)``: the order values at the wanted ranks of every stratum, NULL for rank 0.

    ``ranks`` has stratum, n and ranks, the 1-based ranks in rising order. The order is led by a hash ``key``: one histogram over
    prefixes of it, as long as the size of the stratum asks for, shows in which few rows a rank lies; only these are ranked.
    """
    names = list(order)
    keyed = df.select(stratum.alias("stratum"), *[c.alias(n) for n, c in order.items()])
    digits = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("n") / F.lit(ROWS_TOGETHER)))).cast("int")
    sized = ranks.select(F.col("stratum").alias("of"), digits.alias("digits"))
    placed = keyed.join(sized, F.col("stratum") == F.col("of")).drop("of")
    placed = placed.withColumn("bucket", F.substr("key", F.lit(1), F.col("digits"))).drop("digits")
    upto = Window.partitionBy("stratum").orderBy("bucket")
    counted = placed.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("m")).withColumn("reach", F.sum("m").over(upto))
    wanted = ranks.select(F.col("stratum").alias("of"), F.posexplode("ranks").alias("i", "rank")).where("rank > 0")
    hit = (F.col("stratum") == F.col("of")) & (F.col("rank") <= F.col("reach")) & (F.col("rank") > F.col("reach") - F.col("m"))
    inside = counted.join(wanted, hit).select(
        "of", F.col("bucket").alias("in_bucket"), "i", (F.col("rank") - F.col("reach") + F.col("m")).alias("local")
    )
    near = placed.join(inside, (F.col("stratum") == F.col("of")) & (F.col("bucket") == F.col("in_bucket")))
    place = F.row_number().over(Window.partitionBy("stratum", "i").orderBy(*names))
    found = near.withColumn("place", place).where("place = local").select("of", F.col("i").alias("at"), F.struct(*names).alias("cut"))
    every = ranks.select("stratum", F.posexplode("ranks").alias("i", "rank"))
    met = every.join(found, (F.col("stratum") == F.col("of")) & (F.col("i") == F.col("at")), "left")
    return met.groupBy("stratum").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "cut"))), lambda x: x["cut"]).alias("cuts")
    )


def label_strata(
    df: DataFrame,
    name: str,
    order: dict[str, Column],
    ranks: DataFrame,
    labels: Sequence[Any],
    stratum: str,
    *,
    ranked: DataFrame | None = None,
) -> DataFrame:
    """``label_rows`` within every value of ``stratum``, for any number of them.

    ``ranks`` (stratum, n, ranks) stays a table, as do the cuts that follow from it; rows meet those of their stratum by a join.
    The ranks count rows of ``ranked`` where that is another table (of groups) with the same columns to order by.
    """
    cuts = materialize(stratum_cuts(df if ranked is None else ranked, order, ranks, F.col(stratum)), "cuts")
    cuts = cuts.select(F.col("stratum").alias("__stratum"), F.col("cuts").alias("__cuts"))
    held = {f"__order_{n}": c for n, c in order.items()}
    joined = df.withColumns(held).join(cuts, F.col(stratum) == F.col("__stratum"))
    own = F.struct(*[F.col(h).alias(n) for h, n in zip(held, order, strict=True)])
    passed = F.size(F.filter("__cuts", lambda c: c.isNull() | (own > c)))
    label = F.element_at(F.array(*[F.lit(v) for v in labels]), passed + 1)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], label.alias(name))


def label_rows(
    df: DataFrame,
    name: str,
    order: dict[str, Column],
    cuts: Cuts,
    labels: Sequence[Any],
    *,
    stratum: str | None = None,
) -> DataFrame:
    """Adds column ``name``: ``labels[i]`` up to the i-th cut, the last label beyond all cuts.

    The order columns are projected once, so a key is hashed once per row however
    many cuts it is compared with.
    """
    held = {f"__order_{n}": c for n, c in order.items()}
    cols = list(held)
    if stratum is None:
        label = _banded(cols, cuts.keys.get(None, []), labels)
    else:
        arms = [
            f"when `{stratum}` = {sql_literal(value)} then {_banded(cols, keys, labels)}"
            for value, keys in cuts.keys.items()
        ]
        label = f"case {' '.join(arms)} else {sql_literal(labels[-1])} end" if arms else sql_literal(labels[-1])
    return df.withColumns(held).withColumn(name, F.expr(label)).drop(*held)
