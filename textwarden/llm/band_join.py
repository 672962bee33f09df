"""Join of lines and items whose prices in cents are near, on an equal-width grid.

A line's unit price u and an item's price p pair if their gap is at most ``near`` cents, or ``per`` thousandths of p.
Pairs grow with the product of the tables, so rows of equal price are added up first: lines to one row for each u
(counts, sums, and the first lines), items to one row for each p. Then the grid: cents are cut into buckets of equal width;
a line price keeps one bucket, an item price is exploded to every bucket that its interval touches; both sides meet by a shuffle
equi-join on the bucket, and an exact integer check follows. A bucket with more pairs than LOAD is salted: line prices
are dealt to its salts by hash, item prices go to all of them. Prices whose interval would touch more than TOUCHED buckets use a
grid of TOUCHED times the width (and so on), in which line prices keep one bucket too.

An item doesn't pair with its own lines. Those are in the sums, so they are found by a join on the item's id and
taken off again. For the first pairs, the lists hold lines of enough different items: per price the first FIRST lines of each item and of
these the first 2 * FIRST, so that FIRST are left whichever item is taken out.

Nothing is broadcast or collected but the numbers of the grids in use (a few); a price or an item with a third of all lines is one
row in each task's partial sums, and its first lines are cut to FIRST in each task before they move.

Results for odd input: lines null in sale_id, item_id, quantity or amount never pair, nor do those with quantity 0, with an amount
that is no finite number or is beyond 9e12; a null line_no sorts first and is written as nothing in the checksum; repeated lines count each, and take a rank each.
Items null in id or price, or with such a price, have no pairs, and so one row with rank 0; repeated item rows get their rows each; very large prices
take a coarser grid; ties go by gap, u, sale_id, line_no, line_item_id. Extra columns are ignored, whatever their names. Without lines, every item has
its row with rank 0; without items the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of a bucket in cents; buckets that an item price touches at most, by its grid; pairs of prices in a bucket from which it is salted.
WIDTH, TOUCHED, LOAD = 32, 64, 1 << 16
FIRST = 5
#: Cents beyond this leave no room for exact products.
MOST = 9e14


def _cents(col: str) -> str:
    x = f"floor(100 * {col} + 0.5D)"
    return f"CASE WHEN abs(100 * {col}) <= {MOST}D THEN cast({x} AS bigint) END"  # false for NaN and infinite


def _down(a: str, m: str) -> str:
    """Whole division that rounds down, for m above 0."""
    return f"(({a}) - pmod({a}, {m})) div ({m})"


def priced_lines(lines: DataFrame) -> DataFrame:
    """u, sale_id, line_no, item_id, crc of the lines that may pair."""
    line = "concat(sale_id, ',', coalesce(cast(line_no AS string), ''), ',', item_id)"
    return (
        lines.where("sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity <> 0")
        .selectExpr("cast(sale_id AS bigint) AS sale_id", "cast(line_no AS bigint) AS line_no", "cast(item_id AS bigint) AS item_id", "cast(quantity AS bigint) AS q", f"{_cents('amount')} AS a")
        .where("a IS NOT NULL")
        .selectExpr("sale_id", "line_no", "item_id", "(2 * a + q) * cast(sign(q) AS bigint) AS above", "2 * abs(q) AS below")
        .selectExpr(f"{_down('above', 'below')} AS u", "sale_id", "line_no", "item_id", f"crc32({line}) AS crc")
    )


def _reach(p: str, near: int, per: int) -> str:
    return f"greatest({near}L, {per} * {p} div 1000)"


def _holds(near: int, per: int) -> str:
    return f"abs(u - p) <= {near} OR 1000 * abs(u - p) <= {per} * p"


def _grid(reach: str) -> str:
    """The first grid, by number, in which an interval of that reach touches no more than TOUCHED buckets."""
    levels = [f"WHEN 2 * {reach} < {WIDTH * TOUCHED ** (g + 1) - WIDTH * TOUCHED ** g} THEN {g}" for g in range(7)]
    return f"CASE {' '.join(levels)} ELSE 7 END"


def _width(level: str) -> str:
    return f"CASE {level} " + " ".join(f"WHEN {g} THEN {WIDTH * TOUCHED ** g}L" for g in range(8)) + " END"


def first_lines(lines: DataFrame) -> DataFrame:
    """u, lines (sorted, enough of different items), apart (how many are left whichever item is taken out)."""
    order = "sale_id, line_no"
    kept = lines.selectExpr("u", "sale_id", "line_no", "item_id", f"row_number() OVER (PARTITION BY u, item_id ORDER BY {order}) AS of_item").where(f"of_item <= {FIRST}")
    kept = kept.selectExpr("u", "sale_id", "line_no", "item_id", f"row_number() OVER (PARTITION BY u ORDER BY {order}, item_id) AS place").where(f"place <= {2 * FIRST}")
    by = kept.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("sale_id", "line_no", "item_id"))).alias("lines"))
    return by.selectExpr("u", "lines", "size(lines) - array_max(transform(lines, x -> size(filter(lines, y -> y.item_id = x.item_id)))) AS apart")


def _sure(df: DataFrame) -> DataFrame:
    """df for a join that moves both sides."""
    return df.hint("merge")


def bucketed(prices: DataFrame, line_prices: DataFrame, near: int, per: int, load: int = LOAD) -> tuple[DataFrame, DataFrame]:
    """Item prices (p) exploded to the buckets they touch and line prices (u) in one bucket of each grid in use, both with a salt."""
    wide = prices.selectExpr("*", f"{_reach('p', near, per)} AS reach").selectExpr("*", f"{_grid('reach')} AS level").selectExpr("*", f"{_width('level')} AS wide")
    levels = sorted(r.level for r in wide.select("level").distinct().collect()) or [0]
    items = wide.selectExpr("p", "level", f"explode(sequence({_down('p - reach', 'wide')}, {_down('p + reach', 'wide')})) AS bucket")
    grids = ", ".join(map(str, levels))
    lines = line_prices.selectExpr("*", f"explode(array({grids})) AS level").selectExpr("*", f"{_down('u', _width('level'))} AS bucket")
    at = ["level", "bucket"]
    hot = (
        lines.groupBy(*at).count().withColumnRenamed("count", "n_u").join(_sure(items.groupBy(*at).count().withColumnRenamed("count", "n_p")), at)
        .where(f"n_u * n_p > {load}").selectExpr(*at, f"cast(least(n_u, ceil(n_u * n_p / {load})) AS int) AS salts")
    )
    items = items.join(_sure(hot), at, "left").selectExpr("p", *at, "explode(sequence(0, coalesce(salts, 1) - 1)) AS salt")
    lines = lines.join(_sure(hot), at, "left").selectExpr("u", "n", "crc", "apart", *at, "cast(pmod(xxhash64(u), coalesce(salts, 1)) AS int) AS salt")
    return items, lines


def near_prices(prices: DataFrame, line_prices: DataFrame, near: int = 10, per: int = 2, load: int = LOAD) -> DataFrame:
    """p, n_pairs, gap_sum, crc of all lines near each price, and ``close``: (gap, u) of the line prices that may hold the first pairs."""
    items, lines = bucketed(prices, line_prices, near, per, load)
    pairs = items.join(_sure(lines), ["level", "bucket", "salt"]).where(_holds(near, per)).selectExpr("p", "abs(u - p) AS gap", "u", "n", "crc", "apart")
    return (
        pairs.selectExpr("*", "coalesce(sum(apart) OVER (PARTITION BY p ORDER BY gap, u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead")
        .groupBy("p").agg(F.expr("sum(n) AS n_pairs"), F.expr("sum(gap * n) AS gap_sum"), F.expr("sum(crc) AS crc"), F.expr(f"collect_list(struct(gap, u)) FILTER (WHERE ahead < {FIRST}) AS close"))
    )


def _first_pairs(close: DataFrame, lists: DataFrame) -> DataFrame:
    """p, pairs: at most 2 * FIRST, sorted, of which FIRST are left whichever item is taken out."""
    each = close.selectExpr("p", "inline(close)").join(_sure(lists.select("u", "lines")), "u")
    each = each.selectExpr("p", "transform(lines, x -> struct(gap, u, x.sale_id AS sale_id, x.line_no AS line_no, x.item_id AS line_item_id)) AS pairs")
    by = each.groupBy("p").agg(F.sort_array(F.flatten(F.collect_list("pairs"))).alias("all"))
    # an item with more than FIRST of the first 2 * FIRST is cut, and others take its places
    by = by.selectExpr("p", "all", f"slice(all, 1, {2 * FIRST}) AS head")
    by = by.selectExpr("p", "all", "head", f"filter(head, x -> size(filter(head, y -> y.line_item_id = x.line_item_id)) > {FIRST}) AS crowd")
    by = by.selectExpr("p", "all", "head", "crowd", "get(crowd, 0).line_item_id AS most")
    cut = f"array_sort(concat(slice(crowd, 1, {FIRST}), slice(filter(all, x -> x.line_item_id <> most), 1, {FIRST})))"
    return by.selectExpr("p", f"CASE WHEN size(crowd) = 0 THEN head ELSE {cut} END AS pairs")


def own_lines(by_item: DataFrame, priced: DataFrame, near: int, per: int) -> DataFrame:
    """item_id, p, and sums over the item's own lines near its price."""
    mine = by_item.join(_sure(priced.where("item_id IS NOT NULL AND p IS NOT NULL").select("item_id", "p").distinct()), "item_id").where(_holds(near, per))
    return mine.groupBy("item_id", "p").agg(F.expr("sum(n) AS own_n"), F.expr("sum(abs(u - p) * n) AS own_gap"), F.expr("sum(crc) AS own_crc"))


def near_lines(items: DataFrame, lines: DataFrame, near: int = 10, per: int = 2, load: int = LOAD) -> DataFrame:
    """Per item: item_id, p, n_pairs, gap_sum, lines_crc over all its pairs, and ``pairs``, the first FIRST of them."""
    told = priced_lines(lines)
    by_item = told.groupBy("item_id", "u").agg(F.count(F.lit(1)).alias("n"), F.sum("crc").alias("crc"))
    lists = first_lines(told)
    line_prices = by_item.groupBy("u").agg(F.sum("n").alias("n"), F.sum("crc").alias("crc")).join(_sure(lists.select("u", "apart")), "u")
    priced = items.selectExpr("cast(item_id AS bigint) AS item_id", f"{_cents('price')} AS p")
    prices = priced.where("item_id IS NOT NULL AND p IS NOT NULL").select("p").distinct()
    sums = near_prices(prices, line_prices, near, per, load)
    found = sums.drop("close").join(_sure(_first_pairs(sums.select("p", "close"), lists)), "p")
    out = priced.join(_sure(own_lines(by_item, priced, near, per)), ["item_id", "p"], "left").join(_sure(found), "p", "left")
    out = out.selectExpr(
        "item_id", "p", "item_id IS NOT NULL AS told", "coalesce(n_pairs, 0) - coalesce(own_n, 0) AS n_pairs", "coalesce(gap_sum, 0) - coalesce(own_gap, 0) AS gap_sum",
        "coalesce(crc, 0) - coalesce(own_crc, 0) AS lines_crc", f"slice(filter(pairs, x -> x.line_item_id <> item_id), 1, {FIRST}) AS pairs",
    )
    zero = lambda c: f"CASE WHEN told THEN {c} ELSE 0L END AS {c}"
    return out.selectExpr("item_id", "p", zero("n_pairs"), zero("gap_sum"), zero("lines_crc"), "pairs")


def ranked(found: DataFrame) -> DataFrame:
    """A row for each of the first pairs, with rank from 1; one with rank 0 for an item without pairs."""
    pos: Column = F.posexplode_outer("pairs").alias("at", "pair")
    rows = found.select("item_id", "n_pairs", "gap_sum", "lines_crc", pos)
    return rows.selectExpr("item_id", "coalesce(at + 1, 0) AS rank", "pair.gap", "pair.u", "pair.sale_id", "pair.line_no", "pair.line_item_id", "n_pairs", "gap_sum", "lines_crc")
