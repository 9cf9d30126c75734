"""As-of, interval, wildcard and similarity joins. None of them compares all pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def asof(probes: DataFrame, quotes: DataFrame, values: list[str], *, at: str = "at", time: str = "timestamp", key: str = "symbol", tie: str = "seq", forward: bool = True) -> DataFrame:
    """Each probe with the first quote at or after it (or the last at or before it); found is the quote's time, null without one.

    A union sorted by (key, day, time) and a running first or last value, and the edge quote of each day carried
    over to the days beyond it: no range join, and no task holds more than a day of a key. Of quotes at one time the
    one of the least tie counts forwards, that of the largest backwards.
    """
    row = F.struct(F.col(time).alias("found"), *[F.col(v) for v in values])
    q = quotes.select(F.col(key).alias("__k"), F.col(time).alias("__t"), F.col(tie).alias("__s"), row.alias("__q"), F.lit(None).cast(probes.select(F.struct("*")).schema[0].dataType).alias("__p"))
    p = probes.select(F.col(key).alias("__k"), F.col(at).alias("__t"), F.lit(None).cast("long").alias("__s"), F.lit(None).cast(q.schema["__q"].dataType).alias("__q"), F.struct(*probes.columns).alias("__p"))
    order = [F.col("__t").desc(), F.col("__s").desc_nulls_last()] if forward else [F.col("__t").asc(), F.col("__s").asc_nulls_last()]
    both = q.unionByName(p).withColumn("__d", F.to_date("__t"))
    w = Window.partitionBy("__k", "__d").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    place = F.when(F.col("__q").isNotNull(), F.struct("__t", "__s"))
    days = both.groupBy("__k", "__d").agg((F.min_by if forward else F.max_by)("__q", place).alias("__e"))
    beyond = Window.partitionBy("__k").orderBy(F.desc("__d") if forward else F.asc("__d")).rowsBetween(Window.unboundedPreceding, -1)  # a row a day
    days = days.select("__k", "__d", F.last("__e", ignorenulls=True).over(beyond).alias("__e"))
    out = both.withColumn("__q", F.last("__q", ignorenulls=True).over(w)).where("__p IS NOT NULL")
    out = out.join(days, ["__k", "__d"], "left").withColumn("__q", F.coalesce("__q", "__e"))
    return out.select("__p.*", F.col("__q.found").alias("found"), *[F.col(f"__q.{v}").alias(v) for v in values])


def with_offsets(trades: DataFrame, time: str, seconds: list[int]) -> DataFrame:
    """A row for each offset from a time: offset in seconds, and at."""
    x = trades.withColumn("offset", F.explode(F.array(*[F.lit(s) for s in seconds])))
    return x.withColumn("at", F.col(time) + F.expr("make_dt_interval(0, 0, 0, offset)"))


def interval_join(points: DataFrame, spans: DataFrame, time: str, start: str, end: str, bin_seconds: int = 3600, keys: list[str] | None = None) -> DataFrame:
    """Pairs of a point and a span that holds it (ends included), joined by equal keys and bins of time: a span goes to every bin it touches."""
    bins = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(bin_seconds * 1_000_000))
    s = spans.withColumn("__bin", F.explode(F.sequence(bins(start), bins(end))))
    return points.withColumn("__bin", bins(time)).join(s, [*(keys or []), "__bin"]).where(F.col(time).between(F.col(start), F.col(end))).drop("__bin")


def event_context(points: DataFrame, events: DataFrame) -> DataFrame:
    """State of the most important event around each point (release before pre before post), active ids and nearest minutes; normal without one.

    points: symbol, timestamp and a key point_id; events as macro_events gives them, symbol * for all. What is active changes
    at the edges of events only: it is gathered once for each edge, and each point takes that of the last edge before it, so no
    row is made for a point and an event.
    """
    every = events.where("symbol = '*'").drop("symbol").crossJoin(points.select("symbol").distinct())
    spans = events.where("symbol <> '*'").unionByName(every).withColumn("key", F.struct("symbol")).drop("symbol")  # a null symbol has the events of all
    after = F.expr("INTERVAL 1 MICROSECOND")  # ends are included
    edges = spans.select("key", F.explode(F.array("pre_from", "event_time", F.col("event_time") + after, F.col("post_to") + after)).alias("edge")).where("edge IS NOT NULL").distinct()
    active = interval_join(edges, spans, "edge", "pre_from", "post_to", keys=["key"]).groupBy("key", "edge").agg(
        F.max_by(F.struct("event_time", "release_to"), F.struct("importance", (-F.col("event_id")).alias("o"))).alias("top"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_set("event_id")), lambda x: x.cast("string"))).alias("ids"), F.max("importance").alias("importance"),
        F.min(F.when(F.col("event_time") >= F.col("edge"), F.col("event_time"))).alias("next"), F.max(F.when(F.col("event_time") <= F.col("edge"), F.col("event_time"))).alias("last"))
    active = edges.join(active, ["key", "edge"], "left").withColumns({"edge": F.col("edge").cast(points.schema["timestamp"].dataType), "tie": F.lit(0)})
    probes = points.select(F.struct("symbol").alias("key"), F.col("timestamp").alias("at"), F.struct("*").alias("point"))
    out = asof(probes, active, ["top", "ids", "importance", "next", "last"], time="edge", key="key", tie="tie", forward=False)
    minutes = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 60e6
    state = F.when(F.col("top").isNull(), "normal").when(F.col("at") < F.col("top.event_time"), "pre_event").when(F.col("at") <= F.col("top.release_to"), "release_window").otherwise("post_event")
    return out.select("point.point_id", *[f"point.`{c}`" for c in points.columns if c != "point_id"], state.alias("event_state"), F.coalesce("ids", F.lit("")).alias("active_event_ids"),
                      F.col("importance").alias("max_importance"), minutes("next").alias("minutes_to_event"), (-minutes("last")).alias("minutes_since_event"))


def wildcard_join(signals: DataFrame, edges: DataFrame, equal: list[str], wild: list[str]) -> DataFrame:
    """Equal keys must agree, a null wild key of an edge agrees with all. Spark broadcasts the edges if their size allows it."""
    e = edges.select(*[F.col(c).alias(f"e_{c}") if c in wild else F.col(c) for c in edges.columns])
    out = signals.join(e, equal)
    for c in wild:
        out = out.where(F.col(f"e_{c}").isNull() | (F.col(f"e_{c}") == F.col(c)))
    return out


def first_fits(price: np.ndarray, size: np.ndarray, start: np.ndarray, limit: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each search the first row from `start` on with price <= limit and size >= least, or -1.

    Rows are the leaves of a binary tree; each node has its rows by falling size with the least price so far, so one lookup tells
    whether a node holds a row that fits both. A search goes up until a node does, then down to the row: n log n numbers for n rows,
    however far away the row is and however many rows fit one condition alone.
    """
    depth = max(len(price) - 1, 0).bit_length()
    kinds, rank = np.unique(-size, return_inverse=True)  # 0 is the largest size
    room = (1 << depth) - len(price)
    rank = np.concatenate([rank, np.full(room, len(kinds))])
    price = np.concatenate([price, np.full(room, np.inf)])
    fit = np.searchsorted(kinds, -least, "right")  # so many kinds of size are large enough
    keys, lows = [], []
    for k in range(depth + 1):
        order = np.argsort(rank.reshape(-1, 1 << k), axis=1, kind="stable") + np.arange(0, len(rank), 1 << k)[:, None]
        lows.append(np.minimum.accumulate(price[order], axis=1).ravel())
        keys.append((rank[order] + np.arange(len(order))[:, None] * (len(kinds) + 1)).ravel())

    def holds(k: int, node: np.ndarray, which: np.ndarray) -> np.ndarray:
        upto = np.searchsorted(keys[k], node * (len(kinds) + 1) + fit[which])
        return (upto > node << k) & (lows[k][np.maximum(upto - 1, 0)] <= limit[which])

    out, level, node = np.full(len(start), -1), np.full(len(start), -1), start.astype(np.int64)
    open_ = np.flatnonzero(node < len(price))
    for k in range(depth + 1):
        look = open_[(node[open_] & 1 == 1) | (k == depth)]  # of an even node the parent is looked at
        hit = holds(k, node[look], look)
        level[look[hit]] = k
        node[look[~hit]] += 1
        open_ = open_[level[open_] < 0]
        node[open_] >>= 1
        open_ = open_[node[open_] < 1 << max(depth - k - 1, 0)]
    for k in range(depth, 0, -1):
        down = np.flatnonzero(level == k)
        left = node[down] * 2
        node[down] = left + ~holds(k - 1, left, down)
        level[down] = k - 1
    out[level == 0] = node[level == 0]
    return out


def limit_fills(orders: DataFrame, quotes: DataFrame, timeout_seconds: int) -> DataFrame:
    """The first quote within the timeout that trades through the limit with enough size; it fills at the limit. orders: trade_id, symbol, at, side, limit, contracts.

    Quotes and orders meet by symbol and a bin of time of four timeouts, in which each order searches a tree of the quotes: no row
    is made for a quote that an order merely waits through. An order whose timeout ends in the next bin searches there too.
    """
    seconds = max(3600, 4 * timeout_seconds)
    bins = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(seconds * 1_000_000))
    until = F.col("at") + F.expr(f"INTERVAL {timeout_seconds} SECONDS")
    known = orders.where("side IN ('long', 'short') AND at IS NOT NULL AND limit IS NOT NULL AND contracts IS NOT NULL")
    at = F.col("at").cast(quotes.schema["timestamp"].dataType)
    o = known.select("trade_id", "symbol", F.explode(F.sequence(bins(F.col("at")), bins(until))).alias("bin"), at.alias("at"), (F.col("side") == "long").alias("long"), F.col("limit").cast("double").alias("limit"), F.col("contracts").cast("double").alias("contracts"))
    q = quotes.where("timestamp IS NOT NULL").select("symbol", bins(F.col("timestamp")).alias("bin"), "timestamp", "seq", *[F.col(c).cast("double").alias(c) for c in ("bid", "ask", "bid_size", "ask_size")])
    limit_type = orders.schema["limit"].dataType

    def fills(o: pa.Table, q: pa.Table) -> pa.Table:
        micros = q.column("timestamp").cast(pa.int64()).to_numpy()
        order = np.lexsort((q.column("seq").to_numpy(), micros))
        micros = micros[order]
        entered = o.column("at").cast(pa.int64()).to_numpy()
        start = np.searchsorted(micros, entered)
        long = o.column("long").to_numpy()
        number = lambda t, c: np.where(np.isnan(x := t.column(c).to_numpy()), np.inf, x)  # noqa: E731  NaN is the largest number
        limit, least = number(o, "limit"), number(o, "contracts")
        found = np.full(len(start), -1)
        for mine, sign, side in ((long, 1, "ask"), (~long, -1, "bid")):
            both = np.array(pc.and_(q.column(side).is_valid(), q.column(f"{side}_size").is_valid()))[order]
            place = np.flatnonzero(both)
            if mine.any() and len(place):
                price, size = number(q, side)[order][place], number(q, f"{side}_size")[order][place]
                got = first_fits(sign * price, size, np.searchsorted(place, start[mine]), sign * limit[mine], least[mine])
                found[mine] = np.where(got >= 0, place[got], -1)
        hit = np.flatnonzero(found >= 0)
        hit = hit[micros[found[hit]] <= entered[hit] + timeout_seconds * 1_000_000]
        quote = pa.array(order[found[hit]])
        return pa.table({"trade_id": o.column("trade_id").take(pa.array(hit)), "timestamp": q.column("timestamp").take(quote), "seq": q.column("seq").take(quote), "price": o.column("limit").take(pa.array(hit))})

    kinds = {"trade_id": orders.schema["trade_id"].dataType, "timestamp": quotes.schema["timestamp"].dataType, "seq": quotes.schema["seq"].dataType}
    schema = ", ".join(f"{c} {t.simpleString()}" for c, t in kinds.items()) + ", price double"
    hit = o.groupBy("symbol", "bin").cogroup(q.groupBy("symbol", "bin")).applyInArrow(fills, schema)
    first = hit.groupBy("trade_id").agg(F.min(F.struct("timestamp", "seq", F.col("price").cast(limit_type).alias("price"))).alias("f"))
    return orders.join(first, "trade_id", "left").select(*orders.columns, F.col("f.timestamp").alias("fill_time"), F.col("f.price").alias("fill_price"))


def forward_fill(series: DataFrame, group: str, time: str, value: str, names: list[str]) -> DataFrame:
    """One column for each named series at every time of any of them, carrying the last value forward, 0 before the first."""
    at = series.groupBy(time).pivot(group, names).agg(F.max_by(value, value))
    # a prefix over all times would be one task; the last value before each day is carried by day instead
    at = at.withColumn("__day", F.to_date(time))
    inner = Window.partitionBy("__day").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    days = at.groupBy("__day").agg(*[F.max_by(F.col(f"`{n}`"), F.when(F.col(f"`{n}`").isNotNull(), F.col(time))).alias(f"__l{i}") for i, n in enumerate(names)])
    before = Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)  # a row a day
    days = days.select("__day", *[F.last(f"__l{i}", ignorenulls=True).over(before).alias(f"__p{i}") for i in range(len(names))])
    out = at.join(days, "__day")
    return out.select(time, *[F.coalesce(F.last(F.col(f"`{n}`"), ignorenulls=True).over(inner), F.col(f"__p{i}"), F.lit(0.0)).alias(n) for i, n in enumerate(names)])


#: Tokens of sets in one part of the triangle of all pairs, items of a part that are compared at once, and tokens so compared.
PART_TOKENS, TILE, COLUMNS = 4 << 20, 2048, 4096


def shared_tokens(a: tuple, b: tuple) -> np.ndarray:
    """Numbers of tokens that sets of a and b share; a and b are (place, token) of sets, sorted by token, and the number of sets."""
    (ai, at, an), (bi, bt, bn) = a, b
    out = np.zeros((an, bn), np.float32)
    both = np.intersect1d(at, bt)
    for k in range(0, len(both), COLUMNS):
        part = both[k:k + COLUMNS]
        sides = []
        for i, t, n in ((ai, at, an), (bi, bt, bn)):
            use = slice(np.searchsorted(t, part[0]), np.searchsorted(t, part[-1], "right"))
            column = np.searchsorted(part, t[use])
            held = part[column] == t[use]
            side = np.zeros((n, len(part)), np.float32)
            side[i[use][held], column[held]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T  # whole numbers under 2**24, so exact
    return out


def jaccard_links(rows: DataFrame, item: str, token: str, least: float) -> DataFrame:
    """For each item its class_id, the smallest item of the same tokens, and links, the number of other items whose share of common tokens is `least` or more.

    Where most pairs link, their number grows with the square of the items; so links are counted and no pair becomes a row. Equal sets
    are one. The others are dealt to parts, each pair of parts is a task, which multiplies bitmaps of TILE items: memory is that of
    two parts and a tile. A null token is one that nothing shares.
    """
    t = rows.select(F.col(item).alias("i"), F.col(token).alias("t")).distinct()
    sets = cut(t.groupBy("i").agg(F.array_sort(F.collect_list("t")).alias("tokens"), F.count("*").cast("int").alias("n")))
    classes = sets.groupBy("tokens", "n").agg(F.min("i").alias("class_id"), F.count("*").alias("copies"))
    classes = cut(classes)
    parts = int(classes.agg(F.sum("n")).first()[0] or 0) // PART_TOKENS + 1
    c = classes.withColumn("part", F.pmod(F.xxhash64("class_id"), F.lit(parts)).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.struct(F.least("part", p).alias("x"), F.greatest("part", p).alias("y")))
    dealt = c.select("class_id", "copies", "n", "tokens", "part", F.explode(pair).alias("p")).select("class_id", "copies", "n", "tokens", "part", "p.x", "p.y")

    def count(table: pa.Table) -> pa.Table:
        codes = pc.list_flatten(table.column("tokens").combine_chunks()).dictionary_encode()
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
        size = pc.list_value_length(table.column("tokens")).to_numpy()
        owner = np.repeat(np.arange(len(size)), size)
        n, copies, part = (table.column(k).to_numpy().astype(np.int64) for k in ("n", "copies", "part"))
        x, y = (np.flatnonzero(part == table.column(k)[0].as_py()) for k in ("x", "y"))
        links = np.zeros(len(n), np.int64)
        first = np.concatenate([[0], np.cumsum(size)])

        def tile(of: np.ndarray) -> tuple:
            use = np.concatenate([np.arange(first[k], first[k + 1]) for k in of.tolist()]) if len(of) else np.empty(0, np.int64)
            token, place = codes[use], np.searchsorted(of, owner[use])
            order = np.argsort(token, kind="stable")
            return place[order], token[order], len(of)

        same = table.column("x")[0] == table.column("y")[0]
        for i in range(0, len(x), TILE):
            a = x[i:i + TILE]
            left = tile(a)
            for j in range(i if same else 0, len(y), TILE):
                b = y[j:j + TILE]
                shared = shared_tokens(left, tile(b)).astype(np.float64)
                linked = (shared > 0) & (shared / (n[a][:, None] + n[b][None, :] - shared) >= least)
                if same and i == j:
                    np.fill_diagonal(linked, False)
                    links[a] += linked @ copies[b]
                else:
                    links[a] += linked @ copies[b]
                    links[b] += copies[a] @ linked
        return pa.table({"class_id": table.column("class_id"), "links": pa.array(links)})

    kind = rows.schema[item].dataType.simpleString()
    found = dealt.groupBy("x", "y").applyInArrow(count, f"class_id {kind}, links long").groupBy("class_id").agg(F.sum("links").alias("links"))
    # copies of one set share all of it, but for a null token
    own = F.when((F.size("tokens") > 0) & (F.size("tokens") / (2 * F.col("n") - F.size("tokens")) >= least), F.col("copies") - 1).otherwise(0)
    each = classes.join(found, "class_id").select("tokens", "n", "class_id", (F.col("links") + own).alias("links"))
    return sets.join(each, ["tokens", "n"]).select(F.col("i").alias(item), "class_id", "links")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of old with equal keys."""
    both = old.withColumn("__p", F.lit(0)).unionByName(new.withColumn("__p", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__p").alias("r")).select(*keys, "r.*")
