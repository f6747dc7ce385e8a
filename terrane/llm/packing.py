"""Filling fixed-capacity containers with items of varying length by bin completion.

The number of distinct sizes is bounded by the capacity, so a corpus of any length reduces to one histogram, on which
the search runs, in one task: containers are completed around the largest size left, each completion being used as
often as the counts allow. Documents then take their places by their rank within their size, in parallel. The search's
effort is bounded by parameters; without bounds (``exact``) it gives the least number of containers, for small sets.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.search import upto
from terrane.session import broadcast_if_small, cut

CAPACITY = 2048
#: Search effort: nodes of the search at least and per distinct size, completions tried per node, and partial fillings
#: tried per total of a completion.
NODES, NODES_PER_SIZE, WIDTH, TRIES = 4_000, 2.5, 3, 200
#: Parts into which the documents of one size are split for ranking: at least so many, and one more for each so many items.
SALTS, ITEMS_PER_SALT = 16, 2_000_000

Plan = list[tuple[tuple[int, ...], int]]


def lower_bound(counts: dict[int, int], cap: int) -> int:
    """Least conceivable number of containers: the larger of the volume bound and, for every threshold t, the items
    above cap - t, those above cap / 2 and the volume that these leave no room for."""
    best = -(-sum(s * n for s, n in counts.items()) // cap)
    for t in sorted({s for s in counts if s <= cap // 2} | {0}):
        big = sum(n for s, n in counts.items() if s > cap - t)
        mid = [(s, n) for s, n in counts.items() if cap // 2 < s <= cap - t]
        room = sum((cap - s) * n for s, n in mid)
        small = sum(s * n for s, n in counts.items() if t <= s <= cap // 2)
        best = max(best, big + sum(n for _, n in mid) + max(0, -(-(small - room) // cap)))
    return best


def best_fit(counts: dict[int, int], cap: int) -> Plan:
    """Best-fit decreasing on the histogram: the first incumbent. Equal containers are handled together."""
    bins: dict[tuple[int, ...], int] = {}
    for s in sorted(counts, reverse=True):
        left = counts[s]
        for shape in sorted((b for b in bins if cap - sum(b) >= s), key=lambda b: cap - sum(b)):
            if not left:
                break
            each = (cap - sum(shape)) // s
            full = min(bins[shape], left // each)
            if full:
                bins[shape] -= full
                bins[shape + (s,) * each] = bins.get(shape + (s,) * each, 0) + full
                left -= full * each
            if left and bins[shape] and left < each:
                bins[shape] -= 1
                bins[shape + (s,) * left] = bins.get(shape + (s,) * left, 0) + 1
                left = 0
            bins = {b: n for b, n in bins.items() if n}
        each = cap // s
        for shape, n in (((s,) * each, left // each), ((s,) * (left % each), 1 if left % each else 0)):
            if n:
                bins[shape] = bins.get(shape, 0) + n
    return list(bins.items())


def _fits(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the items of a go into the items of b as into containers: b then dominates a."""
    room = list(b)
    for x in a:  # descending; best fit
        i = min((i for i, r in enumerate(room) if r >= x), key=lambda i: room[i], default=None)
        if i is None:
            return False
        room[i] -= x
    return True


def completions(counts: dict[int, int], room: int, taken: int = 0, width: int = WIDTH, tries_each: int = TRIES) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``room`` from the items left (less one of size ``taken``), by least waste, then with
    the largest items first; at most ``width``, of at most ``tries_each`` partial fillings per total. Found one at a
    time, as the search asks for them."""
    left = lambda s: counts.get(s, 0) - (s == taken)
    if room > 0 and left(room) > 0:  # a single item without waste dominates every other filling
        yield (room,)
        return
    sizes = [s for s in sorted(counts, reverse=True) if s <= room and left(s) > 0]
    if not sizes:
        yield ()
        return
    mask = (1 << (room + 1)) - 1
    reach = [1] * (len(sizes) + 1)  # reach[i]: sums that sizes[i:] can make, as a bit set
    for i in range(len(sizes) - 1, -1, -1):
        bits, s, n = reach[i + 1], sizes[i], min(left(sizes[i]), room // sizes[i])
        step = 1
        while n > 0:
            take = min(step, n)
            bits |= (bits << (s * take)) & mask
            n, step = n - take, step * 2
        reach[i] = bits
    found: list[tuple[int, ...]] = []
    total = reach[0].bit_length() - 1
    while len(found) < width and total >= 0:
        if reach[0] >> total & 1:
            stack, tries = [(0, total, ())], 0
            while stack and len(found) < width and tries < tries_each:
                i, rest, chosen = stack.pop()
                tries += 1
                if rest == 0:
                    if not any(_fits(chosen, f) for f in found):
                        found.append(chosen)
                        yield chosen
                    continue
                later = []
                while i < len(sizes) and len(later) < width:
                    s = sizes[i]
                    if s <= rest:
                        for k in range(min(left(s), rest // s), 0, -1):
                            if reach[i + 1] >> (rest - k * s) & 1:
                                later.append((i + 1, rest - k * s, chosen + (s,) * k))
                                break
                    i += 1
                stack.extend(reversed(later))
        total -= 1


def all_completions(counts: dict[int, int], room: int) -> list[tuple[int, ...]]:
    """Every undominated filling of ``room``, by least waste, then with the largest items first."""
    sizes = sorted((s for s in counts if s <= room and counts[s]), reverse=True)

    def maximal(i: int, rest: int, chosen: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if i == len(sizes):
            if not any(s <= rest and counts[s] > chosen.count(s) for s in sizes):
                yield chosen
            return
        for k in range(min(counts[sizes[i]], rest // sizes[i]), -1, -1):
            yield from maximal(i + 1, rest - k * sizes[i], chosen + (sizes[i],) * k)

    out: list[tuple[int, ...]] = []
    for f in sorted(maximal(0, room, ()), key=lambda f: (-sum(f), [-s for s in f])):
        if not any(_fits(f, g) for g in out):
            out.append(f)
    return out


def least_plan(counts: dict[int, int], cap: int = CAPACITY) -> Plan:
    """A plan with the least number of containers: bin completion without bounds on its effort, one container after
    another around the largest size left, over all undominated fillings. The time is exponential in the worst case."""
    best = best_fit({s: n for s, n in counts.items() if n}, cap)
    best_n, left, shapes = sum(n for _, n in best), {s: n for s, n in counts.items() if n}, []

    def go() -> None:
        nonlocal best, best_n
        if not any(left.values()):
            if len(shapes) < best_n:
                best, best_n = [(s, 1) for s in shapes], len(shapes)
            return
        now = {s: n for s, n in left.items() if n}
        if len(shapes) + lower_bound(now, cap) >= best_n:
            return
        top = max(now)
        now[top] -= 1
        for f in all_completions(now, cap - top):
            shape = (top, *f)
            for s in shape:
                left[s] -= 1
            shapes.append(shape)
            go()
            shapes.pop()
            for s in shape:
                left[s] += 1

    go()
    return best


def plan(counts: dict[int, int], cap: int = CAPACITY, nodes: int | None = None, width: int = WIDTH, tries: int = TRIES) -> Plan:
    """Shapes of containers and how often each is used, for all items of a histogram {size: number}, sizes 1..cap.

    Depth-first branch and bound: at each node the largest size left is completed in up to ``width`` undominated
    ways, each used as often as the counts allow. A branch ends when its waste exceeds what an improvement on the
    incumbent could afford. The search stops at the lower bound or after ``nodes`` nodes; the incumbent (at first
    best-fit decreasing) is then the result.
    """
    left = {s: n for s, n in counts.items() if n}
    if not left:
        return []
    nodes = max(NODES, int(NODES_PER_SIZE * len(left)) + 500) if nodes is None else nodes
    least, volume = lower_bound(left, cap), sum(s * n for s, n in left.items())
    best = best_fit(left, cap)
    best_n = sum(n for _, n in best)
    used = waste = 0
    frames: list[list] = []  # [largest size, its completions still to try, (shape, times) in force or None]

    def change(shape: tuple[int, ...], times: int) -> None:
        for s in set(shape):
            n = left.get(s, 0) + times * shape.count(s)
            if n:
                left[s] = n
            else:
                del left[s]

    def opened() -> list:
        top = max(left)
        return [top, completions(left, cap - top, top, width, tries), None]

    frames.append(opened())
    while frames and best_n > least and nodes > 0:
        frame = frames[-1]
        nodes -= 1
        if frame[2]:
            shape, times = frame[2]
            change(shape, times)
            used, waste, frame[2] = used - times, waste - (cap - sum(shape)) * times, None
        spare = (best_n - 1) * cap - volume - waste  # below 0 where the incumbent has improved since the node was opened
        filling = next(frame[1], None) if spare >= 0 else None
        if filling is None:
            frames.pop()
            continue
        shape = (frame[0], *filling)
        times = min(left[s] // shape.count(s) for s in set(shape))
        loss = cap - sum(shape)
        if loss * times > spare:
            times = spare // loss
            if times < 1:
                continue
        change(shape, -times)
        used, waste, frame[2] = used + times, waste + loss * times, (shape, times)
        if left:
            frames.append(opened())
        elif used < best_n:
            best, best_n = [f[2] for f in frames], used
    return best


def slots(shapes: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """(size, first rank, end rank, first container, containers, offset) for every run of equal places."""
    out, ranks, base = [], {}, 0
    for shape, n in shapes:
        offset = 0
        for s in sorted(set(shape), reverse=True):
            k = shape.count(s)
            lo = ranks.get(s, 0)
            ranks[s] = lo + k * n
            out.append((s, lo, lo + k * n, base, n, offset))
            offset += k * s
        base += n
    return out


def _searched(histogram: DataFrame, capacity: int, nodes: int | None, width: int, tries: int, exact: bool) -> DataFrame:
    """The runs of equal places (``slots``) for a histogram (size, n) of at most ``capacity`` rows, found in one task."""

    def run(batches):
        import pandas as pd

        counts: dict[int, int] = {}
        for pdf in batches:
            counts |= dict(zip(pdf["size"].tolist(), pdf["n"].tolist()))
        shapes = least_plan(counts, capacity) if exact else plan(counts, capacity, nodes, width, tries)
        yield pd.DataFrame(slots(shapes), columns=["size", "lo", "hi", "base", "n", "offset"])

    return histogram.coalesce(1).mapInPandas(run, "size int, lo long, hi long, base long, n long, offset long")


def pack(items: DataFrame, key: str, size: Column, capacity: int = CAPACITY, salts: int | None = None, nodes: int | None = None, width: int = WIDTH, tries: int = TRIES, exact: bool = False) -> DataFrame:
    """Places for all items: (key, piece, container, position, size), position being the offset in the container.

    An item above the capacity is cut into full pieces, each a container of its own, and a rest that is packed like
    any item. Items of size 0, NULL or below need no room: they come back with size 0 and NULL container and
    position. Repeated rows are separate items. Sizes are counted in one pre-aggregated pass; the histogram is bounded
    by the capacity, whatever the number of items, and the plan for it is found in one task. ``nodes``, ``width`` and
    ``tries`` bound the search's effort (see ``plan``; the result is valid with any); ``exact`` lifts all bounds and
    gives the least number of containers, in a time that only small sets allow.
    """
    sized = cut(items.select(F.col(key), F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("size")))
    salts = salts or SALTS + sized.count() // ITEMS_PER_SALT
    whole, rest = F.floor(F.col("size") / capacity), F.col("size") % capacity
    salt = F.pmod(F.xxhash64(key), F.lit(salts))
    rests = sized.where(rest > 0).select(key, whole.cast("int").alias("piece"), rest.cast("int").alias("size")).withColumn("_salt", salt)
    counts = cut(rests.groupBy("size", "_salt").agg(F.count("*").alias("n")))  # at most capacity * salts rows
    places = cut(_searched(counts.groupBy("size").agg(F.sum("n").alias("n")), capacity, nodes, width, tries, exact))
    used, longest = places.agg(F.coalesce(F.max(F.col("base") + F.col("n")), F.lit(0))).collect()[0][0], places.groupBy("size").count().agg(F.coalesce(F.max("count"), F.lit(0))).collect()[0][0]
    before = Window.partitionBy("size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("size", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    # one row per size: its runs in the order of the ranks, in which an item finds its own by halving
    runs = places.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "base", "n", "offset"))).alias("_runs"))
    ranked = rests.withColumn("_r", F.row_number().over(Window.partitionBy("size", "_salt").orderBy(key, "piece")) - 1)
    ranked = ranked.join(broadcast_if_small(starts), ["size", "_salt"]).withColumn("_r", F.col("_r") + F.col("_first"))
    at = ranked.join(broadcast_if_small(runs), "size").withColumn("_run", F.get("_runs", upto(F.col("_runs"), "lo", F.col("_r"), longest) - 1))
    kth, n = F.col("_r") - F.col("_run.lo"), F.col("_run.n")
    packed = at.select(key, "piece", (F.col("_run.base") + kth % n).alias("container"), (F.col("_run.offset") + F.floor(kth / n) * F.col("size")).cast("int").alias("position"), "size")
    # full pieces: containers after the packed ones, numbered by offsets of the parts
    long_ = sized.where(whole > 0).withColumn("_salt", salt)
    parts = long_.groupBy("_salt").agg(F.sum(whole).alias("_n"))  # at most salts rows
    offsets = parts.select("_salt", (F.lit(used) + F.coalesce(F.sum("_n").over(Window.orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_base"))
    w = Window.partitionBy("_salt").orderBy(key, "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = long_.join(broadcast_if_small(offsets), "_salt").withColumn("_base", F.col("_base") + F.coalesce(F.sum(whole).over(w), F.lit(0)))
    full = numbered.select(key, F.explode(F.sequence(F.lit(0), whole.cast("int") - 1)).alias("piece"), "_base").select(key, "piece", (F.col("_base") + F.col("piece")).alias("container"), F.lit(0).alias("position"), F.lit(capacity).alias("size"))
    none = sized.where("size = 0").select(key, F.lit(0).alias("piece"), F.lit(None).cast("long").alias("container"), F.lit(None).cast("int").alias("position"), F.lit(0).alias("size"))
    return packed.unionByName(full).unionByName(none)
