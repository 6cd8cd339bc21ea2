"""Allocation and planning: quotas, mixes, plans, and puzzle evaluations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiteloom.operators.ranking import rank_within


def largest_remainder(shares: DataFrame, by: Sequence[str], key: str, share: str, total: Column) -> DataFrame:
    """Add ``n``: whole numbers that follow the shares and sum to the total of the group.

    What flooring leaves goes to the largest remainders; ties to the larger share,
    then the lesser key.
    """
    w = Window.partitionBy(*by)
    ideal = F.col(share).cast("double") / F.sum(F.col(share).cast("double")).over(w) * total
    rows = shares.withColumn("ideal", ideal).withColumn("base", F.floor("ideal"))
    rows = rows.withColumn("left", (total - F.sum("base").over(w)).cast("long"))
    nth = F.row_number().over(w.orderBy(F.desc(F.round(F.col("ideal") - F.col("base"), 9)), F.desc(share), key))
    return rows.withColumn("n", F.col("base") + F.when(nth <= F.col("left"), 1).otherwise(0)).drop("ideal", "base", "left")


def parse_mix(text: Column) -> Column:
    """"k:v,k:v" as a map of shares that sum to 1; of a repeated key the last counts.

    Null where a part isn't a key and a number, or the numbers sum to nothing above 0.
    """
    pieces = F.transform(F.split(text, ","), lambda p: F.split(p, ":"))
    pairs = F.transform(pieces, lambda p: F.struct(F.trim(F.get(p, F.lit(0))).alias("key"), F.trim(F.get(p, F.lit(1))).try_cast("double").alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    total = F.aggregate(last, F.lit(0.0), lambda s, p: s + p["value"])
    fine = F.forall(pieces, lambda p: F.size(p) == 2) & F.forall(pairs, lambda p: p["value"].isNotNull()) & (total > 0)
    return F.when(fine, F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"] / total))))


def expanded(counts: DataFrame, n: str) -> DataFrame:
    """Each row ``n`` times, with its copy number from 1; rows with n < 1 vanish."""
    return counts.filter(F.col(n) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))))


def two_axes(plans: DataFrame, by: str, first: DataFrame, second: DataFrame, count: str, pad: str, seed: int) -> DataFrame:
    """by, place, and a key of either axis for each of the places 1..count of a plan.

    ``first`` and ``second``: by, key and n, counts of the keys of one axis each, allocated
    apart. Both lists are shuffled by themselves and zipped, so neither axis tells the
    other and both keep their counts; what ``first`` lacks is ``pad``, what it has over
    the count goes (before the shuffle, by key), and ``second`` is null where it ends.
    A plan has a bounded number of places.
    """

    def placed(axis: DataFrame, name: str, cut: bool) -> DataFrame:
        each = expanded(axis.select(by, F.col("key").alias(name), "n"), "n").select(by, name, "copy")
        if cut:
            kept = F.row_number().over(Window.partitionBy(by).orderBy(name, "copy"))
            each = each.withColumn("kept", kept).join(plans.select(by, count), by).filter(F.col("kept") <= F.col(count)).drop("kept", count)
        order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(name), F.col(by).cast("string"), F.col(name), F.col("copy").cast("string")))
        return each.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order))).drop("copy")

    # places of the padding are shuffled with the rest: they take part as keys of their own
    have = first.filter("n > 0").groupBy(by).agg(F.sum("n").alias("have"))
    missing = plans.join(have, by, "left").select(by, F.lit(pad).alias("key"), F.greatest(F.col(count) - F.coalesce("have", F.lit(0)), F.lit(0)).cast("long").alias("n"))
    padded = first.select(by, "key", F.col("n").cast("long").alias("n")).unionByName(missing).groupBy(by, "key").agg(F.sum("n").alias("n"))
    places = plans.filter(F.col(count) > 0).select(by, F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))).alias("place"))
    return places.join(placed(padded, "first", True), [by, "place"], "left").join(placed(second, "second", False), [by, "place"], "left")


def topped_up(gaps: DataFrame, spare: DataFrame, slot: str, rounds: int = 2) -> DataFrame:
    """The spare rows (slot, i from 1, good, more) that are drawn for each slot's gap, with their ``round``.

    A round draws as many rows of the slot as it still lacks, in order; those that aren't
    good leave a gap for the next round. What a slot lacks after the last round it lacks.
    """
    drawn, state = None, gaps.select(slot, "gap", F.lit(0).cast("long").alias("used"))
    for n in range(1, rounds + 1):
        now = spare.join(state, slot).filter((F.col("i") > F.col("used")) & (F.col("i") <= F.col("used") + F.col("gap")))
        one = now.select(*spare.columns, F.lit(n).alias("round"))
        drawn = one if drawn is None else drawn.unionByName(one)
        met = now.groupBy(slot).agg(F.count_if("good").alias("met"))
        state = state.join(met, slot, "left").select(slot, (F.col("gap") - F.coalesce("met", F.lit(0))).alias("gap"), (F.col("used") + F.col("gap")).alias("used"))
    return drawn


def displacement(legs: DataFrame, by: Sequence[str], direction: str, distance: str) -> DataFrame:
    """End point and straight distance of a walk along compass directions."""
    d = F.col(direction)
    x = F.when(d == "E", F.col(distance)).when(d == "W", -F.col(distance)).otherwise(0)
    y = F.when(d == "N", F.col(distance)).when(d == "S", -F.col(distance)).otherwise(0)
    ends = legs.groupBy(*by).agg(F.sum(x).alias("x"), F.sum(y).alias("y"))
    return ends.withColumn("distance", F.hypot(F.col("x").cast("double"), F.col("y").cast("double")))


def series_term(rule: Column, first: Column, k: Column, n: Column) -> Column:
    """Term number ``n`` (from 1) of a series: add, multiply, or add the squares of 1.. ."""
    steps = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    fold = lambda f: F.aggregate(steps, first.cast("double"), f)
    many = (
        F.when(rule == "add", fold(lambda v, i: v + k)).when(rule == "multiply", fold(lambda v, i: v * k))
        .when(rule == "squares", fold(lambda v, i: v + i * i)).when(rule == "alternate", fold(lambda v, i: F.when(i % 2 == 1, v + k).otherwise(v * 2)))
    )
    return F.when(n <= 1, first.cast("double")).otherwise(many)


def same_calendar(year: Column) -> Column:
    """The next year that begins on the same weekday and is as long."""
    leap = lambda y: ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    weekday = lambda y: F.dayofweek(F.make_date(y, F.lit(1), F.lit(1)))
    later = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: year + i)
    return F.array_min(F.filter(later, lambda y: (weekday(y) == weekday(year)) & (leap(y) == leap(year))))


def water_clock(minutes: Column) -> Column:
    """Minutes that a clock reflected about its vertical axis shows."""
    return F.pmod(720 - minutes, F.lit(720))


def mirror_clock(minutes: Column) -> Column:
    """Minutes that a clock reflected about its horizontal axis shows."""
    return F.pmod(360 - minutes, F.lit(720))


#: Segments of a block of a figure; a task holds three blocks and their crossings.
SEGMENTS = 1024


def triangles(segments: DataFrame, figure: str, key: str, block: int = SEGMENTS) -> DataFrame:
    """Number of triangles of each figure's segments (x1, y1, x2, y2); figures without any are absent.

    Three segments bound one if each two cross, within both, at three places that are
    pairwise distinct and not on one line. Segments of equal keys aren't compared.

    A figure's segments are dealt into blocks by place, and a task counts the triangles of
    three blocks: it holds the crossings of their pairs and makes no row for a crossing or a
    triple, so what is exchanged is a segment once for each pair of other blocks, and what
    leaves a task is one number. Time still grows with the cube of a figure's segments.
    """
    plain = segments.select(F.col(figure).alias("figure"), F.col(key).cast("long").alias("key"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    placed = rank_within(plain.filter("figure IS NOT NULL AND key IS NOT NULL"), "figure", ["key", "x1", "y1", "x2", "y2"], "nth")
    dealt = placed.withColumn("own", F.floor((F.col("nth") - 1) / block).cast("int"))
    dealt = dealt.join(dealt.groupBy("figure").agg((F.max("own") + 1).alias("blocks")), "figure")
    # the other two blocks of a task, the three of them in ascending order
    others = F.expr("flatten(transform(sequence(0, blocks - 1), a -> transform(sequence(a, blocks - 1), b -> array_sort(array(own, a, b)))))")
    tasks = dealt.withColumn("t", F.explode(F.array_distinct(others)))
    rows = tasks.select("figure", *[F.get("t", F.lit(i)).alias(f"t{i}") for i in range(3)], "own", "nth", "key", "x1", "y1", "x2", "y2")
    counted = rows.groupBy("figure", "t0", "t1", "t2").applyInArrow(_block_triangles, T.StructType([rows.schema["figure"], T.StructField("n", T.LongType())]))
    found = counted.groupBy("figure").agg(F.sum("n").alias("triangles")).filter("triangles > 0")
    return found.withColumnRenamed("figure", figure)


def _crossings(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the segments a and b (rows of x1, y1, x2, y2): whether they cross, where, and the sine of their angle."""
    eps = 1e-9
    (x1, y1, x2, y2), (x3, y3, x4, y4) = [c[:, None] for c in a.T], [c[None] for c in b.T]
    dxa, dya, dxb, dyb, gx, gy = x1 - x2, y1 - y2, x3 - x4, y3 - y4, x1 - x3, y1 - y3
    with np.errstate(all="ignore"):
        across = dxa * dyb - dya * dxb
        t, u = (gx * dyb - gy * dxb) / across, (gx * dya - gy * dxa) / across
        met = (np.abs(across) >= eps) & (t >= -eps) & (t <= 1 + eps) & (u >= -eps) & (u <= 1 + eps)
        return met, x1 - t * dxa, y1 - t * dya, np.abs(across) / (np.hypot(dxa, dya) * np.hypot(dxb, dyb))


def _bound(u: tuple, v: tuple, w: tuple) -> np.ndarray:
    """Whether three places (x, y) are pairwise distinct and not on one line."""
    eps, apart = 1e-9, 1e-6
    differ = lambda m, n: (np.abs(m[0] - n[0]) >= apart) | (np.abs(m[1] - n[1]) >= apart)
    return (np.abs((v[0] - u[0]) * (w[1] - u[1]) - (w[0] - u[0]) * (v[1] - u[1])) >= eps) & differ(u, v) & differ(v, w) & differ(u, w)


def _near(x: np.ndarray, y: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places i and j of the pairs with |x[i] - y[j]| < far[i]."""
    order = np.argsort(y)
    low, high = np.searchsorted(y[order], x - far, "left"), np.searchsorted(y[order], x + far, "right")
    n = high - low
    j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return np.repeat(np.arange(len(x)), n), order[j]


def _block_triangles(rows: pa.Table) -> pa.Table:
    """The triangles whose segments, by place, lie in the blocks t0, t1 and t2 of a figure.

    With d between the crossings of a with b and with c, the other sides are at least d
    times the sine of a's angles with b and c, and twice the area d squared times both: so
    where d is large against these, the triangle is one for sure, and a product of matrices
    counts it. What is near, or crosses at a tiny angle, is judged one by one.
    """
    rows = rows.sort_by("nth")
    own, key = rows["own"].to_numpy(), rows["key"].to_numpy()
    ends = np.stack([rows[c].to_numpy() for c in ("x1", "y1", "x2", "y2")], axis=1).astype(np.float64)
    at = [np.flatnonzero(own == rows[f"t{i}"][0].as_py()) for i in range(3)]
    clear = 1e-4 * max(1.0, float(np.abs(ends).max()))

    def pair(i: int, j: int) -> tuple[np.ndarray, ...]:
        met, x, y, sine = _crossings(ends[at[i]], ends[at[j]])
        met &= key[at[i]][:, None] < key[at[j]][None]
        return met, x, y, sine, met & (sine >= 1e-3)

    (m01, x01, y01, s01, p01), (m02, x02, y02, s02, p02), (m12, x12, y12, _, p12) = pair(0, 1), pair(0, 2), pair(1, 2)
    odd12 = bool((m12 & ~p12).any())
    sure = (p01.astype(np.float32) @ p12.astype(np.float32))[p02]  # each a whole number of at most a block
    total = int(sure.sum(dtype=np.float64))
    first = ends[at[0]]
    for a in range(len(first)):
        b, c = np.flatnonzero(p01[a]), np.flatnonzero(p02[a])
        if len(b) and len(c):
            along = first[a, 2:] - first[a, :2]
            along /= np.hypot(*along)
            tb, tc = x01[a, b] * along[0] + y01[a, b] * along[1], x02[a, c] * along[0] + y02[a, c] * along[1]
            fb, fc = clear / s01[a, b], clear / s02[a, c]
            i, j = _near(tb, tc, fb)
            k, h = _near(tc, tb, fc)
            fresh = np.abs(tb[h] - tc[k]) >= fb[h]  # not found from the other side
            i, j = np.concatenate([i, h[fresh]]), np.concatenate([j, k[fresh]])
            inner = np.abs(tb[i] - tc[j]) < np.maximum(fb[i], fc[j])
            p, q = b[i[inner]], c[j[inner]]
            held = p12[p, q]
            p, q = p[held], q[held]
            total -= int((~_bound((x01[a, p], y01[a, p]), (x12[p, q], y12[p, q]), (x02[a, q], y02[a, q]))).sum())
        b, c = np.flatnonzero(m01[a]), np.flatnonzero(m02[a])
        if len(b) and len(c) and (odd12 or not (p01[a, b].all() and p02[a, c].all())):
            met = np.ix_(b, c)
            i, j = np.nonzero(m12[met] & ~(p12[met] & p01[a, b][:, None] & p02[a, c][None]))
            p, q = b[i], c[j]
            total += int(_bound((x01[a, p], y01[a, p]), (x12[p, q], y12[p, q]), (x02[a, q], y02[a, q])).sum())
    return pa.table({"figure": rows["figure"].slice(0, 1), "n": pa.array([total], pa.int64())})


def batch_replies(replies: DataFrame, by: Sequence[str], raw: str, sections: Column, fields: Sequence[str]) -> DataFrame:
    """The first question of each section number in 1..sections of a JSON reply, with its text fields.

    Replies that are no JSON object give no rows; numbers that aren't whole are none.
    """
    question = "struct<section_number: bigint, " + ", ".join(f"{f}: string" for f in fields) + ">"
    parsed = F.from_json(raw, f"struct<questions: array<{question}>>")
    rows = replies.select(*by, sections.alias("sections"), F.posexplode(parsed["questions"]).alias("place", "q"))
    fine = rows.filter(F.col("q.section_number").between(1, F.col("sections")))
    first = fine.groupBy(*by, F.col("q.section_number").alias("section")).agg(F.min(F.struct("place", "q")).alias("first"))
    return first.select(*by, "section", *[F.col(f"first.q.{f}").alias(f) for f in fields])


def sole_value(conditions: list, low: int = 1, high: int = 99) -> Column:
    """The one value in low..high that meets every condition; null where none or several do."""
    found = F.sequence(F.lit(low), F.lit(high))
    for c in conditions:
        found = F.filter(found, c)
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def has_exactly(members: DataFrame, person: str, prop: str, wanted: dict[str, bool]) -> DataFrame:
    """Persons with all properties wanted and none unwanted."""
    cond = None
    for name, want in wanted.items():
        one = (F.count_if(F.col(prop) == name) > 0) == F.lit(want)
        cond = one if cond is None else cond & one
    return members.groupBy(person).agg(cond.alias("fits")).filter("fits").select(person)


def opposite_faces(views: DataFrame, by: str, faces: int = 6) -> DataFrame:
    """by, face, opposite: where all other faces of a die but one have been seen next to a face."""
    pairs = views.select(by, F.explode(F.array(*[F.struct(F.col(a).alias("face"), F.col(b).alias("next")) for a in ("top", "left", "right") for b in ("top", "left", "right") if a != b])).alias("p"))
    seen = pairs.groupBy(by, "p.face").agg(F.collect_set("p.next").alias("near"))
    rest = F.array_except(F.sequence(F.lit(1), F.lit(faces)), F.concat("near", F.array("face")))
    return seen.filter(F.size(rest) == 1).select(by, "face", F.element_at(rest, 1).alias("opposite"))


def compose(path: Column, table: dict[tuple[str, str], str]) -> Column:
    """Fold of a path of roles by a composition table; null once a step is undefined."""
    entries = F.create_map(*[x for (a, b), c in table.items() for x in (F.lit(f"{a}>{b}"), F.lit(c))])
    rest = F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0)))
    return F.aggregate(rest, F.element_at(path, 1), lambda acc, step: F.try_element_at(entries, F.concat_ws(">", acc, F.coalesce(step, F.lit("?")))))


def distractors(answer: Column, candidates: Column, n: int = 3) -> Column:
    """The first ``n`` distinct positive candidates other than the answer, then its neighbours."""
    near = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(n + 1)), lambda i: F.array(answer + i, answer - i)))
    pool = F.filter(F.array_distinct(F.concat(candidates, near)), lambda c: (c > 0) & (c != answer))
    return F.slice(pool, 1, n)
