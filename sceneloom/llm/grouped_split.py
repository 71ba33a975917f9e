"""Problem 2: splits that keep tied records together.

Two rows are tied by an equal segment, scene or group. The ties make a graph whose nodes are scenes and groups (a
segment only links the nodes it shows), and its components are found by alternating large-star and small-star steps.
Components are then placed by grouped iterative stratification: label vectors are added up for each component, the
rarest outstanding label comes first, and its components, largest first, go to the split that needs the label most.

Scale: the graph has a node for each scene and group, never one for a row; each step takes minima with partial
aggregation, so that a hot scene is one number by the time it is shuffled, and joins that Spark may split by rows.
Placement is sequential by nature. Components with more than ``big`` of all records are fewer than 1/big and are placed
first, together. The rest is placed in randomised shards of about ``shard_units`` components, each working towards its
quota of what the large ones left of every label's share. Quotas are whole numbers, handed out along the shards so that
they add up: a label too rare for a split in any one shard still gets its share over all. No component list goes to the driver. Label columns are categories: of more
than ``most_labels`` values in all, which would make label vectors long, an error is raised; so a task holds at most 1/big
or about ``shard_units`` vectors of that length.

Defined results: null ties nothing (a segment with neither scene nor group is a component of its own); a null or
unknown split shows no split; rows without segment_id are left out; a record delivered repeatedly counts once for size
and once for each label; a null label counts for the size only; a unit without any group has the null unit_id; an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise
from .text import split_name, trimmed

SPLITS = ("train", "validation", "test")


@dataclass(frozen=True)
class Params:
    """shares: of the splits; labels: columns to stratify by; big: share of all records from which a component is placed
    in the first round; shard_units: components of a shard, about; most_labels: values of all label columns at most."""

    shares: tuple[float, ...] = (0.8, 0.1, 0.1)
    labels: tuple[str, ...] = ("work_id", "recommended_task")
    big: float = 0.001
    shard_units: int = 20_000
    most_labels: int = 10_000


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root of a graph given as (u, v) with u > v: the root is the least node of the component. Nodes without an
    edge don't come out. Each round is a written table; rounds end when nothing changes."""
    before = None
    while True:
        now = _fingerprint(edges)
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = now
        # large star: every larger neighbour of a node is linked to the node's least neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours are linked to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u")
        edges = linked.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialise(edges, "p2-edges")


def units(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, groups). segments: segment_id, unit; groups: unit, unit_id (null where the unit has no group)."""
    s, g = F.col("scene_id"), trimmed(F.col("scene_group_id"))
    nodes = F.array_compact(F.array(F.concat(F.lit("g:"), g), F.concat(F.lit("s:"), s)))
    shown = df.where("segment_id is not null").select("segment_id", F.explode_outer(nodes).alias("node")).distinct()
    shown = materialise(shown, "p2-shown")
    first = shown.groupBy("segment_id").agg(F.min("node").alias("least"))
    edges = shown.join(first, "segment_id").where("node > least").select(F.col("node").alias("u"), F.col("least").alias("v")).distinct()
    roots = materialise(components(materialise(edges, "p2-edges")), "p2-roots")
    unit = F.coalesce("root", "least", F.concat(F.lit("x:"), F.col("segment_id")))
    segments = first.join(roots.withColumnRenamed("node", "least"), "least", "left").select("segment_id", unit.alias("unit"))
    every = shown.where("node is not null").select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("unit"))
    groups = every.groupBy("unit").agg(F.min(F.when(F.col("node").startswith("g:"), F.expr("substr(node, 3)"))).alias("unit_id"))
    return segments, groups


def torn(df: DataFrame) -> DataFrame:
    """segment_id, unit_id: the segments of units whose rows show two or more splits."""
    segments, groups = units(df)
    segments = materialise(segments, "p2-segments")
    s = split_name(F.col("split"))
    shown = df.select("segment_id", s.alias("split")).where(F.col("split").isin(*SPLITS) & F.col("segment_id").isNotNull()).distinct()
    split = shown.join(segments, "segment_id").groupBy("unit").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").select("unit")
    return segments.join(split.join(groups, "unit", "left"), "unit").select("segment_id", "unit_id")


def place(units: list[tuple[str, int, dict]], need: dict, need_all: list[float]) -> dict[str, int]:
    """Split number of each (unit, size, label → count). need: label → what each split still wants of it; need_all: of all
    records. Both are used up. Only splits with room for half of the unit are asked; where none has it, the one wanting
    most records takes it. Ties: the split wanting most records, then the first; units by falling count, size, name."""
    having: dict = {}
    for k, (_, _, labels) in enumerate(units):
        for label in labels:
            having.setdefault(label, []).append(k)
    left = {label: sum(units[k][2][label] for k in ks) for label, ks in having.items()}
    out: dict[str, int] = {}

    def put(k: int, wants: list[float]) -> None:
        name, size, labels = units[k]
        # the shares of all records come before those of a label: a split that is full takes nothing more
        fits = [s for s in range(len(need_all)) if 2 * need_all[s] >= size]
        to = max(fits, key=lambda s: (wants[s], need_all[s], -s)) if fits else max(range(len(need_all)), key=lambda s: (need_all[s], -s))
        out[name] = to
        need_all[to] -= size
        for label, n in labels.items():
            need[label][to] -= n
            left[label] -= n

    while left:
        label = min(left, key=lambda x: (left[x], str(x)))
        for k in sorted(having[label], key=lambda k: (-units[k][2][label], -units[k][1], units[k][0])):
            if units[k][0] not in out:
                put(k, need[label])
        del left[label]
        left = {x: n for x, n in left.items() if n > 0}
    for k in sorted(range(len(units)), key=lambda k: (-units[k][1], units[k][0])):
        if units[k][0] not in out:
            put(k, need_all)
    return out


def assign(df: DataFrame, p: Params = Params()) -> DataFrame:
    """segment_id, unit, split: every segment with its unit and the split the unit is placed in."""
    if len(p.shares) != len(SPLITS) or min(p.shares) < 0 or abs(sum(p.shares) - 1) > 1e-9:
        raise ValueError("shares must be three and add up to 1")
    segments, _ = units(df)
    segments = materialise(segments, "p2-segments")
    label = F.explode(F.array_compact(F.array(*[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in p.labels]))) if p.labels else F.explode(F.array().cast("array<string>"))
    labels = df.where("segment_id is not null").select("segment_id", label.alias("label")).distinct()
    sizes = segments.groupBy("unit").agg(F.count(F.lit(1)).alias("size"))
    counts = labels.join(segments, "segment_id").groupBy("unit", "label").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts, "p2-counts")
    values = counts.select("label").distinct().count()
    if values > p.most_labels:
        raise ValueError(f"{values} labels are too many to stratify by")
    vectors = counts.groupBy("unit").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("labels"))
    vectors = materialise(sizes.join(vectors, "unit", "left"), "p2-units")
    total, n_units = vectors.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()

    def sharded(rows: DataFrame, wants: DataFrame, want_all: list[float]) -> DataFrame:
        """rows: shard, unit, size, labels. wants: label and each split's share of what is left of it."""
        sums = rows.select("shard", F.explode("labels").alias("label", "n")).groupBy("shard", "label").agg(F.sum("n").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("label").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a shard
        sums = sums.withColumn("before", before).join(wants, "label")
        # the last two splits take turns, the first has the rest
        quota = [F.floor((F.col("before") + F.col("n")) * F.col(f"w{k}") + at) - F.floor(F.col("before") * F.col(f"w{k}") + at) for k, at in ((1, 0.25), (2, 0.75))]
        sums = sums.select("shard", "label", quota[0].alias("q1"), quota[1].alias("q2"), (F.col("n") - quota[0] - quota[1]).alias("q0"))
        long = rows.select("shard", "unit", "size", F.explode_outer("labels").alias("label", "n")).join(sums, ["shard", "label"], "left")
        # a null label row keeps a unit without labels
        def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
            some = x[x["label"].notna()]
            of: dict = {}
            for u, lab, n in zip(some["unit"], some["label"], some["n"]):
                of.setdefault(u, {})[lab] = int(n)
            size = dict(zip(x["unit"], x["size"]))
            need = {lab: list(q) for lab, *q in zip(some["label"], some["q0"], some["q1"], some["q2"])}
            got = place([(u, int(n), of.get(u, {})) for u, n in sorted(size.items())], need, [w * sum(size.values()) for w in want_all])
            return pd.DataFrame({"unit": list(got), "split": [SPLITS[s] for s in got.values()]})

        return long.groupBy("shard").applyInPandas(run, "unit string, split string")

    is_big = F.col("size") > p.big * total
    # all big units together want the shares of the whole, not of themselves
    done = materialise(_place_big(vectors.where(is_big), vectors, p, total), "p2-big")
    placed = done.join(vectors, "unit")
    got = {r["split"]: r["n"] for r in placed.groupBy("split").agg(F.sum("size").alias("n")).collect()}
    rest = max(1, total - sum(got.values()))
    raw = [max(0.0, w * total - got.get(s, 0)) / rest for w, s in zip(p.shares, SPLITS)]
    want_all = [w / (sum(raw) or 1) for w in raw]
    by = placed.select("split", F.explode("labels").alias("label", "n")).groupBy("label").agg(*[F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).alias(f"g{k}") for k, s in enumerate(SPLITS)])
    of = vectors.select(F.explode("labels").alias("label", "n")).groupBy("label").agg(F.sum("n").alias("all"))
    w = of.join(by, "label", "left").select("label", *[F.greatest(F.lit(0.0), F.lit(float(s)) * F.col("all") - F.coalesce(f"g{k}", F.lit(0))).alias(f"r{k}") for k, s in enumerate(p.shares)])
    left = F.col("r0") + F.col("r1") + F.col("r2")
    wants = w.select("label", *[F.when(left > 0, F.col(f"r{k}") / left).otherwise(F.lit(float(s))).alias(f"w{k}") for k, s in enumerate(p.shares)])
    shards = max(1, -(-n_units // p.shard_units))
    small = vectors.where(~is_big).withColumn("shard", F.pmod(F.xxhash64("unit"), F.lit(shards)).cast("int"))
    placed_all = done.union(sharded(small, wants, want_all))
    return segments.join(placed_all, "unit").select("segment_id", "unit", "split")


def _place_big(first: DataFrame, vectors: DataFrame, p: Params, total: int) -> DataFrame:
    """unit, split of the big units, fewer than 1/big of them, in one task: they want the whole table's shares."""
    of = vectors.select(F.explode("labels").alias("label", "n")).groupBy("label").agg(F.sum("n").alias("all"))
    long = first.select("unit", "size", F.explode_outer("labels").alias("label", "n")).join(of, "label", "left").withColumn("one", F.lit(0))

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        some = x[x["label"].notna()]
        vec: dict = {}
        for u, lab, n in zip(some["unit"], some["label"], some["n"]):
            vec.setdefault(u, {})[lab] = int(n)
        need = {lab: [w * n for w in p.shares] for lab, n in zip(some["label"], some["all"])}
        size = dict(zip(x["unit"], x["size"]))
        got = place([(u, int(n), vec.get(u, {})) for u, n in sorted(size.items())], need, [w * total for w in p.shares])
        return pd.DataFrame({"unit": list(got), "split": [SPLITS[s] for s in got.values()]})

    return long.groupBy("one").applyInPandas(run, "unit string, split string")


def balance(df: DataFrame, p: Params = Params()) -> DataFrame:
    """split, segments, units, share: how the assignment came out."""
    a = materialise(assign(df, p), "p2-assigned")
    whole = max(1, a.count())
    by = a.groupBy("split").agg(F.count(F.lit(1)).alias("segments"), F.countDistinct("unit").alias("units"))
    return by.select("split", "segments", "units", (F.col("segments") / whole).alias("share"))


def label_balance(df: DataFrame, p: Params = Params()) -> DataFrame:
    """label, segments, train, validation, test: the share of each split among the segments with a label."""
    a = assign(df, p)
    label = F.explode(F.array_compact(F.array(*[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in p.labels])))
    rows = df.where("segment_id is not null").select("segment_id", label.alias("label")).distinct().join(a.select("segment_id", "split"), "segment_id")
    n = F.count(F.lit(1))
    return rows.groupBy("label").agg(n.alias("segments"), *[(F.count_if(F.col("split") == s) / n).alias(s) for s in SPLITS])


def check(df: DataFrame, p: Params = Params(), slack: float = 0.02) -> DataFrame:
    """segments, missing, torn_units, within: one row; segments without a split, units in two splits, and whether each split's
    share is within ``slack`` of what was asked for."""
    every = df.where("segment_id is not null").select("segment_id").distinct()
    rows = every.join(materialise(assign(df, p), "p2-assigned"), "segment_id", "left")
    units_ = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split").isNull()).alias("none"), F.min("split").alias("a"), F.max("split").alias("b"), *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])
    n = F.sum("n")
    within = F.lit(True)
    for s, w in zip(SPLITS, p.shares):
        within = within & (F.abs(F.sum(s) / n - w) <= slack)
    return units_.agg(F.coalesce(n, F.lit(0)).alias("segments"), F.coalesce(F.sum("none"), F.lit(0)).alias("missing"), F.count_if(F.col("a") != F.col("b")).alias("torn_units"), F.coalesce(within, F.lit(True)).alias("within"))
