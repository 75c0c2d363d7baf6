"""Splits that keep linked sessions together.

Records that share a person are components of a graph. Components come from local
contraction, hooking to the smallest root and pointer jumping. The table node, component,
splits is kept in buckets of components; a load of new links reads it, merges only the
components they name and rewrites only the buckets of those that change. A component that
holds one split keeps it, one without fills what the targets lack, one with two or more,
be it by a merge, is quarantined.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkline.core import cut, patient_key, scratch, split_name, therapist_key
from larkline.llm.ranks import rank_within

TABLE = "node string, component string, splits array<string>"


def _forest(edges: DataFrame) -> DataFrame:
    """node, root: each task joins the edges it holds, whichever they are, into trees of depth one."""

    def unite(batches):
        up: dict[str, str] = {}

        def root(x: str) -> str:
            top = x
            while (y := up.get(top, top)) != top:
                top = y
            while x != top:
                up[x], x = top, up.get(x, x)
            return top

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        nodes = list(up)
        for k in range(0, len(nodes), 10_000):
            part = nodes[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([root(x) for x in part], pa.string())], names=["node", "root"])

    return edges.select("a", "b").mapInArrow(unite, "node string, root string")


def components(links: DataFrame) -> DataFrame:
    """node, component of links (a, b): every node with the representative of its component.

    Tasks contract the edges they hold, every node hooks to its smallest root, pointer jumping
    flattens the hooks, and edges between different roots go into the next round. A hub's edges may
    lie in any tasks.

    Defined cases: links with a null end name no node for it; a link to itself, or with one null
    end, makes a component of one; repeated links change nothing; no links give no rows.
    """
    ends = cut(links.select(F.coalesce("a", "b").alias("a"), F.coalesce("b", "a").alias("b")).filter("a is not null").distinct())
    table = ends.select(F.col("a").alias("node")).union(ends.select("b")).distinct().withColumn("component", F.col("node"))
    edges = ends.filter("a <> b")
    while not edges.isEmpty():
        forest = cut(_forest(edges))
        up = cut(forest.groupBy("node").agg(F.min("root").alias("up")))
        while True:
            over = up.select(F.col("node").alias("x"), F.col("up").alias("over"))
            jumped = cut(up.join(over, F.col("up") == F.col("x"), "left").select("node", F.coalesce("over", "up").alias("up"), F.col("over").isNotNull().alias("moved")))
            if jumped.filter("moved").isEmpty():
                break
            up = jumped.drop("moved")
        step = up.select(F.col("node").alias("x"), "up")
        table = table.join(step, F.col("component") == F.col("x"), "left").select("node", F.coalesce("up", "component").alias("component"))
        a = forest.join(step, F.col("node") == F.col("x")).select(F.col("up").alias("a"), F.col("root").alias("r"))
        b = a.join(step, F.col("r") == F.col("x"), "left").select("a", F.coalesce("up", "r").alias("b")).filter("a <> b")
        edges = cut(b.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return cut(table)


def _merged(near: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, component, old (null: new node) of everything ``ends`` touch; and the step old -> to of components.

    ``near``: node, component of the nodes that ``ends`` (a, b, none null) name.
    """
    at = near.select(F.col("node").alias("n"), F.col("component").alias("c"))
    a = ends.join(at, F.col("a") == F.col("n"), "left").select("a", "b", F.col("c").alias("ca"))
    both = cut(a.join(at, F.col("b") == F.col("n"), "left").select("a", "b", "ca", F.col("c").alias("cb")))
    step = components(both.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))).select(F.col("node").alias("old"), F.col("component").alias("to"))
    nodes = both.select(F.col("a").alias("node"), F.col("ca").alias("was")).union(both.select("b", "cb")).distinct()
    return nodes.join(step, F.coalesce("was", "node") == F.col("old")).select("node", F.col("to").alias("component"), F.col("was").alias("old")), step


def _ends(links: DataFrame) -> DataFrame:
    return links.filter("a is not null or b is not null").select(F.coalesce("a", "b").alias("a"), F.coalesce("b", "a").alias("b")).distinct()


def update_components(table: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table node, component with new links merged in, and the merges: old component -> new one.

    Only components named by a new link are joined; all others stay as they are.
    """
    ends = cut(_ends(links))
    named = ends.select(F.col("a").alias("node")).union(ends.select("b")).distinct()
    found, step = _merged(table.select("node", "component").join(named, "node", "left_semi"), ends)
    merges = cut(step.filter("old <> to").select("old", F.col("to").alias("new")))
    kept = table.select("node", "component").join(merges, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    return cut(kept.union(found.filter("old is null").select("node", "component"))), merges


class SplitStore:
    """The table node, component, splits (two or more: quarantined) under one folder, in buckets of components.

    A version is a small manifest that names the files of each bucket; it appears by a rename, so a
    version half written is never read. A bucket that a load leaves alone keeps its files.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _file(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def manifest(self) -> tuple[int, dict[str, int]]:
        """Number of the newest version, -1 where there is none, and the load that wrote each bucket."""
        fs, folder = self._file("versions")
        have = [int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()] if fs.exists(folder) else []
        if not have:
            return -1, {}
        text = self.spark.read.text(f"{self.path}/versions/{max(have)}").first()[0]
        return max(have), json.loads(text)

    def read(self, only: list[str] | None = None) -> DataFrame:
        """The newest version, or its buckets ``only``; an empty table where there is none."""
        _, at = self.manifest()
        paths = [f"{self.path}/data/{v}/bucket={b}" for b, v in at.items() if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], TABLE)
        return self.spark.read.schema(TABLE).parquet(*paths)

    def bucket(self, component: str = "component"):
        return F.pmod(F.xxhash64(component), F.lit(self.buckets)).cast("string")

    def near(self, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
        """With the links ``ends`` merged in: node, component, old of all that they touch; splits by component."""
        named = ends.select(F.col("a").alias("node")).union(ends.select("b")).distinct()
        table = self.read()
        mine = cut(table.join(named, "node", "left_semi"))
        found, step = _merged(mine.select("node", "component"), ends)
        touched = mine.select("component", "splits").distinct()
        rest = table.select("node", "component").join(touched.select("component"), "component", "left_semi").join(named, "node", "left_anti")
        rest = rest.join(step, F.col("component") == F.col("old")).select("node", F.col("to").alias("component"), "old")
        held = touched.join(step, F.col("component") == F.col("old")).select(F.col("to").alias("component"), F.explode("splits").alias("s"))
        return cut(found.union(rest)), cut(held.groupBy("component").agg(F.sort_array(F.collect_set("s")).alias("held")))

    def save(self, near: DataFrame, splits: DataFrame, held: DataFrame) -> set[str]:
        """Write ``near`` with its components' ``splits`` as the next version; the buckets it rewrote."""
        now = near.join(splits, "component", "left").join(held, "component", "left").withColumn("splits", F.coalesce("splits", "held", F.array().cast("array<string>")))
        moved = (~F.col("component").eqNullSafe(F.col("old"))) | (F.col("splits") != F.coalesce("held", F.array().cast("array<string>")))
        changed = cut(now.join(now.filter(moved).select("component").distinct(), "component", "left_semi").select("node", "component", "splits", "old"))
        gone = changed.select(F.col("old").alias("component")).filter("component is not null").distinct()
        hit = {r[0] for r in gone.select(self.bucket()).union(changed.select(self.bucket())).distinct().collect()}  # at most ``buckets``
        version, at = self.manifest()
        if not hit:
            return hit
        rows = self.read(sorted(hit & set(at))).join(gone, "component", "left_anti").select("node", "component", "splits").union(changed.select("node", "component", "splits"))
        rows = rows.withColumn("bucket", self.bucket()).repartition(F.col("bucket"))
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{version + 1}")
        fs, folder = self._file(f"data/{version + 1}")
        whole = {x.getPath().getName()[7:] for x in fs.listStatus(folder) if x.getPath().getName().startswith("bucket=")}
        text = json.dumps({b: v for b, v in at.items() if b not in hit} | dict.fromkeys(sorted(whole), version + 1))
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/new")
        fs, new = self._file("new")
        target = self._file(f"versions/{version + 1}")[1]
        fs.mkdirs(target.getParent())
        if not fs.rename(new, target):
            raise RuntimeError(f"version {version + 1} of {self.path} is there already")
        return hit

    def add(self, links: DataFrame) -> DataFrame:
        """Merge links (a, b) in and return the next version; splits stay with the components."""
        near, held = self.near(cut(_ends(links)))
        self.save(near, held.select("component", F.col("held").alias("splits")), held)
        return self.read()


def current_sessions(sessions: DataFrame) -> DataFrame:
    """session, patient, therapist, split: each session's newest export, ids and splits in one spelling."""
    newest = F.max(F.struct(F.col("updated_at"), F.col("split"), F.col("patient_id"), F.col("therapist_id"))).alias("x")
    rows = sessions.filter(F.col("session_id").isNotNull()).groupBy("session_id").agg(newest)
    return rows.select(
        F.col("session_id").alias("session"),
        patient_key(F.col("x.patient_id")).alias("patient"),
        therapist_key(F.col("x.therapist_id")).alias("therapist"),
        split_name(F.col("x.split")).alias("split"),
    )


def _placed(sessions: DataFrame, store: SplitStore) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sessions with their component; near and held of the store; groups: component, have, group_therapist, n.

    A session that names nobody is a node of its own.
    """
    rows = current_sessions(sessions)
    p, t = F.concat(F.lit("p:"), F.col("patient")), F.concat(F.lit("t:"), F.col("therapist"))
    rows = cut(rows.withColumn("node", F.coalesce(p, t, F.concat(F.lit("s:"), F.col("session").cast("string")))).withColumn("other", t))
    near, held = store.near(cut(_ends(rows.select(F.col("node").alias("a"), F.col("other").alias("b")))))
    rows = cut(rows.join(near.select("node", "component"), "node").drop("node", "other"))
    own = rows.groupBy("component").agg(F.collect_set("split").alias("own"), F.count("*").alias("n"))
    first = near.filter(F.col("node").startswith("t:")).groupBy("component").agg(F.min(F.substring("node", 3, 99)).alias("group_therapist"))
    groups = own.join(held, "component", "left").join(first, "component", "left")
    have = F.sort_array(F.array_union("own", F.coalesce("held", F.array().cast("array<string>"))))
    return rows, near, held, cut(groups.select("component", have.alias("have"), "group_therapist", "n"))


def fill_plan(sizes: dict[int, int], lack: dict[str, float]) -> list[tuple[int, str, int, int]]:
    """size, split, from, to: which of the ``sizes`` (size -> components of it) each split takes, by rank.

    The largest go first, each to the split that lacks most, the alphabetically first at a tie.
    """
    lack, plan = dict(lack), []
    for n in sorted(sizes, reverse=True):
        names, count = sorted(lack), sizes[n]
        lo, hi = min(lack.values()) - n * (count + 1), max(lack.values()) + 1
        for _ in range(200):  # the level above which no more than ``count`` components fit
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if sum(max(0, int((lack[s] - mid) // n) + 1) if lack[s] >= mid else 0 for s in names) <= count else (mid, hi)
        take = {s: int((lack[s] - hi) // n) + 1 if lack[s] >= hi else 0 for s in names}
        for _ in range(count - sum(take.values())):  # ties at the level
            s = max(names, key=lambda x: lack[x] - n * take[x])
            take[s] += 1
        at = 0
        for s in names:
            if take[s]:
                plan.append((n, s, at, at + take[s]))
            at, lack[s] = at + take[s], lack[s] - n * take[s]
    return plan


def assign_splits(sessions: DataFrame, targets: DataFrame, store: SplitStore | None = None) -> DataFrame:
    """session_id, component, group_therapist, old_split, split, status.

    status is ``kept`` (its component holds one split), ``new`` (none: it fills the split that lacks
    most of its share of ``targets``) or ``quarantined`` (two or more: split is null until settled).

    The components and splits of earlier loads into the ``store`` count too, and its next version is
    written: a component keeps its split whether or not it was written back to ``sessions``, a link
    that joins components of different splits quarantines them, and they stay so in later loads.
    Without a store a new one in the shared checkpoint folder is used. Shares count the sessions of
    this load. New components are placed by size: the driver plans over the sizes that occur (their
    number is below the square root of twice the sessions), components take their places by rank.

    Defined cases: of a session exported twice the newest row counts, null dates oldest; spellings
    of ids and splits are unified, placeholders and nulls link nothing; rows without a session id
    are left out; other columns are ignored; empty tables give no rows; no target with a positive
    share leaves new components without a split.
    """
    spark = sessions.sparkSession
    store = store or SplitStore(spark, scratch(spark))
    rows, near, held, groups = _placed(sessions, store)
    groups = groups.withColumn("status", F.when(F.size("have") == 1, "kept").when(F.size("have") == 0, "new").otherwise("quarantined"))
    want = {r[0]: float(r[1]) for r in targets.select(split_name("split_name"), "target_share").dropna().collect() if r[1] > 0}
    kept = {r[0]: r[1] for r in groups.filter("status = 'kept'").groupBy(F.col("have")[0]).agg(F.sum("n")).collect()}
    fresh = groups.filter("status = 'new'").select("component", "n")
    sizes = {r[0]: r[1] for r in fresh.groupBy("n").agg(F.count("*")).collect()}
    whole = sum(n * k for n, k in sizes.items()) + sum(kept.get(s, 0) for s in want)
    scale = sum(want.values()) or 1.0
    plan = fill_plan(sizes, {s: whole * w / scale - kept.get(s, 0) for s, w in want.items()}) if want else []
    places = spark.createDataFrame(plan, "n long, filled string, lo long, hi long")
    ranked = rank_within(fresh, ["n"], [F.col("component")], F.xxhash64("component"))
    filled = ranked.join(places, "n").filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select("component", "filled")
    new = F.when(F.col("status") == "kept", F.col("have")[0]).when(F.col("status") == "new", F.col("filled")).alias("new_split")
    done = cut(groups.join(filled, "component", "left").select("component", "group_therapist", "status", "have", new))
    now = F.when(F.col("new_split").isNull(), F.col("have")).otherwise(F.array("new_split")).alias("splits")
    store.save(near, done.select("component", now), held)
    return rows.join(done, "component").select(
        F.col("session").alias("session_id"), "component", "group_therapist", F.col("split").alias("old_split"), F.col("new_split").alias("split"), "status"
    )


def split_conflicts(sessions: DataFrame, store: SplitStore | None = None) -> DataFrame:
    """Sessions of groups that now carry two or more splits: session_id, group_therapist.

    The splits that a given ``store`` holds count too; it is read, ``assign_splits`` updates it.
    Without one the groups are loaded into a new store, where those of two splits are quarantined.
    """
    own = store is None
    store = store or SplitStore(sessions.sparkSession, scratch(sessions.sparkSession))
    rows, near, held, groups = _placed(sessions, store)
    bad = groups.filter(F.size("have") > 1).select("component", "group_therapist")
    if own:
        store.save(near, groups.select("component", F.col("have").alias("splits")), held)
        bad = bad.join(store.read().filter(F.size("splits") > 1).select("component").distinct(), "component", "left_semi")
    return rows.join(bad, "component").select(F.col("session").alias("session_id"), "group_therapist")


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """Of every target, and of every other split that occurs, the sessions and their share; quarantined ones under null."""
    got = assigned.groupBy("split").agg(F.count("*").alias("sessions"))
    want = targets.select(split_name("split_name").alias("s"), "target_share")
    all_of = got.join(want, F.col("split") == F.col("s"), "full").select(F.coalesce("split", "s").alias("split"), "target_share", F.coalesce("sessions", F.lit(0)).alias("sessions"))
    whole = F.sum(F.when(F.col("split").isNotNull(), F.col("sessions"))).over(Window.partitionBy())  # a row a split
    return all_of.withColumn("whole", whole).select(
        "split", "target_share", "sessions", F.when(F.col("split").isNotNull(), F.round(F.col("sessions") / F.col("whole"), 6)).alias("share")
    )
