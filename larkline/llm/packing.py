"""Filling fixed-capacity containers with texts, none split unless it exceeds the capacity.

Planning runs over the length histogram, not over documents: best-fit decreasing
places counts of equal items into classes of equal containers. Documents then
take the planned slots by their rank among the items of their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkline.core import cut
from larkline.llm.ranks import rank_within
from larkline.llm.tokens import VOCABULARY, token_lengths


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Classes of equal containers (how many, [(length, items of it in each)]) that hold all items.

    Work and result depend on the distinct lengths, at most ``capacity``, not on the items.
    """
    spare: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []
    done: list[tuple[int, tuple]] = []

    def put(room: int, n: int, chain: tuple) -> None:
        if not room:
            done.append((n, chain))
            return
        if room not in spare:
            spare[room] = []
            insort(rooms, room)
        spare[room].append((n, chain))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        if not 0 < length <= capacity:
            raise ValueError("lengths must lie within the capacity")
        while n:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                have, chain = spare[room].pop()
                if not spare[room]:
                    del spare[room], rooms[i]
            else:
                room, have, chain = capacity, -(-n // (capacity // length)), ()
            each = room // length
            full = min(have, n // each)
            if full:
                put(room - each * length, full, (length, each, chain))
                n -= full * each
            left = have - full
            if left and n and n < each:
                put(room - n * length, 1, (length, n, chain))
                n, left = 0, left - 1
            if left:
                put(room, left, chain)
    done += [x for room in rooms for x in spare[room]]
    out = []
    for n, chain in done:
        items = []
        while chain:
            items.append(chain[:2])
            chain = chain[2]
        out.append((n, items))
    return out


def _slots(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """Per length: rows (first rank, containers of the class, first container), by first rank."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for n, items in plan:
        for length, each in items:
            rows.setdefault(length, []).append((used.get(length, 0), n, first))
            used[length] = used.get(length, 0) + n * each
        first += n
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack_documents(
    documents: DataFrame, limits: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, lengths: DataFrame | None = None
) -> DataFrame:
    """Place every text in a container of each capacity.

    Result: limit_name, container, ``id_col``, piece, start_token, tokens. Texts within the capacity
    are one piece; longer ones are cut into full containers and a rest that is packed like a text.
    ``lengths`` (``id_col``, tokens) may stand for ``documents``.

    Defined cases: null and empty texts hold no tokens and need no place, so they are left out;
    limits of null, zero or fewer tokens are left out; ids may repeat, each row is placed; equal
    lengths are ranked by a hash of the id, equal ids in any order; other columns are ignored; an
    empty table gives no rows. ``limits`` is a handful of rows; what the driver gets is the length
    histogram, at most ``capacity`` rows a limit.
    """
    if lengths is None:
        lengths = cut(token_lengths(documents, [id_col], text, vocabulary))
    caps = {r[0]: r[1] for r in limits.filter("capacity_tokens > 0").select("limit_name", "capacity_tokens").distinct().collect()}
    each = F.array(*[F.struct(F.lit(k).alias("limit_name"), F.lit(v).alias("capacity")) for k, v in sorted(caps.items())])
    items = lengths.filter("tokens > 0").select(F.col(id_col).alias("id"), "tokens", F.inline(each))
    items = items.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("tokens") / F.col("capacity")).cast("int") - 1)))
    items = items.select(
        "limit_name", "id", "piece", (F.col("piece") * F.col("capacity")).alias("start_token"),
        F.least("capacity", F.col("tokens") - F.col("piece") * F.col("capacity")).alias("tokens"),
    )
    counts: dict[str, dict[int, int]] = {k: {} for k in caps}
    for r in items.groupBy("limit_name", "tokens").count().collect():
        counts[r[0]][r[1]] = r[2]
    slots = {k: _slots(plan_best_fit(c, caps[k])) for k, c in counts.items()}
    shared = documents.sparkSession.sparkContext.broadcast(slots)
    mix = F.xxhash64("id", "piece")
    ranked = rank_within(items, ["limit_name", "tokens"], [mix, F.col("id"), F.col("piece")], mix, "rank")
    kind = dict(items.dtypes)["id"]

    def place(batches):
        for b in batches:
            rank, size = b.column("rank").to_numpy(), b.column("tokens").to_numpy()
            name = b.column("limit_name").to_pylist()
            out = np.empty(b.num_rows, np.int64)
            for i in range(b.num_rows):
                rows = shared.value[name[i]][int(size[i])]
                start, n, first = rows[np.searchsorted(rows[:, 0], rank[i], "right") - 1]
                out[i] = first + (rank[i] - start) % n
            cols = [b.column("limit_name"), pa.array(out), b.column("id"), b.column("piece"), b.column("start_token"), b.column("tokens")]
            yield pa.RecordBatch.from_arrays(cols, names=["limit_name", "container", "id", "piece", "start_token", "tokens"])

    schema = f"limit_name string, container long, id {kind}, piece int, start_token int, tokens int"
    return ranked.mapInArrow(place, schema).withColumnRenamed("id", id_col)


def packing_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """Per limit: containers, tokens, the least number of containers possible, and the share filled."""
    per = packed.groupBy("limit_name", "container").agg(F.sum("tokens").alias("t"), F.count("*").alias("items"))
    got = per.groupBy("limit_name").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.sum("items").alias("items"), F.max("t").alias("fullest"))
    caps = limits.select("limit_name", "capacity_tokens").distinct()
    return got.join(caps, "limit_name").select(
        "limit_name", "capacity_tokens", "containers", "items", "tokens", "fullest",
        F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"),
        F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill"),
    )



