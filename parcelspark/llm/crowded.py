"""Common windows around one anchor that has very many different contexts, without gathering them."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# what a crowded group is passed on as: contexts to the left (reversed by unit) and to the right of the anchor
CONTEXTS = "key long, doc_id long, text_key long, at int, left binary, right binary"
NEAREST = "doc_id long, text_key long, at int, common int, shared boolean, partner long, part int, last boolean, key long, left binary, right binary"


PLACE = ["key", "doc_id", "text_key", "at"]
BLOCK = 4  # windows of so many neighbouring places are ruled out by what they all have in common


def _matched(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both that stand at the same place; a null id equals a null id."""
    other = b.withColumnsRenamed({c: f"_{c}" for c in PLACE})
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    for c in ("key", "text_key", "at"):
        same = same & (F.col(c) == F.col(f"_{c}"))
    return a.join(other, same).drop(*[f"_{c}" for c in PLACE])


def common_units(a: bytes, b: bytes, unit: int) -> int:
    """Length of the common prefix in units, by halving on byte comparisons."""
    low, high = 0, min(len(a), len(b)) // unit
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid * unit] == b[:mid * unit]:
            low = mid
        else:
            high = mid - 1
    return low


def _met(one, two, side: str, size: int, unit: int, across: bool) -> tuple[int, bool]:
    """(common extension on the sorted side, whether both sides make up a window) of two rows (doc_id, left, right)."""
    ahead = common_units(one[2], two[2], unit)
    back = common_units(one[1], two[1], unit)
    return (back if side == "left" else ahead), back + ahead >= size and not (across and one[0] == two[0])


def _neighbours(side: str, size: int, unit: int, across: bool):
    """Stream over rows sorted by key and one side's context: each with its best neighbour; the ends of the partition keep their contexts."""

    def kernel(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        before = None  # [row, best common, shared, partner]
        first = True

        def out(entries):
            columns: list[list] = [[] for _ in range(11)]
            for (row, common, shared, partner), end in entries:
                key, doc_id, text_key, at, left, right = row
                edge = end is not None
                for c, v in zip(columns, (
                        doc_id, text_key, at, common, shared, partner, part if edge else None, end, key,
                        left if edge else None, right if edge else None), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "text_key", "at", "common", "shared", "partner", "part", "last", "key", "left", "right"])

        for batch in batches:
            entries = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = [row, 0, False, None]
                if before is not None:
                    if before[0][0] == row[0]:
                        a, b = before[0], row
                        common, shared = _met((a[1], a[4], a[5]), (b[1], b[4], b[5]), side, size, unit, across)
                        for entry, other in ((before, b[1]), (now, a[1])):
                            if (common, shared) > (entry[1], entry[2]):
                                entry[1:] = [common, shared, other]
                    entries.append((before, False if first else None))
                    first = False
                before = now
            if entries:
                yield out(entries)
        if before is not None:
            yield out([(before, False)] if first else [])
            yield out([(before, True)])

    return kernel


def _best(contexts: DataFrame, side: str, size: int, unit: int, across: bool) -> DataFrame:
    """The place of each row with the common extension, whether a window is shared, and the partner: the best neighbour of each row in the order of one side, over all partitions."""
    spark = contexts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = stored(
        contexts.repartitionByRange(n, "key", side).sortWithinPartitions("key", side)
        .mapInArrow(_neighbours(side, size, unit, across), NEAREST), f"nearest-{side}")
    # two rows per partition, whatever the data: pairs across a border are compared here
    ends = sorted(near.where("part IS NOT NULL").collect(), key=lambda r: (r["part"], r["last"]))
    mended = []
    for a, b in zip(ends, ends[1:], strict=False):
        if a["part"] != b["part"] and a["key"] == b["key"]:
            common, shared = _met((a["doc_id"], a["left"], a["right"]), (b["doc_id"], b["left"], b["right"]), side, size, unit, across)
            mended += [(r["key"], r["doc_id"], r["text_key"], r["at"], common, shared, o["doc_id"]) for r, o in ((a, b), (b, a))]
    patch = spark.createDataFrame(mended, "key long, doc_id long, text_key long, at int, common int, shared boolean, partner long")
    return near.select(*patch.columns).unionByName(patch).groupBy(*PLACE).agg(
        F.max(F.struct("common", "shared", "partner")).alias("best")).select(
        *PLACE, F.col("best.common").alias(f"{side}_common"), F.col("best.shared").alias(f"{side}_shared"),
        F.col("best.partner").alias(f"{side}_partner"))


def _in_order(left: bytes, unit: int) -> bytes:
    """The units of a left context from the farthest to the nearest."""
    return left[::-1] if unit == 1 else b"".join(left[i - unit:i] for i in range(len(left), 0, -unit))


def _block_cores(size: int, unit: int):
    """A digest of what all windows of a block of asked places have in common, for each such block of a row."""
    def kernel(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for key, doc_id, text_key, at, left, right, asked, unsettled in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, before = _in_order(left, unit) + right, len(left) // unit
                for block in sorted({w // BLOCK for w in asked}):
                    begin = (before - block * BLOCK) * unit
                    core = text[max(0, begin):max(0, begin + (size - BLOCK + 1) * unit)] if size >= BLOCK else b""
                    digest = xxh3_128_digest(key.to_bytes(8, "little", signed=True) + block.to_bytes(4, "little") + core)
                    for c, v in zip(out, (key, doc_id, text_key, at, block, digest, unsettled), strict=True):
                        c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [*PLACE, "block", "core", "unsettled"])

    return kernel


def _possible(fitting: DataFrame, size: int, unit: int) -> DataFrame:
    """``fitting`` with the asked places only of blocks whose core an unsettled row and another row share, and these ``blocks`` (block, core).

    Rows that differ in the core differ in every window of the block, so no window an unsettled row shares is lost.
    """
    cores = stored(
        fitting.where(F.size("asked") > 0).select(*PLACE, "left", "right", "asked", "unsettled").mapInArrow(
            _block_cores(size, unit), "key long, doc_id long, text_key long, at int, block int, core binary, unsettled boolean"), "asked-cores")
    met = cores.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.max("unsettled").alias("open")).where("n > 1 AND open").select("core")
    blocks = cores.join(met, "core").groupBy(*PLACE).agg(F.collect_set(F.struct("block", "core")).alias("blocks"))
    return _matched(fitting, blocks).withColumn("asked", _of_blocks(F.col("blocks.block")))


def _of_blocks(blocks: Column) -> Column:
    return F.filter("asked", lambda w: F.array_contains(blocks, F.floor(w / BLOCK).cast("int")))


def _windows(fitting: DataFrame, size: int, unit: int, name: str) -> DataFrame:
    return stored(fitting.where(F.size("asked") > 0).select(*PLACE, "left", "right", "asked", "unsettled").mapInArrow(
        _asked_windows(size, unit), "doc_id long, text_key long, at int, w int, window binary, key long, unsettled boolean"), name)


def _outermost(possible: DataFrame, size: int, unit: int) -> list[DataFrame]:
    """How far each unsettled row of ``possible`` is covered by shared windows: its place, least and most w, and a partner, in one frame a round.

    All windows of a row hold its anchor, so its lowest and highest shared place are enough. A round asks the outermost
    blocks of each open end, twice as many as the round before, of all rows that have the same core there, so that a
    block is decided at once. What lies between shared places of a row is not asked any more.
    """
    rows = stored(possible, "possible-contexts")
    live = rows.select(*PLACE, F.col("unsettled").alias("wanted"), "low_open", "high_open", F.inline("blocks"))
    frames: list[DataFrame] = []
    own = Window.partitionBy(*PLACE)
    while True:
        number = len(frames)
        ends = live.where("wanted").select(
            "core", "low_open", "high_open", F.row_number().over(own.orderBy("block")).alias("up"),
            F.row_number().over(own.orderBy(F.desc("block"))).alias("down"))
        chosen = stored(ends.where(
            (F.col("low_open") & (F.col("up") <= 1 << number)) | (F.col("high_open") & (F.col("down") <= 1 << number))
        ).select("core").distinct(), f"chosen-cores-{number}")
        if chosen.isEmpty():
            return frames
        blocks = live.join(chosen, "core").groupBy(*PLACE).agg(F.collect_set("block").alias("now"))
        asked = _matched(rows, blocks).withColumn("asked", _of_blocks(F.col("now")))
        windows = _windows(asked, size, unit, f"asked-windows-{number}" if number else "asked-windows")
        shared = stored(windows.where("unsettled").join(_often(windows, False), "window").groupBy(*PLACE).agg(
            F.min("w").alias("least"), F.max("w").alias("most"), F.max(_other()).alias("partner")), f"shared-places-{number}")
        frames.append(shared)
        left = live.join(chosen, "core", "left_anti")
        named = shared.drop("partner").withColumnsRenamed({c: f"_{c}" for c in PLACE})
        same = F.col("doc_id").eqNullSafe(F.col("_doc_id"))
        for c in ("key", "text_key", "at"):
            same = same & (F.col(c) == F.col(f"_{c}"))
        outside = F.col("least").isNull() | (F.col("low_open") & (F.col("block") < F.floor(F.col("least") / BLOCK))) | (
            F.col("high_open") & (F.col("block") > F.floor(F.col("most") / BLOCK)))
        left = left.join(named, same, "left").withColumn("wanted", F.col("wanted") & outside).select(*live.columns)
        open_cores = left.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.max("wanted").alias("open")).where("n > 1 AND open").select("core")
        live = stored(left.join(open_cores, "core", "left_semi"), f"live-cores-{number}")


def _other() -> Column:
    return F.when(F.col("doc_id") == F.col("low_doc"), F.col("high_doc")).otherwise(F.col("low_doc"))


def _often(windows: DataFrame, across: bool) -> DataFrame:
    return windows.groupBy("window").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low_doc"), F.max("doc_id").alias("high_doc")).where(
        F.col("low_doc") != F.col("high_doc") if across else F.col("n") > 1)


def _asked_windows(size: int, unit: int):
    def kernel(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for key, doc_id, text_key, at, left, right, asked, unsettled in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, before = _in_order(left, unit) + right, len(left) // unit
                for w in asked:
                    begin = (before - w) * unit
                    if begin >= 0 and begin + size * unit <= len(text):
                        digest = xxh3_128_digest(key.to_bytes(8, "little", signed=True) + w.to_bytes(4, "little") + text[begin:begin + size * unit])
                        for c, v in zip(out, (doc_id, text_key, at, w, digest, key, unsettled), strict=True):
                            c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "text_key", "at", "w", "window", "key", "unsettled"])

    return kernel


def crowded_intervals(contexts: DataFrame, size: int, unit: int = 1, across: bool = False) -> DataFrame:
    """doc_id, text_key, start, end, partner: what is covered by windows of ``size`` units that occur at another anchor of the same key.

    A window begins w units before its anchor. It needs a partner with w units in common to the
    left and size - w to the right, so w lies between size less the best common extension to the
    right and the best to the left. Both come from the neighbours in two sorted orders, which are
    range partitioned. Where the best neighbour itself shares a window, that end is settled; for
    the few other rows, their open w are asked of the rows of the same key, and only those
    windows are counted by digest, of rows that share the middle of such a window with one of the few, from the ends
    inwards. ``across``: the partner must be another document; all open windows are counted then, as each may be a link.
    """
    best = _matched(_best(contexts, "left", size, unit, across), _best(contexts, "right", size, unit, across))
    # equal rows (the same text twice) have the same contexts: one stands for them
    rows = contexts.groupBy(*PLACE).agg(F.first("left").alias("left"), F.first("right").alias("right"))
    low = F.greatest(F.lit(0), F.lit(size) - F.col("right_common"))
    judged = stored(
        best.select("*", low.alias("low"), F.col("left_common").alias("high")).where("low <= high"), "judged-contexts")
    sure = judged.where("left_shared AND right_shared").select(
        "doc_id", "text_key", (F.col("at") - F.col("high")).alias("start"), (F.col("at") + size - F.col("low")).alias("end"), F.col("left_partner").alias("partner"))
    # settled ends of the others
    one_end = judged.where("left_shared <> right_shared").select(
        "doc_id", "text_key", F.when(F.col("left_shared"), F.col("at") - F.col("high")).otherwise(F.col("at") - F.col("low")).alias("start"),
        F.coalesce("left_partner", "right_partner").alias("partner")).select("doc_id", "text_key", "start", (F.col("start") + size).alias("end"), "partner")
    # the open places of a key as spans, one for each low end, so that no row is repeated for each of its places
    spans = judged.where("NOT (left_shared AND right_shared)").groupBy("key", "low").agg(F.max("high").alias("high")).groupBy("key").agg(
        F.collect_list(F.struct("low", "high")).alias("_spans"))  # at most size + 1 spans a key
    asked = spans.select("key", F.filter(F.sequence(F.lit(0), F.lit(size)), lambda w: F.exists(
        "_spans", lambda s: (w >= s["low"]) & (w <= s["high"]))).alias("asked"))
    fitting = _matched(rows.join(asked, "key"), judged.select(
        *PLACE, "low", "high", (~(F.col("left_shared") & F.col("right_shared"))).alias("unsettled"),
        (~F.col("right_shared")).alias("low_open"), (~F.col("left_shared")).alias("high_open"))).select(
        *PLACE, "left", "right", F.filter("asked", lambda w: (w >= F.col("low")) & (w <= F.col("high"))).alias("asked"),
        "unsettled", "low_open", "high_open")
    if not across:  # settled rows are covered already; across documents their partners are links as well
        fitting = _possible(fitting, size, unit)
    if "blocks" in fitting.columns:
        # every window of a row holds its anchor, so they cover what lies from the first one to the last
        counted = [f.select(
            "doc_id", "text_key", (F.col("at") - F.col("most")).alias("start"), (F.col("at") - F.col("least") + size).alias("end"), "partner")
            for f in _outermost(fitting, size, unit)]
    else:
        windows = _windows(fitting, size, unit, "asked-windows")
        counted = [windows.join(_often(windows, across), "window").select(
            "doc_id", "text_key", (F.col("at") - F.col("w")).alias("start"), (F.col("at") - F.col("w") + size).alias("end"), _other().alias("partner"))]
    return reduce(DataFrame.unionByName, counted, sure.unionByName(one_end))
