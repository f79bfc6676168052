"""Structured Streaming over the append-only logs: counting, admission of writes, live stages.

Batch replay is the source of truth. The streaming forms keep what can be kept without history:
counts, first-reached stages and admission by a single writer (foreachBatch).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.time import instant_micros
from ..operators.progress import ACTION_RANK, STAGE_POINTS, tap_weight
from ..session import cut, shared_folder

LATE = "2 days"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log as a stream of its files, with the schema it has on disk. `path` is a folder, or one file of a folder."""
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())


def once(stream: DataFrame, late: str = LATE) -> DataFrame:
    """Each id once, as long as a repeat arrives within `late` of the first; state is dropped after that."""
    timed = stream.withColumn("at", F.col("arrived_at").cast("timestamp")).filter("id IS NOT NULL")
    return timed.withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])


def windowed(stream: DataFrame, span: str = "1 day", late: str = LATE) -> DataFrame:
    """Actions by tumbling window of arrival, late rows beyond the watermark left to the batch replay."""
    return stream.withColumn("at", F.col("arrived_at").cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", span).alias("w"), "action").agg(F.count("*").alias("n"))


def run_available(df: DataFrame, mode: str, write) -> None:
    """Run a stream over what is there now and stop; state and offsets go to the shared folder."""
    folder = f"{shared_folder(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    q = df.writeStream.outputMode(mode).option("checkpointLocation", folder).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()


def count_actions(spark: SparkSession, path: str) -> DataFrame:
    """(action, n): distinct ids by action, through a streaming aggregation, written to the shared folder and read back.

    Repeats are taken out over the whole log here (the log's spread of arrivals exceeds any watermark),
    so the state holds one row an id and action; a live deployment uses `once` instead.
    """
    out = f"{shared_folder(spark)}/actions-{uuid.uuid4().hex}"
    ids = read_log(spark, path).filter("id IS NOT NULL").select("id", "action").dropDuplicates(["id", "action"])

    def write(batch: DataFrame, epoch: int) -> None:
        batch.groupBy("action").agg(F.count("*").alias("n")).write.mode("append").parquet(out)

    run_available(ids, "append", write)
    return spark.read.schema("action string, n long").parquet(out).groupBy("action").agg(F.sum("n").alias("n"))


# fixed values: which fields an activity may state, and with which actions
FIELDS = ["id", "ts", "actor", "action", "entity_id", "undo_of", "role", "band"]
TAPS = list(ACTION_RANK)
SIGNAL_ACTIONS = ["signal_reviewed", "signal_pinned", "signal_dismissed"]


def admit(batch: DataFrame, known: DataFrame, log: DataFrame, signals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of a batch of candidate events; rejected carries code and message.

    `known`: id, status, band of the effective registry; `log`: id, action, entity_id, undo_of already stored;
    `signals`: signal_id of those on record, for the triage actions. A batch with a column signal_id keeps it.
    400: unknown action, entity or signal, an undo of anything but a stored tap or an accepted one earlier in the
    batch, a role on anything but a meeting, an address or digits in a role. 409: id taken, entity retired, tap
    undone before, in the log or by an earlier undo of the batch. Rows of a batch are in order of (ts, id).
    An accepted tap takes the entity's own band whatever was stated, an accepted undo its tap's entity.
    """
    fields = FIELDS + (["signal_id"] if "signal_id" in batch.columns else [])
    if "signal_id" not in batch.columns:
        batch = batch.withColumn("signal_id", F.lit(None).cast("string"))
    ents = known.select(F.col("id").alias("entity_id"), F.col("status").alias("_status"), F.col("band").alias("_band"))
    undone = log.filter("action = 'undo'").select("undo_of").distinct().withColumn("_gone", F.lit(True))
    twice = log.select("id").distinct().withColumn("_twice", F.lit(True))
    signs = (signals.select("signal_id") if signals is not None else batch.select("signal_id").limit(0)).distinct().withColumn("_sign", F.lit(True))
    c = batch.join(ents, "entity_id", "left").join(twice, "id", "left").join(signs, "signal_id", "left")
    tap, triage, undo = F.col("action").isin(TAPS), F.col("action").isin(SIGNAL_ACTIONS), F.col("action") == "undo"

    def judged(rows, rules):
        verdict = F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(text).alias("message"))) for bad, code, text in rules])
        return rows.withColumn("_v", verdict)

    own = judged(c, [
        (F.coalesce("_twice", F.lit(False)), 409, "id is taken"),
        (~F.coalesce(tap | triage | undo, F.lit(False)), 400, "unknown action"),
        (tap & F.col("_status").isNull(), 400, "unknown entity"),
        (tap & (F.col("_status") != "active"), 409, "entity is not active"),
        (triage & F.col("_sign").isNull(), 400, "unknown signal"),
        (F.col("role").isNotNull() & (F.col("action") != "met"), 400, "role only with a meeting"),
        (F.col("role").rlike("[@0-9]"), 400, "role holds an address or number"),
    ])
    # undos are judged once the batch's taps are
    when = F.struct("ts", "id")
    of = F.col("entity_id") if "entity_id" in log.columns else F.lit(None).cast("string")
    stored = log.filter(tap).select(F.col("id").alias("undo_of"), of.alias("_of"), F.lit(None).cast(own.select(when.alias("x")).schema["x"].dataType).alias("_at"))
    fresh = own.filter(tap & F.col("_v").isNull()).select(F.col("id").alias("undo_of"), F.col("entity_id").alias("_of"), when.alias("_at"))
    targets = stored.unionByName(fresh).groupBy("undo_of").agg(F.min("_of").alias("_of"), F.min("_at").alias("_at"), F.lit(True).alias("_there"))
    undos = own.filter(undo & F.col("_v").isNull()).join(targets, "undo_of", "left").join(undone, "undo_of", "left")
    there = F.col("_there") & F.coalesce(F.col("_at") < when, F.lit(True))
    first = undos.filter(there & F.col("_gone").isNull()).groupBy("undo_of").agg(F.min(when).alias("_first"))
    undos = judged(undos.join(first, "undo_of", "left"), [
        (~F.coalesce(there, F.lit(False)), 400, "nothing to undo"),
        (F.coalesce("_gone", F.lit(False)) | (F.col("_first") < when), 409, "already undone"),
    ])
    rest = own.filter(~F.coalesce(undo, F.lit(False)) | F.col("_v").isNotNull())
    ok = rest.filter("_v IS NULL").withColumn("band", F.when(tap, F.col("_band"))).select(fields)
    ok = ok.unionByName(undos.filter("_v IS NULL").withColumn("entity_id", F.col("_of")).withColumn("band", F.lit(None).cast("string")).select(fields))
    bad = lambda d: d.filter("_v IS NOT NULL").select(*fields, "_v.code", "_v.message")
    return ok, bad(rest).unionByName(bad(undos))


def admission_stream(candidates: DataFrame, known, log_path: str, rejected_path: str, checkpoint: str, signals=None):
    """One writer: each batch is judged against the stored log, then appended. `known` is a function giving the registry, `signals` one giving the signals."""
    spark = candidates.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        log = spark.read.schema(batch.schema).parquet(log_path)
        # both verdicts are fixed before the log changes; a batch that is run again finds its ids taken
        ok, bad = (cut(x) for x in admit(batch.dropDuplicates(["id"]), known(), log, signals() if signals else None))
        bad.write.mode("append").parquet(rejected_path)
        ok.write.mode("append").parquet(log_path)

    return candidates.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def admit_changes(batch: DataFrame, ledger: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of candidate ledger changes: five kinds only, rules of the ledger, and no loop of duplicates; rejected has code (400) and message.

    The trial applies ledger and candidates together; a candidate whose entity would then lead into a loop is refused.
    Columns as in operators.ledger.
    """
    from ..operators import ledger as L

    allowed = ["mark_defunct", "mark_not_a_fit", "mark_assigned_elsewhere", "mark_duplicate", "reinstate"]
    both = ledger.unionByName(batch)
    wrong = L.violations(both, known).groupBy("change_id").agg(F.min("problem").alias("message"))
    loops = L.duplicate_chains(L.latest_status(both)).filter("looped").select(F.col("id").alias("entity_id"), F.lit("leads into a loop").alias("_loop"))
    j = batch.join(wrong, "change_id", "left").join(loops, "entity_id", "left")
    message = F.coalesce(F.when(~F.col("change").isin(allowed), "kind not allowed"), F.col("message"), F.when(F.col("change") == "mark_duplicate", F.col("_loop")))
    judged = j.withColumn("_m", message)
    return judged.filter("_m IS NULL").select(batch.columns), judged.filter("_m IS NOT NULL").select(*batch.columns, F.lit(400).alias("code"), F.col("_m").alias("message"))


class StageKeeper(StatefulProcessor):
    """Keeps the highest stage of an entity and what it earned, and emits each rise with its points."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rank = handle.getValueState("rank", "rank int, earned long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        taps = pd.concat(list(rows)).sort_values(["instant", "id"])
        held, earned = self.rank.get() if self.rank.exists() else (0, 0)
        out = []
        for t in taps.itertuples():
            if t.rank > held:
                points = sum(STAGE_POINTS[held + 1 : int(t.rank) + 1]) * int(t.weight)
                earned += points
                out.append((key[0], t.id, held, int(t.rank), points, earned))
                held = int(t.rank)
        self.rank.update((held, earned))
        columns = {"entity_id": "object", "tap_id": "object", "old_rank": "int32", "new_rank": "int32", "points": "int64", "earned": "int64"}
        yield pd.DataFrame(out, columns=list(columns)).astype(columns)

    def close(self) -> None:
        pass


def live_stages(stream: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(entity_id, tap_id, old_rank, new_rank, points, earned) as taps arrive; undo and late taps are for the batch replay.

    `known`: id, kind, base_band of the entries, joined as they are when a batch runs; taps on others are left out. Without it
    every tap weighs one. Keyed state needs the RocksDB provider: spark.sql.streaming.stateStore.providerClass.
    """
    rank = F.try_element_at(F.create_map(*[F.lit(x) for kv in ACTION_RANK.items() for x in kv]), F.col("action"))
    t = stream.withColumn("rank", rank.cast("int")).withColumn("instant", instant_micros("ts")).filter("rank IS NOT NULL AND entity_id IS NOT NULL AND instant IS NOT NULL")
    t = t.withColumn("weight", F.lit(1))
    if known is not None:
        t = t.join(known.select(F.col("id").alias("entity_id"), "kind", "base_band").dropDuplicates(["entity_id"]), "entity_id").withColumn("weight", tap_weight("band", "kind", "base_band"))
    keyed = t.select("entity_id", "id", "rank", "instant", "weight").groupBy("entity_id")
    return keyed.transformWithStateInPandas(StageKeeper(), "entity_id string, tap_id string, old_rank int, new_rank int, points long, earned long", "Append", "None")


def keep_late(stream: DataFrame, log_path: str, late_path: str, checkpoint: str, hours: int = 48):
    """Every row into the log; those that arrive more than `hours` behind the newest stored one also into a folder of late rows.

    Windows and live stages have passed such rows by; what they touch is taken from the batch replay. A batch that is run
    again adds no id twice to either folder.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        log = spark.read.schema(batch.schema).parquet(log_path)
        newest = log.agg(F.max("arrived_at").alias("_high"))  # one row
        fresh = cut(batch.dropDuplicates(["id"]).join(log.select("id"), "id", "left_anti").crossJoin(F.broadcast(newest)))
        late = fresh.filter(F.col("arrived_at") < F.col("_high") - F.expr(f"INTERVAL {hours} HOURS"))
        late.drop("_high").write.mode("append").parquet(late_path)
        fresh.drop("_high").write.mode("append").parquet(log_path)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
