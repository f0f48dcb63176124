"""Landing of requests: arrival windows, dense numbers, idempotent batches.

Each micro-batch is committed by one entry in the landing's log, keyed by query and batch id: staged files, the numbers they use, the window,
and the de-duplication ledger's new rows become visible together, and a replayed batch finds its entry and does nothing. Windows are of
arrival time: one opens with the first batch after the last one is over, gets the next number, and is never aligned or reused.
Late rows go where they arrive; nothing is dropped by event time here.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions.ids import dedup_key
from tidewright.functions.naming import partition_id, resolved_tenant, tenant_is_valid
from tidewright.functions.otlp import flatten_logs, parse_request
from tidewright.operators.dedup import evict_beyond, split_known
from tidewright.operators.ranges import covered
from tidewright.operators.skew import lookup_join
from tidewright.operators.upkeep import content_bytes
from tidewright.plans.transforms import checked
from tidewright.session import Scratch
from tidewright.sources.commitlog import LakeLog
from tidewright.types import APPLIED, SYSTEM_COLUMNS, InvalidInput, Overloaded, PayloadTooLarge, check_payload

LEDGER = T.StructType([T.StructField("tenant", T.StringType()), T.StructField("dedup_key", T.StringType()), T.StructField("outcome", T.StringType()), T.StructField("created_ms", T.LongType())])
#: Fixed values, default limits: bytes of a request, time to live and rows per tenant of the ledger, length of a window.
MAX_PAYLOAD, TTL_MS, LEDGER_ROWS, WINDOW_MS = 4 * 2**20, 24 * 3_600_000, 100_000, 60_000

#: Rows of a partition are numbered within so many blocks, one after the other.
BLOCKS = 256
#: After so many parts the ledger is rewritten without what it may forget.
LEDGER_PARTS = 16
#: Outcomes of dropping a window.
DROPPED, RESIDUE_KEPT, ALREADY_GONE = "dropped", "residue_kept", "already_gone"


class Landing:
    """The staging area of one dataset on one node (``origin``)."""

    def __init__(self, spark: SparkSession, path: str, origin: str, *, window_ms: int = WINDOW_MS, ttl_ms: int = TTL_MS, ledger_rows: int = LEDGER_ROWS, max_payload: int = MAX_PAYLOAD, capacity: int | None = None, transform: str | None = None):
        self.spark, self.path, self.origin = spark, path.rstrip("/"), origin
        self.window_ms, self.ttl_ms, self.ledger_rows, self.max_payload = window_ms, ttl_ms, ledger_rows, max_payload
        self.capacity, self.transform = capacity, transform
        self.log = LakeLog(spark, f"{self.path}/landing")

    # state: the fold of the batches

    def _batches(self) -> list[dict]:
        return sorted((b for k, b in self.log.state().batches.items() if b["order"] >= 0), key=lambda b: b["order"])

    def high_waters(self) -> dict[str, int]:
        """The greatest number given per partition."""
        out: dict[str, int] = {}
        for b in self._batches():
            out.update(b["applied"])
        return out

    def window(self, now_ms: int) -> tuple[int, int]:
        """The window that a row arriving now belongs to: its number and when it opened."""
        batches = self._batches()
        if not batches:
            return 0, now_ms
        last = batches[-1]
        if now_ms - last["opened_ms"] < self.window_ms:
            return last["window_id"], last["opened_ms"]
        return last["window_id"] + 1, now_ms

    def closed_windows(self, now_ms: int) -> list[dict]:
        """Windows that take no more rows, by a newer one or by time: window_id, closed_ms (in the log, so a restart doesn't move it)."""
        opened = {b["window_id"]: b["opened_ms"] for b in self._batches()}
        newest = max(opened, default=-1)
        return [{"window_id": w, "closed_ms": at + self.window_ms} for w, at in sorted(opened.items()) if w < newest or now_ms >= at + self.window_ms]

    def ledger(self) -> DataFrame:
        return self._ledger(self._ledger_parts())

    def _ledger_parts(self) -> list[str]:
        parts: list[str] = []
        for b in self._batches():
            if b["ledger"]:
                parts = [b["ledger"]] if b.get("ledger_whole") else [*parts, b["ledger"]]
        return parts

    def _ledger(self, parts: list[str]) -> DataFrame:
        files = [f"{self.path}/{p}" for p in parts]
        return self.spark.read.schema(LEDGER).parquet(*files) if files else self.spark.createDataFrame([], LEDGER)

    def _live(self) -> list[dict]:
        """Batches and residues whose rows are landed and not dropped."""
        batches = self.log.state().batches
        gone = set(batches.get("dropped", {}).get("staged", []))
        return [b for k, b in batches.items() if k != "dropped" and b["staged"] and b["staged"] not in gone]

    def rows(self, windows: list[int] | None = None) -> DataFrame | None:
        """Landed rows not yet dropped, of the given windows; None before the first row."""
        files = sorted(f"{self.path}/{b['staged']}" for b in self._live() if windows is None or b["window_id"] in windows)
        return self.spark.read.parquet(*files) if files else None

    def staged_bytes(self) -> int:
        """Content bytes of the rows that are landed and not dropped, as the log's entries say."""
        return sum(b["bytes"] for b in self._live())

    def applied(self) -> DataFrame:
        return self.spark.createDataFrame([(p, self.origin, n) for p, n in sorted(self.high_waters().items())], APPLIED)

    # landing

    def stage(self, requests: DataFrame, query: str, batch_id: int, now_ms: int | None = None) -> dict:
        """Land one micro-batch of requests (tenant, token, request as JSON text); idempotent per (query, batch_id).

        Raises Overloaded while the landed bytes reach the capacity, InvalidInput for an invalid tenant or a request that is no JSON, PayloadTooLarge beyond the cap; then nothing is landed. Repeated requests
        (same tenant and token, or content) within the batch or the ledger's time to live are counted as duplicates.
        """
        identity = f"{query}/{batch_id}"
        now_ms = int(time.time() * 1000) if now_ms is None else now_ms
        while True:
            state = self.log.state()
            if identity in state.batches:
                return state.batches[identity]
            if self.capacity is not None and self.staged_bytes() >= self.capacity:
                raise Overloaded(f"{self.capacity} bytes are staged")
            with Scratch(requests.sparkSession) as scratch:
                entry = self._prepare(requests, identity, now_ms, scratch)
            if self.log.append(state.version, [entry]):
                return entry

    def _prepare(self, requests: DataFrame, identity: str, now_ms: int, scratch: Scratch) -> dict:
        sent = requests.select(resolved_tenant(F.col("tenant")).alias("tenant"), dedup_key(F.col("token"), F.col("request")).alias("dedup_key"), "request")
        checks = {"__tw_id": F.monotonically_increasing_id(), "__tw_malformed": parse_request(F.col("request")).isNull(), "__tw_bytes": F.octet_length("request")}
        sent = scratch.table(sent.withColumns(checks), "requests")
        bad = sent.agg(F.count_if(~tenant_is_valid(F.col("tenant"))), F.count_if("__tw_malformed"), F.count_if(F.col("__tw_bytes") > self.max_payload), F.count("*")).first()
        if bad[0] or bad[1]:
            raise InvalidInput(f"{bad[0]} invalid tenants, {bad[1]} malformed requests")
        if bad[2]:
            raise PayloadTooLarge(f"{bad[2]} requests of more than {self.max_payload} bytes")
        # what is fresh is decided by keys; no request's text is moved but those of a key that was sent more than once, of which the least is landed
        one = sent.groupBy("tenant", "dedup_key").agg(F.count(F.lit(1)).alias("__tw_n"), F.min("__tw_id").alias("__tw_id"))
        fresh, _ = split_known(one, self.ledger(), now_ms, self.ttl_ms)
        fresh = scratch.table(fresh, "keys")
        n_fresh, repeated = fresh.agg(F.count(F.lit(1)), F.count_if(F.col("__tw_n") > 1)).first()
        landed = fresh.select("__tw_id")
        if repeated:
            texts = lookup_join(sent.select("tenant", "dedup_key", "request", "__tw_id"), fresh.where("__tw_n > 1").select("tenant", "dedup_key"), ["tenant", "dedup_key"], ["__tw_id"], "inner")
            least = texts.groupBy("tenant", "dedup_key").agg(F.min(F.struct("request", "__tw_id")).alias("__tw_least"))
            landed = scratch.table(fresh.where("__tw_n = 1").select("__tw_id").unionAll(least.select("__tw_least.__tw_id")), "landed")
        window_id, opened = self.window(now_ms)
        taken = lookup_join(sent.select("tenant", "dedup_key", "request", "__tw_id"), landed, ["__tw_id"], ["__tw_id"], "inner")
        rows = flatten_logs(taken.select("tenant", "dedup_key", parse_request(F.col("request")).alias("request")), keep=["tenant", "dedup_key"])
        # blocks by content, so that a retried task numbers alike; rows equal in every column are interchangeable
        block = F.pmod(F.xxhash64(*rows.columns), F.lit(BLOCKS)).cast("int")
        rows = scratch.table(rows.withColumns({"partition": partition_id(F.col("tenant"), F.lit(0)), "__tw_block": block}), "flat")
        scratch.free("requests")
        counts = rows.groupBy("partition", "__tw_block").agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("partition").orderBy("__tw_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        marks = self.spark.createDataFrame(sorted(self.high_waters().items()), "partition string, base bigint")
        bases = counts.join(marks, "partition", "left").select("partition", "__tw_block", (F.coalesce("base", F.lit(0)) + before).alias("__tw_base"))
        # no partition is sorted as a whole: a block is, and its first number follows from the blocks before it
        payload = [c for c in rows.columns if c not in ("tenant", "partition", "dedup_key", "__tw_block")]
        order = Window.partitionBy("partition", "__tw_block").orderBy("dedup_key", *payload)
        based = lookup_join(rows, scratch.table(bases, "bases"), ["partition", "__tw_block"], payload)
        numbered = based.withColumn("seq", (F.col("__tw_base") + F.row_number().over(order)).cast("bigint"))
        out = numbered.select("tenant", "partition", F.lit(window_id).cast("bigint").alias("window_id"), F.lit(self.origin).alias("origin"), "seq", *payload)
        name = identity.replace("/", "-")
        staged, ledger = f"staged-{name}-{now_ms}", f"ledger-{name}-{now_ms}"
        out = checked(out, self.transform, ["partition", "window_id", "origin", "seq"])
        check_payload(T.StructType([f for f in out.schema.fields if f.name not in SYSTEM_COLUMNS]))
        out.write.mode("overwrite").parquet(f"{self.path}/{staged}")
        scratch.free("flat", "bases")
        known = fresh.select("tenant", "dedup_key", F.lit(identity).alias("outcome"), F.lit(now_ms).cast("bigint").alias("created_ms"))
        whole = len(self._ledger_parts()) >= LEDGER_PARTS
        (self.compact_ledger(now_ms).unionByName(known) if whole else known).write.mode("overwrite").parquet(f"{self.path}/{ledger}")
        kept = self.spark.read.parquet(f"{self.path}/{staged}")
        tops = kept.groupBy("partition").agg(F.max("seq").alias("n"), F.count("*").alias("rows"), F.sum(content_bytes(kept.schema)).alias("bytes")).collect()  # one row per partition of the batch
        return {
            "do": "batch", "id": identity, "order": len(self._batches()), "window_id": window_id, "opened_ms": opened, "staged": staged if tops else None, "ledger": ledger if n_fresh or whole else None, "ledger_whole": whole,
            "applied": {r["partition"]: r["n"] for r in tops}, "rows": sum(r["rows"] for r in tops), "bytes": sum(r["bytes"] for r in tops), "duplicates": bad[3] - n_fresh,
        }

    def compact_ledger(self, now_ms: int) -> DataFrame:
        """What the ledger must remember: rows within the time to live, the newest per tenant up to the cap."""
        return evict_beyond(self.ledger().where(F.col("created_ms") >= now_ms - self.ttl_ms), self.ledger_rows)

    def drop(self, windows: list[int]) -> None:
        """Forget all landed rows of windows, whatever the lake holds of them."""
        self._forget([b["staged"] for b in self._live() if b["window_id"] in windows], None)

    def drop_covered(self, window: int, coverage: DataFrame) -> str:
        """Forget the rows of a window that ``coverage`` (partition, origin, first_seq, last_seq) holds: dropped, residue_kept or already_gone.

        Rows that no range covers stay landed in their window, as a part of their own; nothing that the lake lacks is lost.
        """
        while True:
            old = [b for b in self._live() if b["window_id"] == window]
            if not old:
                return ALREADY_GONE
            name = f"residue-{window}-{len(self.log.state().batches)}-{self.log.state().version}"
            with Scratch(self.spark) as scratch:
                rows, number = self.rows([window]), ["partition", "origin", "seq"]
                # whether a row is covered depends on its number only, so whole rows are moved for a residue alone
                found = scratch.table(covered(rows.select(*number), coverage, keep=False), "left")
                same = [rows[c].eqNullSafe(found[c]) for c in number]
                left = rows.join(found, same, "left_semi")
                left.write.mode("overwrite").parquet(f"{self.path}/{name}")
                kept = self.spark.read.schema(left.schema).parquet(f"{self.path}/{name}")
                n, size = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(content_bytes(kept.schema)), F.lit(0))).first()
            entry = None
            if n:
                entry = {"do": "batch", "id": f"residue/{name}", "order": -1, "window_id": window, "opened_ms": 0, "staged": name, "ledger": None, "applied": {}, "rows": n, "bytes": size}
            if self._forget([b["staged"] for b in old], entry):
                return RESIDUE_KEPT if n else DROPPED

    def _forget(self, staged: list[str], residue: dict | None) -> bool:
        """Take staged parts out, and put a residue in their place, by one entry; False if another writer came first and there is a residue to be judged again."""
        while True:
            s = self.log.state()
            have = set(s.batches.get("dropped", {}).get("staged", []))
            gone = {"do": "batch", "id": "dropped", "order": -1, "staged": sorted(have | set(staged)), "window_id": 0, "opened_ms": 0}
            if set(staged) <= have or self.log.append(s.version, [gone, *([residue] if residue else [])]):
                return True
            if residue:
                return False

    def start(self, stream: DataFrame, query: str, checkpoint: str, **trigger):
        """Land a stream of requests. The stream's own checkpoint replays batches; the landing's log makes that harmless."""
        writer = stream.writeStream.foreachBatch(lambda df, k: self.stage(df, query, k)).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
