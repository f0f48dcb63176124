"""Exactly one copy of messages that arrive at least once, under identifiers that are dirty and may link transitively.

One batch is admitted like this. Copies are combined per set of identifiers. Each identifier is encoded by an exact dictionary
(identifier -> shard and dense code in the shard); new ones get codes, which are published at once and mean nothing yet. Then each code's bit
is tested in the shard's seen-bitmap, and sets that share an identifier are joined into one request (connected components). A
request with a seen bit delivers nothing; of any other exactly one arrival is selected, the one with the least id. At last the bits of
the request's identifiers are united with those seen, and verdicts and bits are published together by one exclusive file creation. A
consumer that dies between the two leaves codes whose bits are not set, so the batch is judged as if it had never been tried.

A later batch may show that two requests delivered before are one, or hold an arrival with a lesser id. It delivers nothing for them; the
link is published with it, and resolved() names the least arrival of every request as all batches show it.

Bitmaps are Spark's (4 KiB for 32768 bits), one row per shard and bucket, compressed in Parquet; a code's shard comes from the
hash of the identifier, so shards and buckets stay even whatever the identifiers look like. A batch writes the bits it adds; the
parts are united when they are read, and rewritten as one after ``COMPACT_PARTS`` batches, as is the dictionary.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.operators.components import components
from tidewright.operators.skew import lookup_join
from tidewright.session import materialise
from tidewright.sources.atomic import list_names, put_if_absent, read_bytes

#: Characters without meaning around an identifier: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: Bits in one bitmap of Spark's bitmap functions.
BUCKET_BITS = 32_768

#: An identifier in flat columns: (tenant, rid) or (tenant, inc, idx), the other fields null.
TOKEN = ["tenant", "rid", "inc", "idx"]
DICTIONARY = T.StructType(
    [T.StructField("tenant", T.StringType()), T.StructField("rid", T.StringType()), T.StructField("inc", T.StringType()), T.StructField("idx", T.LongType())]
    + [T.StructField("shard", T.IntegerType()), T.StructField("code", T.LongType())]
)
#: The line kept for the request of a seen code.
OWNERS = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("code", T.LongType()), T.StructField("kept", T.LongType())])
LINKS = T.StructType([T.StructField("u", T.LongType()), T.StructField("m", T.LongType())])
#: After so many parts a table of the state is rewritten as one.
COMPACT_PARTS = 16
BITMAPS = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("bucket", T.LongType()), T.StructField("bits", T.BinaryType())])
VERDICTS = T.StructType([T.StructField("line_id", T.LongType()), T.StructField("kept_line_id", T.LongType())])


def _trimmed(c: str) -> Column:
    return F.btrim(F.col(c), F.lit(BLANKS))


def _identified(lines: DataFrame) -> DataFrame:
    """line_id and the line's identifiers: rid, and inc with idx, null where they identify nothing; tenant is null if neither does."""
    known = F.col("tenant").isNotNull()
    rid = F.nullif(F.lower(_trimmed("request_id")), F.lit(""))
    pair = (_trimmed("source_incarnation") != "") & F.col("first_index").isNotNull()
    rows = lines.select("line_id", F.col("tenant"), F.when(known, rid).alias("rid"), F.when(known & pair, F.col("source_incarnation")).alias("inc"), F.when(known & pair, F.col("first_index")).alias("idx"))
    return rows.withColumn("tenant", F.when(F.col("rid").isNotNull() | F.col("inc").isNotNull(), F.col("tenant")))


def bit_is_set(bits: Column, code: Column) -> Column:
    """Whether ``code``'s bit is set in its bucket's bitmap; false where there is no bitmap."""
    at = F.pmod(code, F.lit(BUCKET_BITS))
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))


def _bitmaps(codes: DataFrame) -> DataFrame:
    # bitmap_construct_agg wants positions; code k of a shard is bit k % 32768 of bucket k / 32768
    return codes.groupBy("shard", F.floor(F.col("code") / BUCKET_BITS).alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("code", F.lit(BUCKET_BITS))).alias("bits"))


def _united(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.groupBy("shard", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


class SeenStore:
    """State of a de-duplicating consumer: a folder of published versions.

    ``_codes/NNN.json`` names the parts of the dictionary, ``_versions/NNN.json`` those of bitmaps, owners, links and verdicts; creating one
    exclusively is the commit. Files of a version that lost the race or whose writer died are never read.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int = 256):
        self.spark, self.path, self.shards = spark, path.rstrip("/"), shards

    def _head(self, log: str, empty: dict) -> dict:
        names = [n for n in list_names(self.spark, f"{self.path}/{log}") if n.endswith(".json")]
        return json.loads(read_bytes(self.spark, f"{self.path}/{log}/{names[-1]}")) if names else empty

    def head(self) -> dict:
        return self._head("_versions", {"version": 0, "bitmaps": [], "owners": [], "links": [], "batches": {}})

    def codes(self) -> dict:
        """Parts of the dictionary and, by shard, the next code."""
        return self._head("_codes", {"version": 0, "shards": self.shards, "parts": [], "next": {}})

    def _put(self, log: str, version: dict) -> bool:
        return put_if_absent(self.spark, f"{self.path}/{log}/{version['version']:09d}.json", json.dumps(version).encode())

    def _read(self, names: list[str], schema: T.StructType) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def _compact(self, names: list[str], schema: T.StructType, run: str) -> list[str]:
        if len(names) <= COMPACT_PARTS:
            return names
        whole, df = f"whole-{run}-{names[-1]}", self._read(names, schema)
        (_united(df) if schema is BITMAPS else df).write.option("compression", "zstd").parquet(f"{self.path}/{whole}")
        return [whole]

    def dictionary(self) -> DataFrame:
        return self._read(self.codes()["parts"], DICTIONARY)

    def bitmaps(self, head: dict | None = None) -> DataFrame:
        names = (head or self.head())["bitmaps"]
        found = self._read(names, BITMAPS)
        return _united(found) if len(names) > 1 else found

    def _encoded(self, tokens: DataFrame) -> DataFrame:
        """``tokens`` with their codes, after new ones were published (one job if the dictionary is empty)."""
        while True:
            codes, run = self.codes(), uuid.uuid4().hex[:12]
            found = tokens.withColumn("shard", F.pmod(F.xxhash64(*TOKEN), F.lit(codes["shards"])).cast("int"))
            if codes["version"]:
                old = self._read(codes["parts"], DICTIONARY).select(*[F.col(f).alias("o_" + f) for f in TOKEN], F.col("shard").alias("o_shard"), "code")
                same = F.col("shard") == F.col("o_shard")
                for f in TOKEN:
                    same = same & F.col(f).eqNullSafe(F.col("o_" + f))
                found = materialise(found.join(old, same, "left").drop("o_shard", *["o_" + f for f in TOKEN]), "tokens")
                new = found.where("code is null").drop("code")
            else:
                new = found
            base = F.coalesce(F.element_at(F.from_json(F.lit(json.dumps(codes["next"])), "map<string,bigint>"), F.col("shard").cast("string")), F.lit(0))
            rank = F.row_number().over(Window.partitionBy("shard").orderBy(*TOKEN)).cast("bigint") - 1
            part = f"dictionary-{codes['version'] + 1:06d}-{run}"
            new.withColumn("code", base + rank).write.parquet(f"{self.path}/{part}")
            schema = T.StructType([*tokens.schema.fields, *DICTIONARY.fields[-2:]])
            coded = self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
            tops = coded.groupBy("shard").agg(F.max("code").alias("top")).collect()  # one row per shard
            if tops:
                parts = self._compact([*codes["parts"], part], DICTIONARY, run)
                version = {"version": codes["version"] + 1, "shards": codes["shards"], "parts": parts, "next": codes["next"] | {str(r["shard"]): r["top"] + 1 for r in tops}}
                if not self._put("_codes", version):
                    continue  # another consumer encoded first: its codes count
            return found.where("code is not null").unionByName(coded) if codes["version"] else coded

    def admit(self, lines: DataFrame, batch: str) -> DataFrame:
        """Verdicts of a batch: line_id, kept_line_id. A line is delivered exactly if the two are equal.

        ``lines`` has line_id (unique, not null), tenant, request_id, source_incarnation, first_index; other columns are ignored. Letter case and
        blanks around request_id mean nothing. A null or blank request_id, a pair with a null or blank incarnation or a null index,
        and a null tenant identify nothing; a line without identifier is delivered. A batch name that was published before returns
        the verdicts of then. An identifier seen in an earlier batch points at the line kept then, the least if there are several.
        """
        head = self.head()
        if batch in head["batches"]:
            return self._read([head["batches"][batch]], VERDICTS)
        run = uuid.uuid4().hex[:12]
        names = {k: f"{k}-{head['version'] + 1:06d}-{run}" for k in ("verdicts", "owners", "bitmaps", "links")}

        ident = _identified(lines)
        # copies under the same identifiers are combined on the map side; a set of identifiers is named by its least line
        sets = materialise(ident.where("tenant is not null").groupBy(*TOKEN).agg(F.min("line_id").alias("set"), F.count(F.lit(1)).alias("n")), "sets")
        none, no_idx = F.lit(None).cast("string"), F.lit(None).cast("bigint")
        first = F.when(F.col("rid").isNotNull(), F.struct("tenant", "rid", none.alias("inc"), no_idx.alias("idx")))
        second = F.when(F.col("inc").isNotNull(), F.struct("tenant", none.alias("rid"), "inc", "idx"))
        by_token = sets.select("set", F.explode(F.array_compact(F.array(first, second))).alias("t")).select("set", "t.*")
        tokens = self._encoded(by_token.groupBy(*TOKEN).agg(F.min("set").alias("low"), F.count(F.lit(1)).alias("sets")))

        # the bits tell which identifiers were seen; a code alone tells nothing
        if head["bitmaps"]:
            bits = self.bitmaps(head).withColumnsRenamed({"shard": "b_shard", "bucket": "b_bucket"})
            tested = tokens.join(bits, (F.col("shard") == F.col("b_shard")) & (F.floor(F.col("code") / BUCKET_BITS) == F.col("b_bucket")), "left")
            tested = tested.withColumn("seen", bit_is_set(F.col("bits"), F.col("code"))).drop("bits", "b_shard", "b_bucket")
            owners = self._read(head["owners"], OWNERS).select(F.col("shard").alias("w_shard"), F.col("code").alias("w_code"), "kept")
            tested = tested.join(owners, F.col("seen") & (F.col("shard") == F.col("w_shard")) & (F.col("code") == F.col("w_code")), "left").drop("w_shard", "w_code")
            tokens = materialise(tested, "tokens")

        # sets that share an identifier are one request; only identifiers of several sets link anything
        loads = tokens.withColumnRenamed("sets", "__tw_load")
        shared = tokens.where("sets > 1").select(*TOKEN, "low")
        linked = lookup_join(by_token, shared, TOKEN, ["set"], "inner", loads=loads)
        roots = components(linked.where("set != low").select(F.col("set").alias("u"), F.col("low").alias("m")))
        of_set = sets.join(roots.select(F.col("u").alias("set"), "m"), "set", "left").withColumn("root", F.coalesce("m", "set")).drop("m")
        links = None
        if head["bitmaps"]:
            hit = lookup_join(by_token, tokens.where("seen").select(*TOKEN, "kept"), TOKEN, ["set"], "inner", loads=loads)
            hit = materialise(hit.join(of_set.select("set", "root"), "set").select("root", F.col("kept").alias("owner")).distinct(), "owned")
            earlier = hit.groupBy("root").agg(F.min("owner").alias("kept"))
            of_set = of_set.join(earlier, "root", "left").withColumn("kept", F.coalesce("kept", "root"))
            one = hit.join(earlier, "root")
            links = one.where("owner != kept").select(F.col("owner").alias("u"), F.col("kept").alias("m")).unionAll(one.where("root < kept").select(F.col("kept").alias("u"), F.col("root").alias("m"))).distinct()
        else:
            of_set = of_set.withColumn("kept", F.col("root"))
        of_set = materialise(of_set, "requests")

        # one arrival per unseen request: sets of a single line that is its own request are the bulk and need no partner
        twice = of_set.where("n > 1 or kept != set").select(*TOKEN, "kept")
        verdicts = lookup_join(ident, twice, TOKEN, ["line_id"], "left", loads=of_set.withColumnRenamed("n", "__tw_load"))
        verdicts.select("line_id", F.coalesce("kept", "line_id").alias("kept_line_id")).write.parquet(f"{self.path}/{names['verdicts']}")

        # the bits of identifiers that had none, and whose line they lead to
        unseen = tokens.where("not seen") if head["bitmaps"] else tokens
        kept_of = of_set.select(F.col("set").alias("low"), "kept")
        unseen.select("low", "shard", "code").join(kept_of, "low").select(*OWNERS.names).write.parquet(f"{self.path}/{names['owners']}")
        _bitmaps(self._read([names["owners"]], OWNERS)).write.option("compression", "zstd").parquet(f"{self.path}/{names['bitmaps']}")
        if links is not None:
            links.write.parquet(f"{self.path}/{names['links']}")

        version = {
            "version": head["version"] + 1,
            "bitmaps": self._compact([*head["bitmaps"], names["bitmaps"]], BITMAPS, run),
            "owners": self._compact([*head["owners"], names["owners"]], OWNERS, run),
            "links": [*head["links"], *([] if links is None else [names["links"]])],
            "batches": head["batches"] | {batch: names["verdicts"]},
        }
        if not self._put("_versions", version):
            return self.admit(lines, batch)  # another consumer published first: judge the batch against its state
        return self._read([names["verdicts"]], VERDICTS)

    def resolved(self) -> DataFrame:
        """The verdicts of all batches with requests named by their least line, as the links that later batches found show it."""
        head = self.head()
        verdicts = self._read(list(head["batches"].values()), VERDICTS)
        if not head["links"]:
            return verdicts
        roots = components(self._read(head["links"], LINKS)).select(F.col("u").alias("kept_line_id"), "m")
        out = lookup_join(verdicts, roots, ["kept_line_id"], ["line_id"], "left")
        return out.select("line_id", F.coalesce("m", "kept_line_id").alias("kept_line_id"))


def admit_in_batches(store: SeenStore, lines: DataFrame, batch: str, groups: int) -> DataFrame:
    """Admit ``lines`` in ``groups`` batches by ranges of the bigint column ``batch``, in its order, and resolve them: line_id, kept_line_id.

    Ranges hold about as many lines each (approximate quantiles decide where they end, so they decide nothing about the result). A null batch comes first.
    """
    cuts = sorted(set(lines.approxQuantile(batch, [k / groups for k in range(1, groups)], 0.01))) if groups > 1 else []
    at = F.coalesce(F.col(batch), F.lit(-(2**63)))
    edges = [None, *[int(c) for c in cuts], None]
    for k, (low, high) in enumerate(zip(edges, edges[1:])):
        inside = (F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high)
        store.admit(lines.where(inside), f"group-{k:06d}")
    return store.resolved()


def duplicates(verdicts: DataFrame) -> DataFrame:
    """Lines that are not delivered, beside the line kept for their request."""
    return verdicts.where("kept_line_id != line_id").select("kept_line_id", "line_id")
