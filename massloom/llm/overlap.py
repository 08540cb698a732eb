"""Records of evaluation splits whose structure the training split holds, exactly or written in another way.

Every evaluation record is normalised into passages: the first block of its key, the connectivity code of its
structure and that of its ring part. The distinct passages are dealt to shards of bounded size, and an Aho-Corasick automaton
is made of each; every automaton is sent to the distinct normalised training texts and scans them where they lie. Matched
intervals are merged into the coverage of each evaluation record.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from massloom.functions.keys import readable_keys, row_blocks
from massloom.llm.structures import structure_codes
from massloom.session import durable_table

#: Passages of one automaton, about (which bounds what is sent to the tasks).
SHARD = 100_000
#: Normalised texts are short; a training text is the passages of one distinct record, set off from each other.
START, END = "<", ">"


def codes(df: DataFrame, column: str) -> DataFrame:
    """The distinct notations of ``column`` (null ones left out) with the ``code`` of the structure (null: unreadable) and of its ``core`` (null: no rings)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [structure_codes(t) or (None, None) for t in b.column(0).to_pylist()]
            parts = [pa.array([x[i] for x in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *parts], names=[column, "code", "core"])

    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    # Short texts, long work: adaptive execution would put megabytes of them into one task.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return distinct.repartition(tasks, F.xxhash64(column)).mapInArrow(read, f"{column} string, code string, core string")


def _passages(blocks: Column, code: Column, core: Column) -> Column:
    """The passages of a record: ``<k:BLOCK>`` for each block, ``<s:code>`` for the structure, ``<r:core>`` for its ring part."""
    mark = lambda kind: lambda x: F.concat(F.lit(f"{START}{kind}:"), x, F.lit(END))
    one = lambda kind, c: F.transform(F.array_compact(F.array(c)), mark(kind))
    return F.concat(F.transform(blocks, mark("k")), one("s", code), one("r", core))


def training_texts(train: DataFrame) -> DataFrame:
    """``text``: the distinct normalised texts of the training records (the passages of a record, one after another)."""
    distinct = train.select(
        row_blocks(F.col("inchikey"), F.col("inchikey14")).alias("blocks"), F.col("normalized_smiles").alias("notation")
    ).distinct()
    distinct = durable_table(distinct)
    coded = distinct.join(codes(distinct, "notation"), "notation", "left")
    text = F.array_join(_passages(F.col("blocks"), F.col("code"), F.col("core")), "")
    return coded.select(text.alias("text")).where("text != ''").distinct()


def evaluation_passages(external: DataFrame) -> DataFrame:
    """``split``, ``source_library``, ``spectrum_id``, ``text`` and ``passages`` (with their place in the text)."""
    blocks = F.array_distinct(F.transform(readable_keys(F.col("inchikey")), lambda k: F.substring(k, 1, 14)))
    ext = external.select("split", "source_library", "spectrum_id", F.col("canonical_smiles").alias("notation"), blocks.alias("blocks"))
    coded = ext.join(codes(ext, "notation"), "notation", "left").withColumn("passages", _passages(F.col("blocks"), F.col("code"), F.col("core")))
    return coded.select("split", "source_library", "spectrum_id", "passages")


def automata(passages: DataFrame) -> DataFrame:
    """``shard``, ``automaton``: a pickled automaton for each shard of about SHARD of the distinct values of ``passage``."""
    shards = -(-passages.count() // SHARD) or 1

    def build(t: pa.Table) -> pa.Table:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for p in t.column("passage").to_pylist():
            automaton.add_word(p, p)
        automaton.make_automaton()
        return pa.table({"shard": t.column("shard").slice(0, 1), "automaton": pa.array([pickle.dumps(automaton)], pa.binary())})

    dealt = passages.withColumn("shard", F.pmod(F.xxhash64("passage"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(build, "shard int, automaton binary")


def scan(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """The distinct values of ``passage`` that occur in a ``text``: each shard's automaton is sent to all texts, which stay where they are."""
    built = durable_table(automata(passages))
    found = None
    for shard in sorted(r["shard"] for r in built.select("shard").collect()):  # a number for each SHARD passages
        sent = texts.sparkSession.sparkContext.broadcast(built.where(F.col("shard") == shard).first()["automaton"])

        def find(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            automaton, seen = pickle.loads(sent.value), set()
            for b in batches:
                new = {p for t in b.column("text").to_pylist() for _, p in automaton.iter(t)} - seen
                seen |= new  # at most the passages of the shard
                yield pa.RecordBatch.from_arrays([pa.array(sorted(new), pa.string())], names=["passage"])

        hits = texts.select("text").mapInArrow(find, "passage string")
        found = hits if found is None else found.unionByName(hits)
    return (passages.limit(0) if found is None else found).distinct()


def overlaps(external: DataFrame, train: DataFrame) -> DataFrame:
    """Evaluation records with a part that training holds: ids, ``by_key``, ``by_structure``, ``by_rings`` and ``coverage``.

    ``coverage`` is the share of the record's normalised text under the merged matched intervals. A record is the same as
    one in training if its key block or its structure is matched, and near to one if only its ring part is. Records in which neither structure nor key can be read
    have no passage and never overlap. Nulls in any column are allowed; repeated rows come out as often as they occur;
    empty tables give an empty result.
    """
    records = durable_table(evaluation_passages(external))
    exploded = records.select(F.explode("passages").alias("passage")).distinct()
    matched = scan(exploded, durable_table(training_texts(train)))
    numbered = records.withColumn("row", F.monotonically_increasing_id())
    placed = numbered.select("row", "split", "source_library", "spectrum_id", "passages", F.posexplode("passages").alias("at", "passage"))
    start = F.aggregate(F.slice("passages", 1, F.col("at")), F.lit(0), lambda n, p: n + F.length(p))
    hits = placed.withColumn("start", start).join(matched, "passage")
    whole = F.aggregate("passages", F.lit(0), lambda n, p: n + F.length(p))
    per_record = hits.groupBy("row").agg(
        F.first("split").alias("split"),
        F.first("source_library").alias("source_library"),
        F.first("spectrum_id").alias("spectrum_id"),
        F.first(whole).alias("length"),
        F.max(F.col("passage").startswith(f"{START}k:")).alias("by_key"),
        F.max(F.col("passage").startswith(f"{START}s:")).alias("by_structure"),
        F.max(F.col("passage").startswith(f"{START}r:")).alias("by_rings"),
        F.array_sort(F.collect_list(F.struct(F.col("start").alias("a"), (F.col("start") + F.length("passage")).alias("b")))).alias("at"),
    )
    # Intervals in order: each adds what reaches beyond the furthest end so far (a record has a few passages).
    merged = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("covered"), F.lit(0).alias("end")),
        lambda s, x: F.struct(
            (s["covered"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["end"]))).alias("covered"),
            F.greatest(s["end"], x["b"]).alias("end"),
        ),
        lambda s: s["covered"],
    )
    return per_record.select(
        "split", "source_library", "spectrum_id", "by_key", "by_structure", "by_rings", F.round(merged / F.col("length"), 4).alias("coverage")
    )


def overlap_report(external: DataFrame, train: DataFrame) -> DataFrame:
    """Per split and source: records, records that training holds, how they were found, and records that only share a ring part."""
    same = F.col("by_key") | F.col("by_structure")
    found = overlaps(external, train).groupBy("split", "source_library").agg(
        F.count_if(same).alias("n_overlap"),
        F.count_if("by_key").alias("n_by_key"),
        F.count_if("by_structure").alias("n_by_structure"),
        F.count_if(~same).alias("n_near"),
    )
    every = external.groupBy("split", "source_library").agg(F.count(F.lit(1)).alias("n_records"))
    joined = every.join(found, ["split", "source_library"], "left")
    counts = ("n_overlap", "n_by_key", "n_by_structure", "n_near")
    return joined.select("split", "source_library", "n_records", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))
