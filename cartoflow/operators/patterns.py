"""Many patterns in many texts at once.

``occurring`` reads each text once, whatever the number of patterns: an Aho-Corasick automaton of all of them is broadcast
and runs over Arrow batches.  That is for sets of patterns up to AUTOMATON_BYTES, which is checked; beyond it (or without the
automaton's library) patterns are hash-joined to the texts' runs of ANCHOR characters by their own beginning, and what meets
is compared in full.  Both give the same rows.

Empty patterns are nowhere; null texts hold nothing; case counts (lower both sides for a case-insensitive search).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:  # the join does the same
    ahocorasick = None

AUTOMATON_BYTES, ANCHOR = 8 << 20, 4
#: What an automaton takes for a pattern beside its characters, about.
_NODE = 64


def _by_automaton(texts: DataFrame, patterns: list[str]) -> DataFrame:
    automaton = ahocorasick.Automaton()
    for k, pattern in enumerate(patterns):
        automaton.add_word(pattern, k)
    automaton.make_automaton()
    shared = texts.sparkSession.sparkContext.broadcast((automaton, patterns))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, names = shared.value
        for batch in batches:
            row, which = [], []
            for i, text in enumerate(batch.column("text")):
                hit = {k for _, k in found.iter(text.as_py())} if text.is_valid else ()
                row.extend([i] * len(hit))
                which.extend(hit)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row, pa.int64())), pa.array([names[k] for k in which], pa.string())], names=["id", "pattern"])

    return texts.mapInArrow(each, f"id {texts.schema['id'].dataType.simpleString()}, pattern string")


def _by_anchors(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    anchors = patterns.select("pattern", F.least(F.lit(ANCHOR), F.length("pattern")).alias("g")).withColumn("gram", F.substring("pattern", F.lit(1), F.col("g")))
    sizes, longest = F.array(*[F.lit(r[0]) for r in anchors.select("g").distinct().collect()]), patterns.agg(F.max(F.length("pattern"))).first()[0] or 1  # ANCHOR sizes at most
    places = texts.where("length(text) > 0").select("id", "text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("at"))
    # A place needs what the longest pattern takes, and not the text.
    places = places.select("id", F.substring("text", F.col("at"), F.lit(longest)).alias("rest"), F.explode(sizes).alias("g")).withColumn("gram", F.substring("rest", F.lit(1), F.col("g")))
    return places.join(anchors, ["g", "gram"]).where(F.col("rest").startswith(F.col("pattern"))).select("id", "pattern").distinct()


def occurring(texts: DataFrame, patterns: DataFrame, id_: str = "id", text: str = "text", pattern: str = "pattern", most: int = AUTOMATON_BYTES) -> DataFrame:
    """(id, pattern), a row for each pattern that a row's text has, however often; equal patterns are one."""
    rows = texts.select(F.col(id_).alias("id"), F.col(text).alias("text"))
    wanted = patterns.select(F.col(pattern).alias("pattern")).where("length(pattern) > 0").distinct()
    size = wanted.agg(F.coalesce(F.sum(F.length("pattern") + _NODE), F.lit(0))).first()[0]
    if not size:
        return rows.where("false").select("id", F.col("text").alias("pattern"))
    if ahocorasick is None or size > most:
        return _by_anchors(rows, wanted)
    return _by_automaton(rows, [r[0] for r in wanted.orderBy("pattern").collect()])  # `most` at most
