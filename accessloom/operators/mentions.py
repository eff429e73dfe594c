"""Find the person whose full name occurs inside free text, by automata over the names and without a join of texts."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from accessloom.operators import automaton
from accessloom.session import cut_lineage

#: Characters of the names of one automaton; it takes about 20 bytes for each, in every task.
PART_CHARS = 1 << 22
_TEXTS = 2048


def _built(batches):
    """One range of names (needle, identity_id) as rows of one pickled automaton and the ids its values stand for."""
    needles, ids = [], []
    for batch in batches:
        needles += batch.column(0).to_pylist()
        ids += batch.column(1).to_pylist()
    if needles:
        known = sorted(set(ids))
        rank = {i: k for k, i in enumerate(known)}
        values = np.array([rank[i] for i in ids], np.int64)
        yield pa.RecordBatch.from_pydict({"automaton": pa.array([pickle.dumps((automaton.Automaton.of(needles, values), known))], pa.binary())})


def first_mentioned(texts: DataFrame, identities: DataFrame, part_chars: int | None = None) -> DataFrame:
    """(text, identity_id): smallest identity whose lower-cased name is a substring of the text.

    The names, sorted, are cut into ranges of about ``part_chars`` characters; a task builds the automaton of each range,
    and every automaton, whose size that bounds, is sent to the tasks that hold the texts. A text is read once per range;
    what moves are the texts that mention someone, not their characters.
    """
    names = (
        identities.filter(F.col("name") != "").select(F.lower("name").alias("needle"), "identity_id")
        .groupBy("needle").agg(F.min("identity_id").alias("identity_id")))
    names = cut_lineage(names)
    total = names.agg(F.sum(F.length("needle"))).first()[0] or 0
    ranges = max(1, -(-total // (part_chars or PART_CHARS)))
    built = cut_lineage(names.repartitionByRange(ranges, "needle").mapInArrow(_built, "automaton binary").withColumn(
        "part", F.monotonically_increasing_id()))
    keyed = cut_lineage(texts.select("text").filter(F.col("text") != "").distinct().withColumn("lowered", F.lower("text")))
    kind, arrow = dict(names.dtypes)["identity_id"], to_arrow_type(names.schema["identity_id"].dataType)
    context, found = texts.sparkSession.sparkContext, None
    for part in sorted(r.part for r in built.select("part").collect()):
        shared = context.broadcast(built.where(F.col("part") == part).first().automaton)
        mentioned = cut_lineage(keyed.mapInArrow(_scanned(shared, arrow), f"text string, identity_id {kind}"))
        found = mentioned if found is None else found.unionByName(mentioned)
    if found is None:
        return keyed.select("text", F.lit(None).cast(kind).alias("identity_id")).limit(0)
    return found if ranges == 1 else found.groupBy("text").agg(F.min("identity_id").alias("identity_id"))


def _scanned(shared, kind):
    def scan(batches):
        names, known = pickle.loads(shared.value)
        for batch in batches:
            for first in range(0, batch.num_rows, _TEXTS):
                rows = batch.slice(first, _TEXTS)
                least = names.least(rows.column(1).to_pylist())
                hit = least != automaton.NONE
                ids = pa.array([known[i] for i in least[hit].tolist()], kind)
                if hit.any():
                    yield pa.RecordBatch.from_arrays([rows.column(0).filter(pa.array(hit)), ids], names=["text", "identity_id"])
    return scan
