"""Documents that wait for answers: a state machine by document over two streams.

Intake detects each document once and writes its blocks and matches; then it says which questions are open.
The second query keeps, by document, what is asked and what is answered. Once every question has its answer
the document is released, and masked from what intake wrote. Both queries go on where their checkpoint
stands, and each step can run again: a batch that is there stays, a document that is released stays so.

    waiting --(all questions answered)--> released --(the document comes again)--> waiting
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.masking import masked
from ..operators.matches import apply_answers
from ..plans.pipeline import propose
from ..schema import ENTITY_TYPES
from ..sources.snapshots import ensure, exists, rename_to_free
from ..sources.tables import delete, line_blocks, scratch
from .intake import DOCUMENTS

ANSWERS = "doc_id long, question_id string, answer string"
WAITING = "doc_id long, questions array<string>, batch long"
OPTIONS = ("mask", "keep")
#: What the state machine says: a release with its answers, or an answer that it rejects with the reason.
EVENTS = "doc_id long, batch long, event string, question_ids array<string>, answers array<string>, reason string"
_STATE = "batch long, open array<string>, question_ids array<string>, answers array<string>, released boolean"


def _keep(df: DataFrame, path: str) -> None:
    """Write a table that comes to be at once, unless it is there already."""
    spark, (folder, name) = df.sparkSession, path.rsplit("/", 1)
    made = f"{folder}/_{name}-{uuid.uuid4().hex}"
    df.write.parquet(made)
    if not rename_to_free(spark, made, path):
        delete(spark, [made])


def start_intake(spark: SparkSession, source: str, work: str, checkpoint: str, types: tuple[str, ...] | list[str] = ENTITY_TYPES, mock: bool = False, every: str | None = None) -> StreamingQuery:
    """Detect the Parquet documents (doc_id, text) that come into `source`, and write to `work` their blocks, their matches and what is asked of them."""

    def write(batch: DataFrame, number: int) -> None:
        if exists(spark, f"{work}/waiting/batch={number}"):
            return
        with scratch(spark):
            p = propose(line_blocks(batch), types, mock)
            _keep(p.blocks.select("doc_id", "block_ord", "text"), f"{work}/blocks/batch={number}")
            _keep(p.matches, f"{work}/matches/batch={number}")
            asked = p.questions.groupBy("doc_id").agg(F.array_sort(F.collect_set("question_id")).alias("questions"))
            none = F.array().cast("array<string>")
            _keep(batch.select("doc_id").distinct().join(asked, "doc_id", "left").withColumn("questions", F.coalesce("questions", none)), f"{work}/waiting/batch={number}")

    return spark.readStream.schema(DOCUMENTS).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**_when(every)).start()


def _when(every: str | None) -> dict:
    return {"availableNow": True} if every is None else {"processingTime": every}


def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One document's events of a batch: its arrivals first, then answers by question and text.

    An answer before the document waits for it; the first to a question counts. Answers to no open question,
    of no option, or after the release are rejected. An arrival with the batch that is known changes nothing.
    """
    rows = pd.concat(list(frames))
    batch, open_, ids, texts, released = state.get if state.exists else (None, [], [], [], False)
    given, out = dict(zip(ids, texts, strict=True)), []
    open_ = list(open_)

    def reject(question: str | None, answer: str | None, reason: str) -> None:
        out.append((key[0], batch, "rejected", [question], [answer], reason))

    for r in rows[rows["questions"].notna()].sort_values("batch").itertuples():
        if batch is None or r.batch > batch:
            if released:
                given = {}
            batch, open_, released = int(r.batch), list(r.questions), False
            for q in [q for q in given if q not in open_]:
                reject(q, given.pop(q), "unknown_question")
    for r in rows[rows["questions"].isna()].sort_values(["question_id", "answer"]).itertuples():
        if r.question_id is None or r.answer not in OPTIONS:
            reject(r.question_id, r.answer, "not_an_option")
        elif released:
            reject(r.question_id, r.answer, "not_waiting")
        elif batch is not None and r.question_id not in open_:
            reject(r.question_id, r.answer, "unknown_question")
        elif r.question_id in given:
            reject(r.question_id, r.answer, "answered_before")
        else:
            given[r.question_id] = r.answer
    if batch is not None and not released and set(open_) <= set(given):
        released = True
        out.append((key[0], batch, "released", list(given), list(given.values()), None))
    state.update((batch, open_, list(given), list(given.values()), released))
    yield pd.DataFrame(out, columns=[x.split()[0] for x in EVENTS.split(", ")])


def start_release(spark: SparkSession, work: str, answers: str, target: str, checkpoint: str, style: str = "full", every: str | None = None) -> StreamingQuery:
    """Mask the documents of `work` of which every question is answered by the Parquet files (doc_id, question_id, answer) that come into `answers`.

    Each batch's documents go to a folder of `target`, rejected answers to `work`/rejected.
    """
    for path in (f"{work}/waiting", answers):
        ensure(spark, path)
    waiting = spark.readStream.schema(WAITING).parquet(f"{work}/waiting").select("doc_id", "batch", "questions", F.lit(None).cast("string").alias("question_id"), F.lit(None).cast("string").alias("answer"))
    given = spark.readStream.schema(ANSWERS).parquet(answers).where("doc_id is not null").select("doc_id", F.lit(None).cast("long").alias("batch"), F.lit(None).cast("array<string>").alias("questions"), "question_id", "answer")
    events = waiting.unionByName(given).groupBy("doc_id").applyInPandasWithState(step, EVENTS, _STATE, "append", GroupStateTimeout.NoTimeout)

    def write(found: DataFrame, number: int) -> None:
        if exists(spark, f"{target}/batch={number}"):
            return
        own = found.persist()
        try:
            out = own.where("event = 'released'").select("doc_id", "batch", F.arrays_zip("question_ids", "answers").alias("a"))
            ready = out.select("doc_id", "batch")
            replies = out.select("doc_id", F.explode("a").alias("a")).select("doc_id", F.col("a.question_ids").alias("question_id"), F.col("a.answers").alias("answer"))
            blocks, matches = (spark.read.parquet(f"{work}/{n}").withColumn("batch", F.col("batch").cast("long")).join(ready, ["doc_id", "batch"], "left_semi").drop("batch") for n in ("blocks", "matches"))
            _keep(own.where("event = 'rejected'").drop("event"), f"{work}/rejected/batch={number}")
            _keep(masked(blocks, apply_answers(matches, replies), style).select("doc_id", "block_ord", "masked", "complete"), f"{target}/batch={number}")
        finally:
            own.unpersist()

    return events.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**_when(every)).start()
