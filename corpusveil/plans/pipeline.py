"""The whole way from blocks to masked text, as named steps."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.detect import detect
from ..operators.detectors import Detectors
from ..operators.masking import masked
from ..operators.matches import apply_answers, matches, questions, with_roles
from ..operators.registry import repeats
from ..schema import ENTITY_TYPES
from ..sources.tables import cut


class Proposal(NamedTuple):
    """Blocks with their spans, the matches, and what needs an answer."""

    blocks: DataFrame
    matches: DataFrame
    questions: DataFrame


def propose(blocks: DataFrame, types: tuple[str, ...] | list[str] = ENTITY_TYPES, mock: bool = False, roles: bool = True, detectors: Detectors | None = None) -> Proposal:
    """Detect, repeat, link, number and assign roles. The detected blocks are written once, since four steps read them.

    `detectors` bring candidates below the rules; their failures are left out here, see `Detectors.candidates`.
    """
    if not types:
        raise ValueError("no entity types")
    if detectors:
        blocks = detectors.candidates(blocks)[0]
    found = cut(detect(blocks, types, mock), "detected")
    found = cut(repeats(found), "repeated")
    out = matches(found, types)
    if roles:
        out = with_roles(out, found)
    out = cut(out, "matches")
    return Proposal(found, out, questions(out, found))


def mask(proposal: Proposal, answers: DataFrame | None = None, style: str = "full") -> DataFrame:
    """Masked blocks after the answers, if any."""
    found = proposal.matches if answers is None else apply_answers(proposal.matches, answers)
    return masked(proposal.blocks.select("doc_id", "block_ord", "text"), found, style)


def job_progress(stages: DataFrame) -> DataFrame:
    """Per job 20 for each stage that is done."""
    return stages.groupBy("job_id").agg(F.sum(F.when(F.col("status") == "done", 20).otherwise(0)).alias("progress"))


def job_queue(jobs: DataFrame) -> DataFrame:
    """Queued jobs, the earliest first."""
    return jobs.where("status = 'queued'").orderBy("created_at", "job_id")
