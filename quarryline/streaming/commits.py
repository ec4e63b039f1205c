"""Commit ingestion on a stream (T3): each repository's commits are taken in order, without gaps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "repo string, sha string, verdict string"


def _take(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else ""
    rows = pd.concat(frames).sort_values("ord")
    out = []
    for sha, parents in zip(rows["sha"], rows["parents"], strict=True):
        if sha == last:
            verdict = "applied"  # delivered again
        elif not last or last in list(parents):
            last, verdict = sha, "accepted"
        else:
            verdict = "gap"
        out.append((key[0], sha, verdict))
    state.update((last,))
    yield pd.DataFrame(out, columns=["repo", "sha", "verdict"])


def ingest(commits: DataFrame) -> DataFrame:
    """A stream of commits(repo, sha, parents, ord) -> (repo, sha, verdict): accepted if it is the first or follows the
    last accepted one, applied if it is that one, gap otherwise. The state of a repository is one id."""
    return commits.groupBy("repo").applyInPandasWithState(_take, OUT, "last string", "append", GroupStateTimeout.NoTimeout)
