"""Novelty of utterances as they arrive: the batch features, kept up by state of each conversation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "conv_id long, idx long, distinct_terms long, novel long, seen_before long"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen = set(state.get[0]) if state.exists else set()
    rows = pd.concat(list(batches)).sort_values("idx", kind="stable")
    out = []
    for idx, terms in zip(rows["idx"], rows["terms"], strict=True):
        own = set(terms) if terms is not None else set()
        out.append((key[0], idx, len(own), len(own - seen), len(seen)))
        seen |= own
    state.update((sorted(seen),))
    yield pd.DataFrame(out, columns=["conv_id", "idx", "distinct_terms", "novel", "seen_before"])


def novelty_stream(utterances: DataFrame) -> DataFrame:
    """Terms, new terms and terms seen before of each utterance of a stream (conv_id, idx, text).

    The state is the conversation's vocabulary. Utterances of one conversation must arrive in order from batch to batch;
    within a batch they are sorted. A null text has no terms.
    """
    terms = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))
    said = utterances.select("conv_id", "idx", terms.alias("terms"))
    return said.groupBy("conv_id").applyInPandasWithState(_advance, OUTPUT, "seen array<string>", "append", GroupStateTimeout.NoTimeout)
