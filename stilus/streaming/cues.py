"""Cue segmentation of timed words that arrive as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stilus.operators.cues import Limits

CUE = "segment_id long, start double, end double, text string"
_STATE = "start double, end double, text string, width int"


def cut(words: DataFrame, limits: Limits = Limits(), idle: str | None = None) -> DataFrame:
    """Cues of a stream of words (segment_id, start, end, word), emitted when a later word or a stop closes them.

    State is one open cue a segment. Words of a batch are taken in order of
    their start. ``idle``: emit the open cue of a segment that had no word for
    so long (processing time); otherwise the last cue stays open.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, cue = [], list(state.get) if state.exists else None
        if state.hasTimedOut:
            if cue:
                out.append((key[0], *cue[:3]))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("start")
            for start, end, word in zip(rows["start"], rows["end"], rows["word"], strict=True):
                if cue and (end - cue[0] > limits.longest or cue[3] + len(word) > limits.widest):
                    out.append((key[0], *cue[:3]))
                    cue = None
                cue = [cue[0], end, f"{cue[2]} {word.strip()}", cue[3] + 1 + len(word)] if cue else [start, end, word.strip(), len(word)]
                if word.endswith(tuple(limits.stops)) and cue[1] - cue[0] >= limits.shortest:
                    out.append((key[0], *cue[:3]))
                    cue = None
            if cue:
                state.update(tuple(cue))
                if idle:
                    state.setTimeoutDuration(idle)
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=["segment_id", "start", "end", "text"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return words.groupBy("segment_id").applyInPandasWithState(step, CUE, _STATE, "append", timeout)
