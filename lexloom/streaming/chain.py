"""A stream of amendment documents, each applied to its law as it comes.

State is one law's current text.  Documents are never dropped as late: one that was issued before the last
is applied, with a warning, as is one that comes twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexloom.plans.documents import recognise_document
from lexloom.plans.job import run_job
from lexloom.sources.canonical import write_law

OUTPUT = "law string, place long, document string, commands int, applied int, warnings string, text string"
STATE = "text string, place long, issued string"


def _amend(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    text, place, issued = state.get if state.exists else ("", 0, "")
    out = []
    rows = pd.concat(list(batches)).sort_values("ord", kind="stable")
    for row in rows.itertuples(index=False):
        if row.kind == "base":
            text = row.text
            continue
        result = run_job(text, [row.text])
        warnings = list(result.warnings)
        document = recognise_document(row.text)
        date = document.issued.isoformat() if document.issued else ""
        if date and issued and date < issued:
            warnings.append(f"{document.name} ist älter als das zuletzt angewandte Dokument.")
        issued = max(issued, date)
        place += 1
        text = write_law(result.new)
        applied = sum(e.status == "APPLIED" for e in result.entries)
        out.append((key[0], place, document.name, len(result.entries), applied, "; ".join(warnings), text))
    state.update((text, place, issued))
    yield pd.DataFrame(out, columns=[x.split()[0] for x in OUTPUT.split(", ")])


def amend_stream(documents: DataFrame) -> DataFrame:
    """documents streams (law, ord, kind, text): a "base" text for each law, then its amendments; ord orders a batch."""
    return documents.groupBy("law").applyInPandasWithState(_amend, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
