"""Commands as a table: prose in, one row for each simple command out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lexloom.functions import locator as L
from lexloom.plans.model import Command
from lexloom.plans.recognise import recognise

FIELDS = (
    "part int, kind string, at string, `to` string, old string, new string, each boolean, at_end boolean, level string, label string, before boolean, "
    "anchor struct<kind:string,words:string>, text string"
)


def rows_of(c: Command | None, text: str) -> Iterator[dict]:
    """A row for each part; a text that is not understood gives one of kind "unknown", never none."""
    parts = (c.parts if c.kind == "compound" else (c,)) if c else (Command("unknown", text=text),)
    for k, p in enumerate(parts):
        anchor = {"kind": p.anchor[0], "words": p.anchor[1]} if p.anchor else None
        yield {
            "part": k, "kind": p.kind, "at": L.show(p.at), "to": L.show(p.to) or None, "old": p.old or None, "new": p.new or None, "each": p.each, "at_end": p.at_end,
            "level": p.level or None, "label": p.label, "before": p.before, "anchor": anchor, "text": p.text or None,
        }


def commands(texts: DataFrame, text: str = "text", context: str | None = None) -> DataFrame:
    """texts with the fields of their commands; ``context`` names a column with the place that a frame has set, as a phrase."""
    keys = [f for f in texts.schema.fields if f.name not in (text, context)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keys] + [FIELDS])
    columns = [f.name for f in keys] + [x.strip().split(" ")[0].strip("`") for x in FIELDS.replace("kind:string,words:string", "").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                place = L.parse(row[context] or "") if context else None
                own = {f.name: row[f.name] for f in keys}
                out += [own | r for r in rows_of(recognise(row[text] or "", place or L.EMPTY), row[text] or "")]
            yield pd.DataFrame(out, columns=columns)

    return texts.mapInPandas(run, schema)
