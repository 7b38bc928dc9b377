"""Sequential folds over one key's rows, for chains that are not acts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

from lexloom.functions import locator as L
from lexloom.plans.apply import apply_all
from lexloom.plans.model import Command, Law, Norm, Paragraph


def append_in_order(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, folded, paragraphs): each row's text appended to a norm as its next paragraph, by the patch operators."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [re.sub(r"[ \t\n]+", " ", t or "").strip() for t in pdf.sort_values(order, kind="stable")[text]]
        law = Law("", "", norms=[Norm("§ 1", None, [Paragraph("1", texts[0])])])
        at = (L.Part(L.NORM, "1", "§"),)
        commands = [Command("append", at, level=L.PARA, label=str(k), text=t) for k, t in enumerate(texts[1:], 2)]
        new, _ = apply_all(law, commands)
        paragraphs = new.norms[0].paragraphs
        return pd.DataFrame({key: [pdf[key].iloc[0]], "folded": ["\n".join(p.whole() for p in paragraphs)], "paragraphs": [len(paragraphs)]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, order, text).groupBy(key).applyInPandas(fold, f"{key} {kind}, folded string, paragraphs int")
