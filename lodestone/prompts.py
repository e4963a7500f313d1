"""Prompts as Spark columns: templates in our own words, filled from columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Templates; {name} is a column. What a model must answer with is the format that ``functions.parsing`` reads.
TEMPLATES: dict[str, str] = {
    "query": "Below is a passage.\n\n{text}\n\nWrite one question that a reader would type into a search box and that this passage answers. Answer with <result><query>the question</query><keep>yes or no</keep></result>.",
    "facts": "List what the documents say about {entity}.\n\n{documents}\n\nAnswer with a <fact> for each statement, with its <statement>, its <doc_ids> and the <mentioned_entities>.",
    "hard_negatives": "Question: {question}\n\nAnswer: {answer}\n\nPassages:\n{chunks}\n\nName the passages that look relevant but don't answer, as <hard_negatives><chunk id=\"...\"/></hard_negatives>.",
    "judge": "Question: {question}\n\nAnswer to grade:\n{response}\n\nCriteria, by name:\n{criteria}\n\nAnswer with <criteria>, and in it for each criterion, in this order, a <criterion> with its <name>, a <reason> and a <verdict>, {positive} or {negative}.",
}


def render(template: str, **columns: Column) -> Column:
    """The template with columns (null: empty) in the place of their names; every name must be given, and none besides."""
    parts = re.split(r"\{(\w+)\}", template)
    if set(parts[1::2]) != set(columns):
        raise ValueError(f"the template has {sorted(set(parts[1::2]))}, given are {sorted(columns)}")
    return F.concat(*[F.coalesce(columns[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def described(prompt: Column, description: str | None) -> Column:
    """A prompt with the corpus's description below it, if it has one."""
    text = (description or "").strip()
    return F.concat(prompt, F.lit(f"\n\nAbout these documents: {text}")) if text else prompt


def with_errors(prompt: Column, errors: Column, last: int = 3) -> Column:
    """A prompt for another attempt: the last few errors, an array, are listed below it."""
    shown = F.transform(F.slice(errors, F.greatest(F.lit(1), F.size(errors) - last + 1), last), lambda e: F.concat(F.lit("\n- "), e))
    return F.when(F.size(errors) > 0, F.concat(prompt, F.lit("\n\nEarlier answers were refused:"), F.array_join(shown, ""))).otherwise(prompt)
