"""Table functions for SQL: parsers that make rows of a text, for lateral joins."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from clausegrid.operators.parsing import FORM_HEADING, FORM_SECTIONS


@udtf(returnType="section int, title string, clause_type string, text string")
class FormSections:
    """The sections of a form's text, as parsing.form_sections() gives them; a null text has none."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        opened, lines = 0, []
        for line in filter(None, (x.strip(" \t\n\r\f\v") for x in re.split(r"\r\n|\n|\r", text or ""))):
            found = re.match(FORM_HEADING, line)
            if found and int(found[1]) == opened + 1 <= len(FORM_SECTIONS):
                yield from self._section(opened, lines)
                opened, lines = opened + 1, []
            lines.append(line)
        yield from self._section(opened, lines)

    def _section(self, section: int, lines: list[str]) -> Iterator[tuple]:
        if lines:
            title, kind = FORM_SECTIONS[section - 1] if section else ("preamble", "standard_boilerplate")
            yield section, title, kind, " ".join(lines)


@udtf(returnType="n int, sentence string")
class Sentences:
    """The sentences of a text, from 1; a null text has none."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        yield from enumerate(filter(None, re.split(r"(?<=[.!?])\s+", text or "")), 1)


def registered(spark: SparkSession) -> SparkSession:
    """The session, in whose SQL form_sections(text) and sentences(text) can stand after LATERAL."""
    spark.udtf.register("form_sections", FormSections)
    spark.udtf.register("sentences", Sentences)
    return spark
