"""What a language model has answered, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_block(text: Column) -> Column:
    """The JSON object in an answer: all from the first brace to the last, else the text
    without the fences of a code block and outer white space. Null stays null."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    bare = F.regexp_replace(F.regexp_replace(text, r"(?m)^\s*```(?:json)?|```\s*$", ""), r"^\s+|\s+$", "")
    return F.when(found != "", found).otherwise(bare)


def reply(text: Column, schema: str) -> Column:
    """The object in an answer as a struct; null where that is no JSON object."""
    block = json_block(text)
    alone = F.try_parse_json(F.concat(F.lit("["), block, F.lit("]")))  # the parser stops after a value: in a list nothing may follow it
    whole = alone.isNotNull() & block.startswith("{") & F.try_variant_get(alone, "$[1]", "variant").isNull()
    return F.when(whole, F.from_json(block, schema))
