"""Tolerant reading of model replies: fenced or bare JSON objects, and lines of JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verso.functions.text import strip

_STRICT = {"allowSingleQuotes": "false", "allowUnquotedFieldNames": "false"}
CHARACTERS = "struct<characters:map<string,struct<name:string,details:string,bio:string>>>"
MAPPING = "map<string,struct<voice:string,speed:string>>"


def json_body(reply: Column) -> Column:
    """The JSON object of a reply: inside the outermost fences if there are two, from the first { to the last }."""
    text = strip(reply)
    fenced = F.regexp_extract(text, r"(?s)```[^\n]*\n(.*)```", 1)
    inner = F.when(fenced != "", fenced).otherwise(text)
    return F.regexp_extract(inner, r"(?s)(\{.*\})", 1)


def parse_characters(reply: Column) -> Column:
    """Map of character id to name and details; empty for an empty or broken reply."""
    found = F.from_json(json_body(reply), CHARACTERS, _STRICT)["characters"]
    return F.coalesce(found, F.from_json(F.lit("{}"), "map<string,struct<name:string,details:string,bio:string>>"))


def parse_groups(reply: Column) -> Column:
    """Groups of ids, as arrays; empty for an empty or broken reply."""
    return F.coalesce(F.from_json(json_body(reply), "struct<groups:array<array<string>>>", _STRICT)["groups"], F.array().cast("array<array<string>>"))


def parse_person(reply: Column) -> Column:
    """Struct of name and bio; null for an empty or broken reply."""
    return F.from_json(json_body(reply), "struct<name:string,bio:string>", _STRICT)


def parse_strict(reply: Column, schema: str) -> Column:
    """The object of a reply; a reply without one, or a broken one, is an error."""
    body = json_body(reply)
    return F.when(body == "", F.raise_error(F.lit("no JSON object in the reply"))).otherwise(F.from_json(body, schema, _STRICT | {"mode": "FAILFAST"}))


def parse_mapping(reply: Column) -> Column:
    return F.coalesce(F.from_json(json_body(reply), MAPPING, _STRICT), F.from_json(F.lit("{}"), MAPPING))


def jsonl_lines(reply: Column) -> Column:
    """Lines that look like JSON objects; a leading fence is dropped."""
    text = strip(reply)
    text = F.when(text.startswith("```"), F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n?", ""), r"\n\s*```$", "")).otherwise(text)
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s.startswith("{") & s.endswith("}"))


def script_line(line: Column) -> Column:
    """Struct (speaker, text) of a line: speaker_id and text, else speaker and text, else the first pair; null if it doesn't parse."""
    m = F.from_json(line, "map<string,string>", _STRICT)
    has = lambda k: F.map_contains_key(m, k)
    named = lambda k: F.struct(F.element_at(m, F.lit(k)).alias("speaker"), F.element_at(m, F.lit("text")).alias("text"))
    first = F.struct(F.get(F.map_keys(m), F.lit(0)).alias("speaker"), F.get(F.map_values(m), F.lit(0)).alias("text"))
    return F.when(m.isNull() | (F.size(m) == 0), F.lit(None)).when(has("speaker_id") & has("text"), named("speaker_id")).when(has("speaker") & has("text"), named("speaker")).otherwise(first)


def parse_script(reply: Column) -> Column:
    """Array of (speaker, text) of all lines that parse, in order."""
    return F.filter(F.transform(jsonl_lines(reply), script_line), lambda x: x.isNotNull())
