"""Proposed edits: parsing a reply, applying replacements, differences of names and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EDITS = "struct<edits:array<struct<path:string,old_text:string,new_text:string,reason:string>>>"


def apply_edit(content: Column, old: Column, new: Column) -> Column:
    """An empty old text replaces the whole; else its first occurrence is replaced literally, if there is one."""
    at = F.instr(content, old)
    replaced = F.concat(F.substr(content, F.lit(1), at - 1), new, F.substr(content, at + F.length(old)))
    return F.when(F.coalesce(old, F.lit("")) == "", new).when(at > 0, replaced).otherwise(content)


def names_diff(before: Column, after: Column) -> Column:
    """struct(added, removed, modified) of two arrays of names; modified are those in both."""
    return F.struct(
        F.array_sort(F.array_except(after, before)).alias("added"), F.array_sort(F.array_except(before, after)).alias("removed"), F.array_sort(F.array_intersect(before, after)).alias("modified")
    )


def risk(added: Column, removed: Column, modified: Column, downstream: Column) -> Column:
    """struct(score, level, confidence) of counts."""
    score = F.least(F.lit(100), 10 * removed + 3 * modified + 2 * downstream + added)
    level = F.when(score > 50, "high").when(score > 20, "medium").otherwise("low")
    return F.struct(score.cast("long").alias("score"), level.alias("level"), F.round(F.greatest(F.lit(0.1), 1 - score / 100.0), 2).alias("confidence"))


def parse_edits(replies: DataFrame) -> DataFrame:
    """(reply_id, path, old_text, new_text, reason, warning) of replies (reply_id, text): the first fenced
    block, else from the first brace to the last; a warning where an entry or the reply is malformed."""
    fenced = F.regexp_extract("text", r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    braces = F.regexp_extract("text", r"(?s)(\{.*\})", 1)
    body = F.when(fenced != "", fenced).otherwise(braces)
    parsed = replies.select("reply_id", body.alias("body"), F.from_json(body, _EDITS, {"mode": "PERMISSIVE"}).alias("p"))
    entries = parsed.select("reply_id", F.explode_outer("p.edits").alias("e"), F.when(F.col("body") == "", "no JSON in reply").when(F.col("p.edits").isNull(), "no edits in reply").alias("w"))
    warning = F.coalesce("w", F.when(F.coalesce("e.path", F.lit("")) == "", "edit without path").when(F.col("e.new_text").isNull(), "edit without new text"))
    return entries.select("reply_id", "e.path", "e.old_text", "e.new_text", "e.reason", warning.alias("warning"))


def review(edits: DataFrame, files: DataFrame) -> DataFrame:
    """(edit_id, path, verdict, result) of edits (edit_id, path, old_text, new_text) against files (path, content)."""
    joined = edits.join(files.select("path", "content"), "path", "left")
    new = apply_edit(F.col("content"), F.col("old_text"), F.col("new_text"))
    verdict = (
        F.when(F.col("content").isNull(), "unreadable")
        .when((F.coalesce("old_text", F.lit("")) != "") & (F.instr("content", F.col("old_text")) == 0), "unanchored")
        .when(new == F.col("content"), "no-op").otherwise("applies")
    )
    return joined.select("edit_id", "path", verdict.alias("verdict"), F.when(verdict == "applies", new).alias("result"))


def overall(reviewed: DataFrame) -> DataFrame:
    """(risk, confidence, downstream): the highest level, the least confidence, and all downstream nodes of
    reviewed edits (level, confidence, downstream)."""
    rank = F.when(F.col("level") == "high", 2).when(F.col("level") == "medium", 1).otherwise(0)
    found = reviewed.agg(F.max(rank).alias("r"), F.min("confidence").alias("confidence"), F.sum("downstream").alias("downstream"))
    return found.select(F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.coalesce("r", F.lit(0)) + 1).cast("int")).alias("risk"), "confidence", "downstream")


def matches_fingerprint(edits: DataFrame, files: DataFrame) -> DataFrame:
    """(edit_id, current): whether a file still is what the edit was written against (fingerprint)."""
    own = files.select("path", F.substring(F.sha2(F.col("content").cast("string"), 256), 1, 16).alias("_now"))
    return edits.join(own, "path", "left").select("edit_id", F.coalesce(F.col("_now") == F.col("fingerprint"), F.lit(False)).alias("current"))


def until_first_failure(checked: DataFrame, order: str = "ord") -> DataFrame:
    """(edit_id, status) of edits (edit_id, current, order) applied in order: those before the first that is not
    current are applied, that one failed, and the later ones are skipped."""
    first = checked.filter(~F.col("current")).agg(F.min(order).alias("_first"))
    status = F.when(F.col("_first").isNull() | (F.col(order) < F.col("_first")), "applied").when(F.col(order) == F.col("_first"), "failed").otherwise("skipped")
    return checked.crossJoin(F.broadcast(first)).select("edit_id", status.alias("status"))
