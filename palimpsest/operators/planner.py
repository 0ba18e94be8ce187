"""Section maps and edit plans by a callback that answers messages, such as a language model.

`ask` takes the messages of one conversation ([{"role", "content"}, ..]) and returns the answer's text.
It runs on the executors, so it must be picklable; a task that is run again asks again. A request
holds one batch of one pair, so its size is bounded whatever the table's. Without a callback the
deterministic alignment and patches of `plans.revise` are used."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.json_text import parsed
from palimpsest.operators.align import batches, insert_anchors

Ask = Callable[[list[dict]], str]

#: Sections in a request for a map, and characters of a section that it shows.
MAP_BATCH, MAP_PREVIEW = 30, 200
END = "(end)"


class Unreadable(ValueError):
    """An answer that held no JSON list, twice."""


def _listed(raw: str) -> list[dict] | None:
    value = parsed(raw)
    found = None if value is None else json.loads(value)
    return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else None


def answered(ask: Ask, request: str, again: Callable[[Exception], None] | None = None) -> list[dict]:
    """The list of objects in the answer to a request. An answer without one is sent back with a
    demand for JSON, once. Errors of the second call count as no answer only if `again` says so."""
    messages = [{"role": "user", "content": request}]
    raw = ask(messages)
    found = _listed(raw)
    if found is not None:
        return found
    demand = "That was not a valid JSON list. Answer with the JSON list alone: no other text, no fences."
    try:
        found = _listed(ask([*messages, {"role": "assistant", "content": raw}, {"role": "user", "content": demand}]))
    except Exception as e:
        if again is None:
            raise
        again(e)
        return []
    if found is None:
        error = Unreadable("no JSON list in either answer")
        if again is None:
            raise error
        again(error)
        return []
    return found


def section_map(source: DataFrame, base: DataFrame, ask: Ask) -> DataFrame:
    """(pair_id, source_idx, heading, base_idx, action) for what `ask` maps, in the answers' order
    `ord`; from sections (pair_id, sec_idx, heading, content).

    A request shows up to MAP_BATCH sections and all headings of the base. Answers are objects with
    source_heading, base_heading (or null) and action. The n-th answer of a heading means the n-th
    section of that heading; one too many means no section (null). A base heading that doesn't exist
    counts as null; of equal ones the last is meant. An unreadable answer fails the job."""
    nth = F.row_number().over(Window.partitionBy("pair_id").orderBy("sec_idx"))
    shown = F.struct("sec_idx", "heading", F.substring("content", 1, MAP_PREVIEW).alias("preview"))
    dealt = source.withColumn("batch", F.floor((nth - 1) / MAP_BATCH).cast("int"))
    asked = dealt.groupBy("pair_id", "batch").agg(F.array_sort(F.collect_list(shown)).alias("sections"))
    there = base.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("sec_idx", "heading"))).alias("base"))
    requests = asked.join(there, "pair_id", "left").select("pair_id", "batch", F.to_json("sections").alias("sections"), F.to_json(F.col("base.heading")).alias("base"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                mine = [{"heading": x["heading"], "preview": x.get("preview", "")} for x in json.loads(r.sections)]
                request = json.dumps({"sections": mine, "base_headings": json.loads(r.base or "[]")}, ensure_ascii=False)
                for i, x in enumerate(answered(ask, request)):
                    rows.append((r.pair_id, r.batch, i, x["source_heading"], x.get("base_heading"), x["action"]))
            yield pd.DataFrame(rows, columns=["pair_id", "batch", "nth", "heading", "base_heading", "action"])

    said = requests.mapInPandas(run, "pair_id long, batch int, nth int, heading string, base_heading string, action string")
    order = Window.partitionBy("pair_id").orderBy("batch", "nth")
    said = said.withColumn("ord", F.row_number().over(order)).withColumn("_of", F.row_number().over(Window.partitionBy("pair_id", "heading").orderBy("batch", "nth")))
    mine = source.select("pair_id", F.col("sec_idx").alias("source_idx"), "heading")
    mine = mine.withColumn("_of", F.row_number().over(Window.partitionBy("pair_id", "heading").orderBy("source_idx")))
    known = base.groupBy("pair_id", F.col("heading").alias("base_heading")).agg(F.max("sec_idx").alias("base_idx"))
    out = said.join(mine, ["pair_id", "heading", "_of"], "left").join(known, ["pair_id", "base_heading"], "left")
    return out.select("pair_id", "ord", "source_idx", "heading", "base_idx", "action")


def bullet_loss(content: Column, generated: Column, kind: Column) -> tuple[Column, Column, Column]:
    """Bulleted lines of a section, list paragraphs generated for it, and whether these are fewer
    than half: a warning, unless the section is deleted or nothing was generated."""
    wanted = F.regexp_count(content, F.lit("(?m)" + T.BULLET_MARK))
    made = (F.length(generated) - F.length(F.replace(generated, F.lit("ListBullet"), F.lit("")))) / len("ListBullet")
    lost = (kind != "delete") & (generated != "") & (wanted > 0) & (made < wanted * 0.5)
    return wanted, made.cast("int"), F.coalesce(lost, F.lit(False))


def in_order(results: DataFrame, group: str) -> DataFrame:
    """Results of batches (group, batch, nth, ..) with their place `ord` in the whole, as if the
    batches had been worked through one after the other."""
    return results.withColumn("ord", F.row_number().over(Window.partitionBy(group).orderBy("batch", "nth")))


def _error_of(fragment: str) -> str | None:
    """What is wrong with a run of elements, prefixes taken as declared; None if nothing is."""
    try:
        ElementTree.fromstring(f'<x xmlns:w="w" xmlns:r="r" xmlns:a="a" xmlns:wp="wp" xmlns:pic="pic">{fragment}</x>')
    except ElementTree.ParseError as e:
        return str(e)
    return None


def _mended(ask: Ask, entry: dict | None, fragment: str, error: str) -> str | None:
    """A well-formed fragment in place of a broken one, asked for once; None if there is none."""
    if entry is None:
        return None
    demand = {"section": entry, "broken": fragment, "error": error}
    try:
        found = answered(ask, json.dumps(demand, ensure_ascii=False), again=lambda e: None)
    except Exception:
        return None
    content = next((str(x["content"]) for x in found if x.get("content")), None)
    return content if content is not None and _error_of(content) is None else None


def edit_plan(mapping: DataFrame, ask: Ask) -> DataFrame:
    """(pair_id, ord, kind, target, content, warning): the edits that `ask` makes of a mapping
    (pair_id, source_idx, heading, content, level, action, base_idx, base_heading, base_level).

    Unchanged sections are left out, the others go in batches of five, large ones alone. A section
    without a base one is put after the last matched one before it, else at the end. Answers are
    objects with kind ("replace" by default), target and content (a run of elements). "preserve"
    makes no edit. Broken content is sent back once and then preserved; so is a batch whose answer
    can't be read twice. Both leave a row of kind "preserve" with a warning, as does `bullet_loss`,
    whose edit stays. Edits are in the order of sections and answers, whichever batch ended first."""
    anchors = insert_anchors(mapping).select("pair_id", "source_idx", F.col("anchor").alias("_anchor"))
    needed = mapping.filter("action <> 'unchanged'").join(anchors, ["pair_id", "source_idx"], "left")
    needed = needed.withColumn("chars", F.length(F.coalesce("content", F.lit(""))))
    level = F.when((F.col("action") == "replace") & F.col("base_idx").isNotNull(), F.col("base_level")).otherwise(F.col("level"))
    content = F.coalesce("content", F.lit(""))
    entry = F.struct(
        "source_idx", F.coalesce("heading", F.lit("")).alias("heading"), content.alias("content"), "action",
        F.coalesce(F.when(F.col("base_idx").isNotNull(), F.col("base_heading")), "_anchor", F.lit(END)).alias("target"),
        level.alias("level"), T.has_bullet(content).alias("bullets"), T.has_number(content).alias("numbers"),
    )
    dealt = batches(needed, "pair_id", "source_idx", "chars")
    requests = dealt.groupBy("pair_id", "batch").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("sections"), F.max("max_tokens").alias("max_tokens"))

    def plan(sections: list[dict], max_tokens: int) -> list[tuple]:
        rows: list[tuple] = []
        failed = lambda e: rows.append(("preserve", None, None, f"batch preserved: {e}", None))
        of = {x["target"]: x for x in sections}
        for x in answered(ask, json.dumps({"sections": sections, "max_tokens": max_tokens}, ensure_ascii=False), failed):
            kind, target, made = x.get("kind", "replace"), x.get("target", ""), x.get("content") or ""
            if kind == "preserve":
                continue
            error = _error_of(made) if kind != "delete" and made else None
            if error:
                made = _mended(ask, of.get(target), made, error)
                if made is None:
                    rows.append(("preserve", target, None, f"broken content preserved: {error}", None))
                    continue
            mine = of.get(target)
            rows.append((kind, target, made, None, mine["content"] if mine and mine["bullets"] else None))
        return rows

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(r.pair_id, r.batch, i, *x) for r in pdf.itertuples() for i, x in enumerate(plan(json.loads(r.sections), int(r.max_tokens)))]
            yield pd.DataFrame(rows, columns=["pair_id", "batch", "nth", "kind", "target", "content", "warning", "wanted"])

    made = requests.mapInPandas(run, "pair_id long, batch int, nth int, kind string, target string, content string, warning string, wanted string")
    wanted, got, lost = bullet_loss(F.col("wanted"), F.col("content"), F.col("kind"))
    note = F.when(lost, F.concat(F.lit("bullet loss: "), got.cast("string"), F.lit(" of "), wanted.cast("string")))
    return in_order(made, "pair_id").select("pair_id", "ord", "kind", "target", "content", F.coalesce("warning", note).alias("warning"))
