"""Encoding of pairs with masked prompts, length reports, padding and length budgets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strip

IGNORED = -100  # Fixed value: the label that a loss leaves out.

# The prompt's headings; the stock opening of an instruction.
TASK, EXCERPT, REFERENCE = "### Aufgabe\n", "\n\n### Textauszug\n", "### Vergleichstext (nicht abschreiben)\n"
INTRO = "Schreibe einen literarischen Textausschnitt auf Deutsch nach den folgenden inhaltlichen Vorgaben. Halte die Reihenfolge der Vorgänge ein. Unterscheide ausgeführte Handlungen von Berichten, Wünschen, Träumen und Behauptungen der Figuren. Gib nur den Textausschnitt aus, ohne Erläuterung."


def instruction(form: Column, situation: Column, beats: Column, intro: str = INTRO) -> Column:
    """An instruction made of the allowed fields of a specification; null where one of them is."""
    return F.concat(F.lit(f"{intro}\n\nForm: "), form, F.lit("\nAusgangslage: "), situation, F.lit("\nAblauf: "), F.array_join(beats, " "))


def _filled(c: Column, what: str) -> Column:
    """The text as it is; null or of white space only is an error."""
    return F.when(F.coalesce(strip(c), F.lit("")) == "", F.raise_error(F.lit(f"blank {what}"))).otherwise(c)


def training_prompt(instruction: Column, reference: Column | None = None) -> Column:
    """The prompt of an instruction, taken as it is, with an optional reference before it; a blank instruction is an error."""
    task = F.concat(F.lit(TASK), _filled(instruction, "instruction"), F.lit(EXCERPT))
    if reference is not None:
        task = F.concat(F.when(reference.isNotNull(), F.concat(F.lit(REFERENCE), reference, F.lit("\n\n"))).otherwise(""), task)
    return task


def code_points(c: Column) -> Column:
    """Code points of a text, in the JVM: the simplest tokenizer."""
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), F.ascii)


def masked(prompt_ids: Column, target_ids: Column, eos: int) -> tuple[Column, Column, Column]:
    """(input_ids, attention_mask, labels): prompt and target encoded apart, an end token behind, prompt labels ignored."""
    ids = F.concat(prompt_ids, target_ids, F.array(F.lit(eos)))
    labels = F.concat(F.array_repeat(F.lit(IGNORED), F.size(prompt_ids)), target_ids, F.array(F.lit(eos)))
    return ids, F.array_repeat(F.lit(1), F.size(ids)), labels


def encoded(df: DataFrame, prompt: str, target: str, encoder: Callable[[], Callable[[str], list[int]]], eos: int) -> DataFrame:
    """segment_id, input_ids, attention_mask, labels with a tokenizer of one's own, made once a task by ``encoder``. A blank
    prompt or target is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for b in batches:
            one, two = ([encode(x) for x in b.column(k).to_pylist()] for k in (1, 2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(one, pa.list_(pa.int32())), pa.array(two, pa.list_(pa.int32()))], names=["segment_id", "a", "b"])

    rows = df.select("segment_id", _filled(F.col(prompt), "prompt").alias("p"), _filled(F.col(target), "target").alias("t"))
    ids, mask, labels = masked(F.col("a"), F.col("b"), eos)
    return rows.mapInArrow(run, "segment_id string, a array<int>, b array<int>").select("segment_id", ids.alias("input_ids"), mask.alias("attention_mask"), labels.alias("labels"))


def over_limit(df: DataFrame, limit: int) -> DataFrame:
    """segment_id, total of samples that are too long: nothing is cut off silently."""
    return df.select("segment_id", F.size("input_ids").alias("total")).where(F.col("total") > limit)


def lengths(df: DataFrame) -> DataFrame:
    """segment_id, total, prompt, completion: token counts, the end token counting to the completion."""
    done = F.size(F.filter("labels", lambda x: x != IGNORED))
    return df.select("segment_id", F.size("input_ids").alias("total"), (F.size("input_ids") - done).alias("prompt"), done.alias("completion"))


def padded(df: DataFrame, batch: str, pad: int) -> DataFrame:
    """df padded to the longest of its batch: ids with ``pad``, mask with 0, labels ignored, by position and never by id."""
    more = F.max(F.size("input_ids")).over(Window.partitionBy(batch)) - F.size("input_ids")
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.col("_more"))).alias(c)
    rows = df.withColumn("_more", more)
    return rows.select(batch, "segment_id", fill("input_ids", pad), fill("attention_mask", 0), fill("labels", IGNORED))


def budget(longest: Column, limit: int, step: int = 64) -> Column:
    """The longest length rounded up to the next step, at most the limit; above the limit an error."""
    up = F.least(F.lit(limit), (F.ceil(longest / step) * step).cast("int"))
    return F.when(longest > limit, F.raise_error(F.concat(F.lit("samples over the limit, longest "), longest.cast("string")))).otherwise(up)
