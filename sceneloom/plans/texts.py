"""Queries on text normalisation, scalar functions and text aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import char_count, containment, has_han, in_order, lexical_words, norm, ordered_distinct, overlap_words, prefix_suffix, sha256, strip, upper_median, word_count
from ..operators import encode
from ..operators.topk import first_rows, longest_and_median
from .base import *

_COUNT = "len(regexp_extract_all({0}, '[^" + W.replace("{", "{{").replace("}", "}}") + "]+'))"


@query(
    "flagship_document_profile",
    f"""SELECT d.doc_id, sha256({NORM.format('d.text')}) AS norm_sha256, CAST({_COUNT.format('d.text')} AS INT) AS word_count, CAST(length(d.text) AS INT) AS char_count, sha256(d.text) AS text_sha256, n AS copies
    FROM documents d LEFT JOIN (SELECT sha256(text) AS s, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1) c ON sha256(d.text) = c.s""",
)
def profile(spark, root):
    d = table(spark, root, "documents").select("doc_id", sha256(norm(F.col("text"))).alias("norm_sha256"), word_count(F.col("text")).alias("word_count"), char_count(F.col("text")).alias("char_count"), sha256(F.col("text")).alias("text_sha256"))
    copies = d.where("text_sha256 is not null").groupBy("text_sha256").agg(F.count(F.lit(1)).alias("copies"))
    return d.join(copies, "text_sha256", "left").select("doc_id", "norm_sha256", "word_count", "char_count", "text_sha256", "copies")


@query("n1_norm", f"SELECT doc_id, {NORM.format('text')} AS norm FROM documents")
def n1(spark, root):
    return table(spark, root, "documents").select("doc_id", norm(F.col("text")).alias("norm"))


@query("n2_n3_counts", f"SELECT segment_id, CAST({_COUNT.format('target_text')} AS INT) AS words, CAST(length(target_text) AS INT) AS chars FROM {sql_segments('target_text')}")
def n2(spark, root):
    return segments(spark, root, "target_text").select("segment_id", word_count(F.col("target_text")).alias("words"), char_count(F.col("target_text")).alias("chars"))


@query("n4_hashes", "SELECT segment_id, sha256(any_value(target_text)) AS sha, bool_or(sha256(target_text) IS DISTINCT FROM target_text_sha256) AS stale FROM master_segments WHERE segment_id IS NOT NULL GROUP BY 1")
def n4(spark, root):
    """The hash of every segment's text, and whether a delivery states another one."""
    s = table(spark, root, "master_segments").where("segment_id is not null").select("segment_id", "target_text_sha256", sha256(F.col("target_text")).alias("sha"))
    return s.groupBy("segment_id").agg(F.max("sha").alias("sha"), F.bool_or(~F.col("sha").eqNullSafe(F.col("target_text_sha256"))).alias("stale"))


@query("n6_lexical_words", f"SELECT doc_id, CAST(len(w) AS INT) AS words, sha256(array_to_string(w, ' ')) AS sha FROM (SELECT doc_id, {LEXICAL.format('text')} AS w FROM documents)")
def n6(spark, root):
    w = table(spark, root, "documents").select("doc_id", lexical_words(F.col("text")).alias("w"))
    return w.select("doc_id", F.when(F.col("w").isNotNull(), F.size("w")).alias("words"), sha256(F.array_join("w", " ")).alias("sha"))


@query("n7_overlap_words", f"SELECT doc_id, CAST(len(w) AS INT) AS words, sha256(array_to_string(w, ' ')) AS sha FROM (SELECT doc_id, {OVERLAP.format('text')} AS w FROM documents)")
def n7(spark, root):
    w = table(spark, root, "documents").select("doc_id", overlap_words(F.col("text")).alias("w"))
    return w.select("doc_id", F.when(F.col("w").isNotNull(), F.size("w")).alias("words"), sha256(F.array_join("w", " ")).alias("sha"))


@query("n8_han", f"SELECT segment_id, regexp_matches(instruction_de, '[\\x{{3400}}-\\x{{9fff}}]') AS in_instruction, regexp_matches(description_zh, '[\\x{{3400}}-\\x{{9fff}}]') AS in_description FROM {sql_pairs('instruction_de', 'description_zh')}")
def n8(spark, root):
    return pairs(spark, root, "instruction_de", "description_zh").select("segment_id", has_han(F.col("instruction_de")).alias("in_instruction"), has_han(F.col("description_zh")).alias("in_description"))


_WORDS_BANNED = "stilanalyse|knittelvers|kreuzreim|imitier|bühnenpassage"


@query("n9_pattern_ban", f"SELECT segment_id, regexp_matches(instruction_de, '(?i){_WORDS_BANNED}') AS hit FROM {sql_pairs('instruction_de')}")
def n9(spark, root):
    return pairs(spark, root, "instruction_de").select("segment_id", F.col("instruction_de").rlike(f"(?iu){_WORDS_BANNED}").alias("hit"))


@query(
    "n10_containment",
    f"SELECT segment_id, CASE WHEN instruction_de IS NOT NULL THEN coalesce(contains(instruction_de, target_text), false) OR contains(instruction_de, segment_id) OR contains(instruction_de, '<TEI') OR contains(instruction_de, '<sp') END AS leaks FROM {sql_pairs('instruction_de', 'target_text')}",
)
def n10(spark, root):
    p = pairs(spark, root, "instruction_de", "target_text")
    return p.select("segment_id", containment(F.col("instruction_de"), F.col("target_text"), F.col("segment_id"), F.lit("<TEI"), F.lit("<sp")).alias("leaks"))


_BODY_SQL = "'Form: ' || scene_specification.form_de || chr(10) || 'Ausgangslage: ' || scene_specification.situation_de || chr(10) || 'Ablauf: ' || array_to_string(scene_specification.beats_de, ' ')"


@query(
    "n11_template",
    f"SELECT segment_id, sha256('{encode.INTRO}' || chr(10) || chr(10) || {_BODY_SQL}) AS rendered, {_BODY_SQL} = CASE WHEN instr(instruction_de, chr(10) || chr(10)) > 0 THEN substr(instruction_de, instr(instruction_de, chr(10) || chr(10)) + 2) END AS in_step FROM {sql_pairs('instruction_de', 'scene_specification')}",
)
def n11(spark, root):
    """The instruction rebuilt from the allowed fields of the specification, and whether the delivered body is in step with it."""
    s = F.col("scene_specification")
    p = pairs(spark, root, "instruction_de", "scene_specification")
    whole = encode.instruction(s["form_de"], s["situation_de"], s["beats_de"])
    return p.select("segment_id", sha256(whole).alias("rendered"), (prefix_suffix(whole)[1] == prefix_suffix(F.col("instruction_de"))[1]).alias("in_step"))


@query("n12_training_prompt", f"SELECT segment_id, sha256('### Aufgabe' || chr(10) || instruction_de || chr(10) || chr(10) || '### Textauszug' || chr(10)) AS prompt_sha256, sha256('### Vergleichstext (nicht abschreiben)' || chr(10) || coalesce(target_text, '') || chr(10) || chr(10) || '### Aufgabe' || chr(10) || instruction_de || chr(10) || chr(10) || '### Textauszug' || chr(10)) AS with_reference FROM {sql_pairs('instruction_de', 'target_text')} WHERE {NORM.format('instruction_de')} <> ''")
def n12(spark, root):
    p = pairs(spark, root, "instruction_de", "target_text").where(strip(F.col("instruction_de")) != "")
    i = F.col("instruction_de")
    return p.select("segment_id", sha256(encode.training_prompt(i)).alias("prompt_sha256"), sha256(encode.training_prompt(i, F.coalesce("target_text", F.lit("")))).alias("with_reference"))


@query(
    "n13_prefix_suffix",
    f"SELECT prefix, count(*) AS n, CAST(sum(length(suffix)) AS BIGINT) AS chars FROM (SELECT split_part(instruction_de, chr(10) || chr(10), 1) AS prefix, CASE WHEN instr(instruction_de, chr(10) || chr(10)) > 0 THEN substr(instruction_de, instr(instruction_de, chr(10) || chr(10)) + 2) END AS suffix FROM {sql_pairs('instruction_de')}) GROUP BY 1",
)
def n13(spark, root):
    a, b = prefix_suffix(F.col("instruction_de"))
    return pairs(spark, root, "instruction_de").select(a.alias("prefix"), b.alias("suffix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("suffix")).alias("chars"))


@query(
    "n14_ordered_dedupe",
    f"""SELECT segment_id, array_to_string(list(s ORDER BY k), '|') AS speakers FROM (SELECT segment_id, s, min(k) AS k FROM (SELECT segment_id, unnest(effective_speakers) AS s, atom_id || '-' || printf('%09d', generate_subscripts(effective_speakers, 1)) AS k
    FROM {sql_atoms('atom_id', 'segment_id', 'effective_speakers')}) WHERE s IS NOT NULL GROUP BY ALL) GROUP BY segment_id""",
)
def n14(spark, root):
    a = atoms(spark, root, "atom_id", "segment_id", "effective_speakers").where("size(effective_speakers) > 0")
    return a.groupBy("segment_id").agg(F.array_join(ordered_distinct(in_order(F.col("effective_speakers"), F.col("atom_id"))), "|").alias("speakers")).where("speakers <> ''")


@query("n17_finite_guard", "SELECT event_type, count(*) AS n, sum(CASE WHEN isnan(value) OR isinf(value) THEN 1 ELSE 0 END)::BIGINT AS bad FROM events GROUP BY 1")
def n17(spark, root):
    v = F.col("value")
    return table(spark, root, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.isnan(v) | (F.abs(v) == F.lit(float("inf")))).alias("bad"))


@query("a1_length_totals", f"SELECT count(*) AS n, sum(len)::BIGINT AS total, min(len) AS least, max(len) AS most FROM (SELECT CAST(length(target_text) AS INT) AS len FROM {sql_segments('target_text')})")
def a1(spark, root):
    s = segments(spark, root, "target_text").select(F.length("target_text").alias("len"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("total"), F.min("len").alias("least"), F.max("len").alias("most"))


@query("a2_upper_median", f"SELECT split, list_sort(list(len))[len(list(len)) // 2 + 1] AS median FROM (SELECT {sql_split()} AS split, CAST(length(target_text) AS INT) AS len FROM {sql_segments('split', 'target_text')}) WHERE len IS NOT NULL GROUP BY 1")
def a2(spark, root):
    s = segments(spark, root, "split", "target_text").select(split_name(F.col("split")).alias("split"), F.length("target_text").alias("len")).where("len is not null")
    return s.groupBy("split").agg(upper_median("len").alias("median"))


@query("a3_kind_counts", f"SELECT work_id, source_kind, count(*) AS atoms, count(*) FILTER (is_source_atom_slice) AS slices FROM {sql_atoms('atom_id', 'work_id', 'source_kind', 'is_source_atom_slice')} GROUP BY 1, 2")
def a3(spark, root):
    return atoms(spark, root, "atom_id", "work_id", "source_kind", "is_source_atom_slice").groupBy("work_id", "source_kind").agg(F.count(F.lit(1)).alias("atoms"), F.count_if("is_source_atom_slice").alias("slices"))


@query("a4_distinct_counts", "SELECT count(DISTINCT segment_id) AS segments, count(DISTINCT scene_id) AS scenes, count(DISTINCT target_text_sha256) AS texts, count(DISTINCT work_id) AS works FROM master_segments")
def a4(spark, root):
    return table(spark, root, "master_segments").agg(*[F.count_distinct(c).alias(n) for c, n in (("segment_id", "segments"), ("scene_id", "scenes"), ("target_text_sha256", "texts"), ("work_id", "works"))])


@query("a5_group_splits", f"SELECT g AS scene_group_id, count(DISTINCT s) AS splits FROM (SELECT lower({TRIM.format('scene_group_id')}) AS g, {sql_split()} AS s FROM master_segments) WHERE g IS NOT NULL AND s IS NOT NULL GROUP BY 1 HAVING count(DISTINCT s) > 1")
def a5(spark, root):
    s = table(spark, root, "master_segments").select(F.lower(F.regexp_replace("scene_group_id", r"^[ \t\r\n\x{a0}]+|[ \t\r\n\x{a0}]+\z", "")).alias("scene_group_id"), split_name(F.col("split")).alias("s"))
    return s.where("scene_group_id is not null and s is not null").groupBy("scene_group_id").agg(F.count_distinct("s").alias("splits")).where("splits > 1")


@query("a6_duplicate_groups", "SELECT text_sha256, n, least FROM (SELECT sha256(text) AS text_sha256, count(*) AS n, min(doc_id) AS least FROM documents WHERE text IS NOT NULL GROUP BY 1) WHERE n > 1")
def a6(spark, root):
    d = table(spark, root, "documents").where("text is not null").select("doc_id", sha256(F.col("text")).alias("text_sha256"))
    return d.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")).where("n > 1")


@query("a7_cross_split_duplicates", f"SELECT sha256(target_text) AS sha, count(DISTINCT segment_id) AS segments, count(DISTINCT {sql_split()}) AS splits FROM sft_pairs WHERE target_text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {sql_split()}) > 1")
def a7(spark, root):
    p = table(spark, root, "sft_pairs").where("target_text is not null").select("segment_id", sha256(F.col("target_text")).alias("sha"), split_name(F.col("split")).alias("split"))
    return p.groupBy("sha").agg(F.count_distinct("segment_id").alias("segments"), F.count_distinct("split").alias("splits")).where("splits > 1")


@query("a8_ordered_text", f"SELECT segment_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY atom_id)) AS sha FROM {sql_atoms('atom_id', 'segment_id', 'text')} WHERE text IS NOT NULL GROUP BY 1")
def a8(spark, root):
    a = atoms(spark, root, "atom_id", "segment_id", "text").where("text is not null")
    return a.groupBy("segment_id").agg(sha256(F.array_join(in_order(F.col("text"), F.col("atom_id")), "\n\n")).alias("sha"))


@query("a9_ordered_arrays", f"SELECT segment_id, array_to_string(list(atom_id ORDER BY atom_id), ',') AS atom_ids, count(*) AS n FROM {sql_atoms('atom_id', 'segment_id')} GROUP BY 1")
def a9(spark, root):
    return atoms(spark, root, "atom_id", "segment_id").groupBy("segment_id").agg(F.array_join(F.array_sort(F.collect_list("atom_id")), ",").alias("atom_ids"), F.count(F.lit(1)).alias("n"))


@query("a10_nearest_length", f"SELECT work_id, segment_id FROM (SELECT work_id, segment_id, row_number() OVER (PARTITION BY work_id ORDER BY abs(length(target_text) - 1500), segment_id) AS k FROM {sql_segments('work_id', 'target_text')} WHERE target_text IS NOT NULL) WHERE k = 1")
def a10(spark, root):
    s = segments(spark, root, "work_id", "target_text").where("target_text is not null")
    return s.groupBy("work_id").agg(F.min_by("segment_id", F.struct(F.abs(F.length("target_text") - 1500), "segment_id")).alias("segment_id"))


@query("a11_last_delivery", "SELECT work_id, max(segment_id) FILTER (delivered_at = last) AS segment_id FROM (SELECT *, max(delivered_at) OVER (PARTITION BY work_id) AS last FROM master_segments) GROUP BY 1 HAVING max(last) IS NOT NULL")
def a11(spark, root):
    s = table(spark, root, "master_segments").where("delivered_at is not null")
    return s.groupBy("work_id").agg(F.max(F.struct("delivered_at", "segment_id")).alias("b")).select("work_id", "b.segment_id")


@query("a12_all_any", "SELECT work_id, bool_and(quality.original_target_unchanged) AS unchanged, bool_or(quality.independent_human_review) AS reviewed FROM sft_pairs GROUP BY 1")
def a12(spark, root):
    q = F.col("quality")
    return table(spark, root, "sft_pairs").groupBy("work_id").agg(F.bool_and(q["original_target_unchanged"]).alias("unchanged"), F.bool_or(q["independent_human_review"]).alias("reviewed"))


@query(
    "a13_conserved_totals",
    f"SELECT (SELECT sum(len(event_ids))::BIGINT FROM {sql_segments('event_ids')}) AS in_segments, (SELECT sum(len(event_ids))::BIGINT FROM {sql_atoms('atom_id', 'event_ids')}) AS in_atoms",
)
def a13(spark, root):
    """Events counted over segments and over atoms: two aggregates of one row each, put side by side."""
    s = segments(spark, root, "event_ids").agg(F.sum(F.size("event_ids")).alias("in_segments"), F.first(F.lit(1)).alias("k"))
    a = atoms(spark, root, "atom_id", "event_ids").agg(F.sum(F.size("event_ids")).alias("in_atoms"), F.first(F.lit(1)).alias("k"))
    return s.join(a, "k").select("in_segments", "in_atoms")


@query("s8_reading_copy", f"SELECT scene_id, (k // 1000)::INT AS page, sha256(string_agg('[' || segment_id || ']' || chr(10) || coalesce(target_text, ''), chr(10) ORDER BY segment_id)) AS sha FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY segment_id) - 1 AS k FROM {sql_segments('scene_id', 'target_text')}) GROUP BY 1, 2")
def s8(spark, root):
    """A reading copy of every scene, in pages of a thousand segments."""
    from ..sources.jsonl import pages

    s = segments(spark, root, "scene_id", "target_text")
    line = F.concat(F.lit("["), "segment_id", F.lit("]\n"), F.coalesce("target_text", F.lit("")))
    return pages(s, "scene_id", line, "segment_id").select("scene_id", "page", sha256(F.col("text")).alias("sha"))


@query(
    "s8_directory",
    f"""WITH t AS (SELECT scene_id, arg_max(struct_pack(title_zh, title), struct_pack(a := registered_at, b := title_zh, c := title)) AS t FROM scenes WHERE scene_id IS NOT NULL AND registered_at IS NOT NULL GROUP BY 1),
    s AS (SELECT scene_id, (k // 1000)::INT AS page, string_agg(segment_id || chr(12288) || CAST({_COUNT.format('target_text')} AS VARCHAR), chr(10) ORDER BY segment_id) AS x FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY segment_id) - 1 AS k FROM {sql_segments('scene_id', 'target_text')} WHERE scene_id IS NOT NULL) GROUP BY 1, 2)
    SELECT scene_id, page, sha256(scene_id || chr(12288) || coalesce(t.title_zh, '') || chr(12288) || coalesce(t.title, '') || chr(10) || x) AS sha FROM s JOIN t USING (scene_id)""",
)
def s8_directory(spark, root):
    """The directory of every scene: its titles, and its segments with their word counts."""
    from ..sources.jsonl import pages

    t = table(spark, root, "scenes").where("scene_id is not null and registered_at is not null").groupBy("scene_id").agg(F.max(F.struct("registered_at", "title_zh", "title")).alias("t"))
    s = segments(spark, root, "scene_id", "target_text").where("scene_id is not null")
    wide = F.lit("\u3000")
    p = pages(s, "scene_id", F.concat("segment_id", wide, word_count(F.col("target_text")).cast("string")), "segment_id").join(t, "scene_id")
    head = F.concat("scene_id", wide, F.coalesce("t.title_zh", F.lit("")), wide, F.coalesce("t.title", F.lit("")), F.lit("\n"))
    return p.select("scene_id", "page", sha256(F.concat(head, "text")).alias("sha"))


@query("s8_blind_sheet", "SELECT case_id, sha256(string_agg(chr(64 + k::INT) || ': ' || condition, chr(10) ORDER BY k)) AS sha FROM (SELECT case_id, condition, row_number() OVER (PARTITION BY case_id ORDER BY sha256('11|' || case_id || '|' || condition), condition) AS k FROM eval_scenes, (SELECT unnest(['base', 'tuned', 'human']) AS condition)) GROUP BY 1")
def s8_blind(spark, root):
    """The key sheet of a blind comparison."""
    from ..operators import joins, splits
    from ..sources.jsonl import report

    c = splits.blind_order(joins.conditions(table(spark, root, "eval_scenes"), [11], ["base", "tuned", "human"]).select("case_id", "condition"), "case_id", "condition", "11")
    return report(c, ["case_id"], F.concat("label", F.lit(": "), "condition"), "label").select("case_id", sha256(F.col("text")).alias("sha"))


@query("top_longest", f"SELECT segment_id, CAST(length(target_text) AS INT) AS chars FROM {sql_segments('target_text')} WHERE target_text IS NOT NULL ORDER BY length(target_text) DESC, segment_id LIMIT 2")
def top(spark, root):
    """The two longest texts: the limit is the feature."""
    s = segments(spark, root, "target_text").where("target_text is not null").select("segment_id", F.length("target_text").alias("chars"))
    return s.orderBy(F.desc("chars"), "segment_id").limit(2)


@query("s1_s5_jsonl_round_trip", f"SELECT segment_id, sha256(target_text) AS sha, CAST(len(event_ids) AS INT) AS events FROM {sql_segments('target_text', 'event_ids')}")
def s1(spark, root):
    """Written as JSON lines to the shared folder and read again with an explicit schema."""
    import uuid

    from ..scratch import scratch_dir
    from ..sources.jsonl import read_jsonl, write_jsonl

    path = f"{scratch_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    write_jsonl(segments(spark, root, "target_text", "event_ids"), path)
    back = read_jsonl(spark, path, "segment_id string, target_text string, event_ids array<string>")
    return back.select("segment_id", sha256(F.col("target_text")).alias("sha"), F.size("event_ids").alias("events"))


@query("top_longest_and_median", f"WITH s AS (SELECT segment_id, CAST(length(target_text) AS INT) AS chars FROM {sql_segments('target_text')} WHERE target_text IS NOT NULL), r AS (SELECT *, row_number() OVER (ORDER BY chars, segment_id) - 1 AS k, count(*) OVER () AS n FROM s) SELECT 'longest' AS pick, segment_id, chars FROM r WHERE k = n - 1 UNION ALL SELECT 'median', segment_id, chars FROM r WHERE k = n // 2")
def top_median(spark, root):
    """The longest text and the one at the upper median, by length and id: the samples of a trial run."""
    s = segments(spark, root, "target_text").where("target_text is not null").select("segment_id", F.length("target_text").alias("chars"))
    return longest_and_median(s, "chars", "segment_id")


@query("top_first_cases", "SELECT k AS asked, case_id FROM (SELECT *, row_number() OVER (ORDER BY case_id) AS n FROM eval_scenes), (SELECT unnest([0, 5]) AS k) WHERE k = 0 OR n <= k")
def top_first(spark, root):
    """The first five cases, and with zero all of them."""
    e = table(spark, root, "eval_scenes").select("case_id")
    return first_rows(e, 0, "case_id").select(F.lit(0).alias("asked"), "case_id").union(first_rows(e, 5, "case_id").select(F.lit(5), "case_id"))
