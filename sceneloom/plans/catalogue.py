"""The catalogue of integrity rules over the tables, as data.

A row rule is a condition that must be true of every row (null counts as not true). It is written once, in a notation
with a few functions marked ``#`` that the two engines spell differently; all row rules of a table are one pass over it.
Names say what is held, type is that of ``operators.rules``.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.text import SPACE
from ..operators import rules
from .base import *

_ID = {"master_segments": "segment_id", "sft_pairs": "segment_id", "partition_atoms": "atom_id", "scenes": "scene_id", "source_annotations": "issue_id", "eval_scenes": "case_id", "documents": "doc_id", "works": "work_id", "lineitem": "l_orderkey"}

_HASH = "#has({0}, #re'^[0-9a-f]{{64}}$')"
_SPLIT = "#lower({0}) in ('train', 'validation', 'val', 'dev', 'test')"
_PATH = "#has({0}, #re'^(/t:[A-Za-z]+(\\[[0-9]+\\])?)+$')"
_HAN = "#has({0}, #re'[\\x{{3400}}-\\x{{9fff}}]')"
_FULL = "#has({0}, #re'[^ \\t\\r\\n]')"
_BODY = "concat('Form: ', {0}.form_de, chr(10), 'Ausgangslage: ', {0}.situation_de, chr(10), 'Ablauf: ', #join({0}.beats_de, ' '))"


def _rows(table: str, text: str) -> list[tuple[str, str, str, str]]:
    """(table, name, type, condition) of lines ``name | type | condition``; {HASH col} and the like are the forms above."""
    forms = {"HASH": _HASH, "SPLIT": _SPLIT, "PATH": _PATH, "HAN": _HAN, "FULL": _FULL, "BODY": _BODY}
    out = []
    for line in filter(None, map(str.strip, text.splitlines())):
        name, kind, condition = (x.strip() for x in line.split(" | ", 2))
        out.append((table, name, kind, re.sub(r"\{(\w+) ([\w.]+)\}", lambda m: forms[m[1]].format(m[2]), condition)))
    return out


ROW_RULES = [
    *_rows(
        "master_segments",
        """
        segments_have_ids | constant | segment_id is not null
        segments_have_scenes | constant | scene_id is not null
        segments_have_groups | constant | scene_group_id is not null
        segments_have_works | constant | work_id is not null
        segments_have_splits | constant | split is not null
        known_splits | constant | split in ('train', 'validation', 'test')
        splits_in_known_spellings | constant | split is null or {SPLIT split}
        targets_present | constant | {FULL target_text}
        target_hashes | derived | target_text_sha256 is not distinct from #sha(target_text)
        target_hashes_well_formed | pattern | {HASH target_text_sha256}
        source_hashes_well_formed | pattern | {HASH source_sha256}
        character_counts | derived | character_count is not distinct from length(target_text)
        word_counts | derived | word_count is not distinct from #words(target_text)
        word_counts_positive | constant | word_count > 0
        no_model_token_counts | constant | token_count is null
        counting_method_stated | constant | word_count_method = 'whitespace_delimited'
        no_verse_numbers | constant | source_verse_number_status = 'absent_in_source'
        no_verse_numbers_made_up | constant | source_verse_numbers is null
        segments_have_events | constant | #size(event_ids) > 0
        segment_events_distinct | unique | #size(#distinct(event_ids)) = #size(event_ids)
        segments_have_atoms | constant | #size(atom_ids) > 0
        segment_atoms_distinct | unique | #size(#distinct(atom_ids)) = #size(atom_ids)
        segments_have_source_atoms | constant | #size(source_atom_ids) > 0
        segment_source_atoms_distinct | unique | #size(#distinct(source_atom_ids)) = #size(source_atom_ids)
        no_more_source_atoms_than_atoms | derived | #size(source_atom_ids) <= #size(atom_ids)
        no_more_atoms_than_events | derived | #size(atom_ids) <= #size(event_ids)
        segment_speakers_listed | constant | speakers is not null
        segment_speakers_distinct | unique | #size(#distinct(speakers)) = #size(speakers)
        verse_counts_not_negative | constant | verse_element_count >= 0
        prose_counts_not_negative | constant | prose_element_count >= 0
        segments_hold_spoken_text | constant | verse_element_count + prose_element_count > 0
        element_counts_within_events | derived | verse_element_count + prose_element_count <= #size(event_ids)
        future_context_for_reference_only | constant | context_after_is_reference_only
        tasks_known | constant | recommended_task in ('description_to_original', 'continuation_or_description')
        tasks_follow_continuation | derived | (recommended_task = 'continuation_or_description') = continues_source_speech
        no_segment_before_itself | reference | previous_segment_id is null or previous_segment_id <> segment_id
        no_segment_behind_itself | reference | next_segment_id is null or next_segment_id <> segment_id
        neighbours_differ | reference | previous_segment_id is null or next_segment_id is null or previous_segment_id <> next_segment_id
        boundaries_reviewed | constant | semantic_review_status = 'reviewed'
        boundary_reasons_given | constant | {FULL boundary_after_reason_zh}
        boundary_reasons_in_chinese | pattern | {HAN boundary_after_reason_zh}
        scene_notes_given | constant | {FULL scene_review_note_zh}
        start_paths_well_formed | pattern | {PATH source_xpath_start}
        end_paths_well_formed | pattern | {PATH source_xpath_end}
        segment_ids_name_their_scene | derived | #starts(segment_id, scene_id)
        scene_ids_name_their_work | derived | #starts(scene_id, work_id)
        segmentation_method_stated | constant | segmentation_method = 'source_anchored_boundaries'
        no_replacement_characters | pattern | not contains(target_text, #re'�')
        no_single_carriage_returns | pattern | not #has(target_text, #re'\\r([^\\n]|$)')
        segments_have_delivery_times | constant | delivered_at is not null
        issue_lists_present | constant | source_issue_ids is not null
        chinese_titles_in_chinese | pattern | scene_title_zh is null or {HAN scene_title_zh}
        """,
    ),
    *_rows(
        "sft_pairs",
        """
        pairs_have_ids | constant | segment_id is not null
        pairs_have_groups | constant | scene_group_id is not null
        pair_splits_known | constant | split is null or {SPLIT split}
        schema_version_known | constant | schema_version = '1.0'
        release_ids_well_formed | pattern | #has(release_id, #re'^[a-z]+(-[a-z]+)*-[0-9]+[.][0-9]+[.][0-9]+$')
        instructions_present | constant | {FULL instruction_de}
        pair_targets_present | constant | {FULL target_text}
        pair_target_hashes | derived | target_text_sha256 is not distinct from #sha(target_text)
        instruction_hashes | derived | instruction_sha256 is not distinct from #sha(instruction_de)
        pair_source_hashes_well_formed | pattern | {HASH source.source_sha256}
        no_han_in_instructions | pattern | not {HAN instruction_de}
        descriptions_have_han | pattern | {HAN description_zh}
        beats_count | constant | #size(scene_specification.beats_de) between 3 and 9
        beats_filled | constant | not contains(concat('|', #join(scene_specification.beats_de, '|'), '|'), '||')
        end_state_is_last_beat | derived | scene_specification.ending_state_de = #last(scene_specification.beats_de)
        specification_of_the_segment | reference | scene_specification.segment_id = segment_id
        specification_split_same | derived | scene_specification.split is not distinct from split
        specification_description_same | derived | scene_specification.description_zh is not distinct from description_zh
        forms_given | constant | {FULL scene_specification.form_de}
        situations_given | constant | {FULL scene_specification.situation_de}
        instructions_have_bodies | pattern | instr(instruction_de, concat(chr(10), chr(10))) > 0
        bodies_of_allowed_fields_only | derived | substr(instruction_de, instr(instruction_de, concat(chr(10), chr(10))) + 2) = {BODY scene_specification}
        no_ids_in_prompts | pattern | not contains(instruction_de, segment_id)
        no_markup_in_prompts | pattern | not contains(instruction_de, '<TEI') and not contains(instruction_de, '<sp')
        no_targets_in_prompts | leakage | not contains(instruction_de, target_text)
        no_style_requests | pattern | not #has(#lower(instruction_de), #re'stilanalyse|knittelvers|kreuzreim|imitier')
        no_notes_in_prompts | leakage | not contains(instruction_de, scene_specification.scope_zh)
        pairs_have_events | constant | #size(source.event_ids) > 0
        pair_events_distinct | unique | #size(#distinct(source.event_ids)) = #size(source.event_ids)
        pair_start_paths_well_formed | pattern | {PATH source.source_xpath_start}
        pair_end_paths_well_formed | pattern | {PATH source.source_xpath_end}
        no_review_claimed | constant | not quality.independent_human_review
        originals_unchanged | constant | quality.original_target_unchanged
        annotations_reviewed | constant | quality.annotation_review = 'self_review_complete'
        text_basis_stated | constant | quality.text_basis = 'tei_reviewed'
        pair_ids_name_their_scene | derived | #starts(segment_id, scene_id)
        scopes_stated | constant | {FULL scene_specification.scope_zh}
        """,
    ),
    *_rows(
        "partition_atoms",
        """
        atoms_have_ids | constant | atom_id is not null
        atoms_have_segments | constant | segment_id is not null
        atoms_have_scenes | constant | scene_id is not null
        atoms_have_events | constant | #size(event_ids) > 0
        atom_events_distinct | unique | #size(#distinct(event_ids)) = #size(event_ids)
        atom_kinds_known | constant | source_kind in ('speech', 'p', 'lg', 'stage')
        slices_marked | derived | is_source_atom_slice = (atom_id <> source_atom_id)
        slice_ids_well_formed | pattern | atom_id = source_atom_id or #has(atom_id, #re'_e[0-9]{4}-[0-9]{4}$')
        atom_ids_name_their_source | derived | #starts(atom_id, source_atom_id)
        source_atom_ids_name_their_scene | derived | #starts(source_atom_id, scene_id)
        atom_texts_present | constant | {FULL text}
        atom_splits_known | constant | split is null or {SPLIT split}
        atom_speakers_listed | constant | effective_speakers is not null
        atom_paths_well_formed | pattern | {PATH source_xpath}
        first_events_name_their_atom | derived | #starts(#first(event_ids), source_atom_id)
        """,
    ),
    *_rows(
        "scenes",
        """
        scenes_have_groups | constant | scene_group_id is not null
        scenes_numbered_from_one | constant | scene_index > 0
        scene_titles_present | constant | {FULL title}
        scene_titles_in_chinese | pattern | {HAN title_zh}
        scenes_have_hierarchies | constant | #size(hierarchy) > 0
        scenes_name_their_work | derived | #starts(scene_id, work_id)
        groups_name_their_work | derived | #starts(scene_group_id, work_id)
        scene_splits_known | constant | {SPLIT split}
        scene_paths_well_formed | pattern | {PATH source_xpath}
        """,
    ),
    *_rows(
        "source_annotations",
        """
        issues_resolved | constant | {FULL resolution_zh}
        issues_reviewed | pattern | #starts(status, 'reviewed')
        issue_kinds_present | constant | {FULL kind}
        issues_point_somewhere | reference | source_atom_id is not null or #size(affected_event_ids) > 0
        issue_events_within_atom | derived | affected_event_ids is null or #starts(#first(affected_event_ids), source_atom_id)
        """,
    ),
    *_rows(
        "eval_scenes",
        """
        case_sets_known | constant | eval_set in ('dev', 'holdout')
        case_instructions_present | constant | {FULL instruction_de}
        case_forms_given | constant | {FULL form_de}
        cases_fictional | constant | fictional
        cases_without_target | constant | target_text is null
        case_descriptions_have_han | pattern | {HAN description_zh}
        no_han_in_case_instructions | pattern | not {HAN instruction_de}
        """,
    ),
    *_rows(
        "documents",
        """
        texts_present | constant | {FULL text}
        document_lengths | derived | n_chars is not distinct from length(text)
        declared_sizes | derived | declared_bytes is null or declared_bytes = #bytes(text)
        languages_known | constant | lang in ('de', 'en', 'zh', 'fr')
        sources_named | constant | {FULL source}
        """,
    ),
    *_rows(
        "works",
        """
        work_titles_present | constant | {FULL title}
        work_hashes_well_formed | pattern | {HASH source_sha256}
        licences_stated | constant | #size(license_statements) > 0
        """,
    ),
    *_rows("lineitem", "positive_quantity | constant | l_quantity > 0"),
]

_WORD = f"[^{SPACE}]+".replace("{", "{{").replace("}", "}}")
_SPELLINGS = {
    "spark": {"size": "size({0})", "distinct": "array_distinct({0})", "sha": "sha2({0}, 256)", "has": "regexp_like({0})", "words": f"regexp_count({{0}}, r'{_WORD}')", "bytes": "octet_length({0})", "starts": "startswith({0})", "first": "get({0}, 0)", "last": "try_element_at({0}, -1)", "join": "array_join({0})", "lower": r"lower(regexp_replace({0}, r'^[ \t\r\n\x{{a0}}]+|[ \t\r\n\x{{a0}}]+$', ''))"},
    "duck": {"size": "len({0})", "distinct": "list_distinct({0})", "sha": "sha256({0})", "has": "regexp_matches({0})", "words": "len(regexp_extract_all({0}, '[^" + W.replace("{", "{{").replace("}", "}}") + "]+'))", "bytes": "strlen({0})", "starts": "starts_with({0})", "first": "({0})[1]", "last": "({0})[-1]", "join": "array_to_string({0})", "lower": "lower(" + TRIM + ")"},
}


def spelled(condition: str, engine: str) -> str:
    """A condition in the spelling of an engine (spark, duck)."""
    names = _SPELLINGS[engine]
    while m := re.search(r"#(\w+)\(", condition):
        if m[1] == "re":
            break
        depth, k, quoted = 1, m.end(), False
        while depth:
            c = condition[k]
            quoted ^= c == "'"
            depth += 0 if quoted else (c == "(") - (c == ")")
            k += 1
        condition = condition[: m.start()] + names[m[1]].format(condition[m.end() : k - 1]) + condition[k:]
    return condition.replace("#re'", "r'" if engine == "spark" else "'")


def row_rules(spark, root) -> list[rules.Rule]:
    """The row rules of every table, each table read once."""
    out = []
    for name, key in _ID.items():
        df = table(spark, root, name)
        mine = [(n, k, F.expr(spelled(c, "spark"))) for t, n, k, c in ROW_RULES if t == name]
        out += rules.of_rows(df, key, mine)
    return out


def sql_row_rules() -> dict[str, tuple[str, str]]:
    return {n: (k, f"SELECT {_ID[t]}::VARCHAR AS key FROM {t} WHERE NOT coalesce({spelled(c, 'duck')}, false)") for t, n, k, c in ROW_RULES}
