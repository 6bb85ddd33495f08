"""Target schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql.types import StructType

SPAN = "array<struct<start:bigint,end:bigint>>"

_DDL = {
    "notes": "subject_id bigint, hadm_id bigint, note_id string, note_type string, note_subtype string, text string",
    "note_events": "ROW_ID bigint, SUBJECT_ID bigint, HADM_ID bigint, CHARTDATE string, CHARTTIME string, STORETIME string, CATEGORY string, DESCRIPTION string, CGID string, ISERROR string, TEXT string",
    "admission_codes": "hadm_id bigint, code_type string, codes array<string>",
    "code_events_9": "HADM_ID bigint, ICD9_CODE string",
    "code_events": "subject_id bigint, hadm_id bigint, icd_code string, icd_version int",
    "code_titles": "ICD9_CODE string, SHORT_TITLE string, LONG_TITLE string",
    "annotations": f"hadm_id bigint, note_id string, code_type string, code string, spans {SPAN}",
    "example": f"aid string, note string, note_type string, targets array<string>, evidence_spans array<struct<code:string,locations:{SPAN}>>",
    "code": "id string, name string, root string, kind string, parent_id string, description string, min string, max string, assignable boolean, etiology boolean, manifestation boolean, notes array<string>, includes array<string>, inclusion_term array<string>, excludes1 array<string>, excludes2 array<string>, use_additional_code array<string>, code_first array<string>, code_also array<string>",
    "code_closure": "ancestor string, descendant string, depth int",
    "term": "id string, lead_id string, parent_id string, title string, path string, code string, manifestation_code string, see string, see_also string, assignable boolean, optional_modifiers array<string>",
    "guideline": "id string, number string, title string, content string",
    "segment": "note_id string, seg_no int, text string, start int, end int",
    "hit": "query_id string, model string, rank int, id string, score double",
    "prediction": "aid string, stage string, output array<string>, targets array<string>, subset_targets array<string>",
    "split": "hadm_id bigint, split string",
    "concepts": "concept_code string, concept_name string, vocabulary_id string, invalid_reason string",
    "lexicon": ", ".join(f"{c} string" for c in "CUI LAT TS LUI STT SUI ISPREF AUI SAUI SCUI SDUI SAB TTY CODE STR SRL SUPPRESS CVF".split()),
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(_DDL[name])
