"""Spark types of the entities, as DDL."""

RULE = "rule_id string, theme string, description string, purpose string, criteria string, anchor variant, has_anchor boolean, rule_pos int"
CLAIM = "claim_id int, rule_id string, claim_type string, claim_ord int, anchor string"
TRANSCRIPT = "transcript_id string, title string, transcript string, dataset_role string"
EXPECTED = "array<struct<disclaimer_id:string,claim_type:string,anchor:string,label:string>>"
HOLDOUT = f"{TRANSCRIPT}, expected_labels {EXPECTED}"
TRAINING_ROW = (
    "disclaimer_id string, anchor string, prompt_index string, dialogue string, type string, sample_weight string, "
    "scenario string, scenario_name string, source_prompt string, source_batch_size int, kept_after_filter int, supervisor_score int"
)
