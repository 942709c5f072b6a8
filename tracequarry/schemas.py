"""Schemas of the entities, as DDL."""

TURN = "struct<role:string,content:string>"
PROBLEM = "id string, year int, category string, depth string, prompt string, ground_truth string, baseline_cot_tokens int, source_benchmark string"
RECEIPT = (
    "problem_id string, arm string, arm_label string, budget int, category string, depth string, year int, is_contaminated boolean, tokens_emitted int, truncated boolean, dynamic_joules double, elapsed_sec double, "
    "is_correct boolean, verification_method string, extracted_answer string, ground_truth string, extraction_method string, sandbox_outputs array<string>, generated_text string"
)
CURRICULUM = "id string, domain string, concept string, prompt string, ground_truth string, canonical_plan string, canonical_deduce string, canonical_verify string, full_target string, type string, complexity string, is_contrastive_negative boolean"
#: Every field that any consumer of a training file reads; what a file lacks is null.
TRAINING = f"id string, register string, domain string, type string, concept string, prompt string, question string, problem string, answer string, ground_truth string, expected_type string, target_intent string, cognitive_depth string, target_tokens int, full_target string, messages array<{TURN}>"
POWER = "run_id string, t double, watts double"
REPORT_ITEM = "id string, category string, year int, depth string, prompt string, ground_truth string, extracted_answer string, correct boolean, tokens_emitted int, english_baseline_tokens int, latency_seconds double, raw_output string"
REPORT = f"model string, timestamp_utc string, itemized_results array<struct<{', '.join(f'{a}:{b}' for a, b in (x.strip().split(' ') for x in REPORT_ITEM.split(',')))}>>"
ARM_RECEIPTS = "items array<struct<id:string, category:string, ground_truth:string, arms:map<string, struct<extracted:string, is_correct:boolean, tokens:int, joules:double, latency:double>>>>"
