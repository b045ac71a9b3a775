"""Schemas of the trajectory tables, as DDL; every column is nullable and missing values are defaulted where they are used."""

QUESTIONS = "id string, question string, golden_answers array<string>, source string"
EVENTS = "trajectory_id string, question_id string, event_type string, timestamp double, payload string"
RESULTS = (
    "trajectory_id string, question_id string, question string, golden_answers array<string>, prediction string, position bigint, question_type string, outcome_pass boolean, answer_em double, answer_f1 double, "
    "rounds bigint, search_actions bigint, search_queries bigint, total_tokens bigint, input_tokens bigint, output_tokens bigint, termination string, answer_produced boolean, request_inputs array<bigint>, "
    "raw_canonical_exact bigint, raw_spaced_tool_call bigint, raw_tool_call_no_gt bigint, parser_bare_json_fallback bigint, parser_invalid_json bigint, parser_none bigint, action_source_mismatch bigint, malformed_wrappers bigint, "
    "retriever_http_requests bigint, retriever_failures bigint, message_continuity_edges bigint, message_continuity_failed_edges bigint, env_query_rewrite_count bigint, visit_attempts bigint, visit_executed bigint, gold_leakage boolean, state_ok boolean"
)
STAGE_ROWS = "stage string, question_id string, answer_em double, answer_f1 double, task_success boolean, search_action_count bigint, search_query_count bigint, valid_query_count bigint, repeated_query_count bigint, retrieval_success_count bigint, process_scores array<int>, trajectory_reward double, termination_reason string"
GENERATIONS = "trajectory_id string, generation_idx int, round_idx int, input_ids array<int>, generated_ids array<int>, actual_input_sha256 string, actual_generated_sha256 string, generated_length int, generation_temperature double, input_token_origins array<string>"
MESSAGES = "array<struct<role:string,content:string>>"
SFT_ROWS = f"sample_id string, question_id string, trajectory_id string, question string, messages {MESSAGES}"
PREFERENCES = f"pair_id string, prompt {MESSAGES}, chosen {MESSAGES}, rejected {MESSAGES}"
