"""Declared schemas of the engine's tables (never inferred from files).

Each constant is a Spark DDL string, ready for ``read.schema`` and ``createDataFrame``.
"""

from __future__ import annotations

MESSAGE = "struct<role:string,content:string>"
EXTRA_INFO = (
    "struct<index:bigint,is_subproblem:boolean,parent_source_id:string,parent_question:string,"
    "subproblem_q:double,subproblem_key:string,minimal_plan:string,q_help:double,"
    "no_help_probability:double,random_plan_probability:double,student_aware_stage:string,"
    "selected_candidate_id:string,selected_dimension:string,q_no:double,q_random:double,"
    "relevance_score:double,p_sub:double,contrast_score:double,final_score:double>"
)


PROBLEMS = (
    f"id string, question string, prompt array<{MESSAGE}>, "
    "reward_model struct<ground_truth:string,style:string>, data_source string, "
    f"extra_info {EXTRA_INFO}, knowledge_components_parts array<string>, "
    "planning_skeleton_parts array<string>, solution_breakdown_parts array<string>, "
    "solution string, model_think string, model_answer string, accuracy double, log_pos bigint"
)
TOY_PROBLEMS = (
    "id string, question string, answer string, "
    "hints struct<knowledge:string,planning:string,solution:string>"
)
ARMS = (
    "id string, arm_name string, arm_kind string, arm_strength double, selected_parts int, "
    "total_parts int, hint string, arm_order int"
)
ROLLOUTS = (
    "id string, source_id string, question string, reference string, arm_name string, "
    "arm_kind string, arm_strength double, arm_order int, selected_parts int, total_parts int, "
    "sample_index bigint, correct boolean, input_tokens bigint, hint_tokens bigint, "
    "output_tokens bigint, hit_max_new_tokens boolean, latency_seconds double, text string, "
    "log_pos bigint"
)
ITEM_FRONTIERS = (
    "id string, question string, reference string, no_hint_p double, utility_choice string, "
    "threshold_choice string, band_choice string, "
    "arms array<struct<arm_order:int,arm_name:string,kind:string,strength:double,"
    "p_correct:double,pass_at_k:boolean,hint_tokens:double,total_tokens:double,utility:double>>"
)
VARIANT_ROLLOUTS = (
    "id string, source_id string, question string, reference string, sample_index bigint, "
    "variant string, correct boolean, external_information_tokens bigint, "
    "total_generated_tokens bigint, input_tokens bigint, output_tokens bigint, "
    "latency_seconds double, text string, verification_question string, tentative_state string, "
    "oracle_answer string, query_output_tokens bigint, oracle_output_tokens bigint, "
    "previous_correct boolean, log_pos bigint"
)
ACTION_ROLLOUTS = (
    "id string, source_id string, question string, reference string, sample_index bigint, "
    "variant string, action string, invalid_action boolean, hint_tokens bigint, "
    "correct boolean, output_tokens bigint, text string, log_pos bigint"
)
CANDIDATES = (
    "id string, root_id string, dimension string, source_id string, question string, "
    "reference string, subproblem string, subproblem_answer string, relation string, "
    "source_step string, verification string, generator_model string, finish_reason string, "
    "usage map<string,bigint>, log_pos bigint"
)
CANDIDATE_ERRORS = (
    "id string, source_id string, question string, dimensions array<string>, error string, "
    "terminal boolean, generator_model string"
)
HELP_RESULTS = (
    "root_id string, candidate_id string, variant string, sample_index int, question string, "
    "reference string, correct boolean, output_tokens bigint, text string, log_pos bigint"
)
SUBPROBLEM_RESULTS = (
    "candidate_id string, root_id string, dimension string, sample_index int, subproblem string, "
    "reference string, correct boolean, text string, log_pos bigint"
)
TRAINING_CANDIDATES = (
    "id string, root_id string, dimension string, source_id string, question string, "
    "reference string, subproblem string, subproblem_answer string, relation string, "
    "source_step string, minimal_plan string, success_probability double, "
    "no_help_probability double, random_plan_probability double, gain_over_no_help double, "
    "gain_over_random double, trainable boolean, log_pos bigint"
)
ROOT_STATES = (
    "id string, question string, answer string, root_rewards array<double>, "
    "subproblems array<struct<id:string,question:string,answer:string,rewards:array<double>,"
    "depth:int,parent_id:string>>, "
    "scaffolds array<struct<name:string,rewards:array<double>,hint_tokens:bigint,"
    "strength:double,kind:string,text:string>>, consecutive_unguided_mastery int"
)
CURRICULUM = (
    "root_id string, question_key string, phase string, reason string, root_success double, "
    "informative_probability double, selected_scaffold string, "
    "selected_scaffold_success double, active_subproblem_ids array<string>, "
    "unresolved_subproblem_ids array<string>, prerequisite_mastery double, "
    "diagnostics map<string,string>"
)
LEARNABILITY = (
    "root_id string, candidate_id string, dimension string, p_sub double, "
    "contrast_score double, num_samples bigint, correct_samples bigint, log_pos bigint"
)
SHARD_MANIFESTS = ("shard_index int, root_id string, position bigint")
LOGPROBS = (
    "id string, target array<double>, behavior array<double>, response_mask array<int>, "
    "advantages array<double>, off_context boolean"
)
