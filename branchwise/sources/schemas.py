"""Explicit schemas of the recorded entities; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


STRINGS = T.ArrayType(S)
TASK = _struct(task_id=S, game_file=S, task_type=S, split_source=S, solvable=B)
STATE = _struct(
    obs=S,
    reward=D,
    done=B,
    won=B,
    admissible_commands=STRINGS,
    facts=STRINGS,
    state_hash=S,
    expert_action=S,
    expert_status=S,
)
STEP = T.StructType(
    _struct(
        t=L,
        rendered_prompt=S,
        raw_completion=S,
        action=S,
        confidence_raw=S,
        prompt_token_ids=T.ArrayType(L),
        confidence=D,
        nothing_happens=B,
    ).fields
    + STATE.fields
)
TOKENS = T.MapType(S, L)
ROLLOUT = _struct(
    rollout_id=S,
    task_id=S,
    arm=S,
    terminal_reason=S,
    policy_seed=L,
    temperature=D,
    initial=STATE,
    steps=T.ArrayType(STEP),
    success=B,
    n_steps=L,
    tokens=TOKENS,
)
CHECKPOINT = _struct(
    checkpoint_id=S,
    rollout_id=S,
    task_id=S,
    arm=S,
    prefix_state_hash=S,
    rendered_prompt=S,
    split_paper=S,
    split_task_level=S,
    t=L,
    steps_remaining=L,
    features_26d=T.MapType(S, D),
    confidence_t=D,
    prompt_token_ids=T.ArrayType(L),
    admissible_commands=STRINGS,
    prefix_actions=STRINGS,
)
TRANSCRIPT = _struct(
    t=L,
    action=S,
    raw_completion=S,
    obs=S,
    reward=D,
    done=B,
    won=B,
    confidence=D,
    source=S,
    expert_status=S,
)
_SIDES = _struct(expected=S, actual=S)
_LISTS = _struct(only_expected=STRINGS, only_actual=STRINGS, n_expected=L, n_actual=L)
MISMATCH = _struct(
    step_index=L,
    action=S,
    diff=_struct(obs=_SIDES, reward=_SIDES, done=_SIDES, won=_SIDES, admissible_commands=_LISTS, facts=_LISTS),
)
BRANCH = _struct(
    branch_id=S,
    checkpoint_id=S,
    arm=S,
    action=S,
    terminal_reason=S,
    replicate=L,
    branch_seed=L,
    n_steps_in_branch=L,
    replay_verified=B,
    success=B,
    transcript=T.ArrayType(TRANSCRIPT),
    replay_mismatch=MISMATCH,
    tokens=TOKENS,
)
# Branch columns the derivation reads; the transcript is never parsed for it.
BRANCH_CORE = T.StructType([f for f in BRANCH.fields if f.name not in ("transcript", "replay_mismatch", "tokens")])
PROVENANCE = _struct(
    run_id=S,
    arm=S,
    config_hash=S,
    schema_version=S,
    git_sha=S,
    created_at=S,
    temperature=D,
    n_replicates=L,
    base_seed=L,
)
