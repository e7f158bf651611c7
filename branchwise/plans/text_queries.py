"""Identity, text, nested arrays, traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from branchwise.functions import ids as I
from branchwise.functions import text as X
from branchwise.functions.ordered import running_sums
from branchwise.functions.outcomes import remaining_budget
from branchwise.operators import summaries as S
from branchwise.operators import traces as T
from branchwise.plans import views
from branchwise.plans.common import tidy, tidy_sql
from branchwise.plans.views import table, with_views

STEP_FIELDS = ["obs", "reward", "done", "commands"]


def record_hashes(spark, sf):
    o = table(spark, sf, "orders")
    key, status, prio = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    return o.select(
        "o_orderkey",
        I.text_hash(prio).alias("text_hash"),
        I.stable_hash({"status": status, "key": key, "priority": prio}).alias("record_hash"),
        I.derive_seed(key, F.lit("cp")).alias("seed"),
        I.composite_id(key, status, prio).alias("record_id"),
        F.get(I.split_composite_id(I.composite_id(key, status)), F.lit(1)).alias("second_part"),
    )


def seeded_order(spark, sf):
    from branchwise.functions.ordered import hash_numbered

    c = table(spark, sf, "customer").select("c_custkey")
    return hash_numbered(c, [], 7, "c_custkey", "position")


def completion_actions(spark, sf):
    d = table(spark, sf, "documents")
    a = X.parse_action(F.col("text"))
    return d.select("doc_id", a.alias("action"), X.parse_confidence(F.col("text")).alias("confidence"))


def action_classes(spark, sf):
    d = table(spark, sf, "documents").select(X.parse_action(F.col("text")).alias("action"))
    typed = table(spark, sf, "part").select(
        F.concat_ws(" ", F.get(F.array(*[F.lit(v) for v in VERBS]), (F.col("p_size") % len(VERBS)).cast("int")), "p_name").alias("action")
    )
    both = d.unionByName(typed).withColumn("kind", X.classify_action(F.col("action")))
    return tidy(
        both.groupBy("kind").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(X.word_count(F.col("action"))).alias("words"),
            F.count_if(X.contains_marker(F.col("action"), "the")).alias("n_marked"),
        )
    )


VERBS = ("go to", "take", "move", "put", "toggle", "use", "heat", "cool", "clean", "examine", "open", "close", "look", "Go To the")


def banner_strip(spark, sf):
    d = table(spark, sf, "documents")
    banner = F.concat(F.lit("-= Welcome =-\n\n"), F.col("text"))
    return d.select("doc_id", X.strip_banner(F.col("text")).alias("plain"), X.strip_banner(banner).alias("stripped"))


def _turn_state(spark, sf):
    t = views.turns(spark, sf)
    size = F.length("action") + F.length("obs")
    later = t.where("t >= 1")
    with_history = running_sums(later, ["rollout_id"], "t", {"history": size})
    first = t.where("t = 0").select("rollout_id", F.col("response").alias("obs0"))
    return with_history.join(first, "rollout_id")


def _features(spark, sf):
    s = _turn_state(spark, sf).withColumn("confidence", X.parse_confidence(F.col("response")))
    return X.with_prefix_features(
        s,
        ["rollout_id", "t"],
        step_index="t",
        history_length="history",
        task_desc="obs0",
        observation="obs",
        response="response",
        commands="commands",
        action="action",
        task_type="task_type",
        confidence="confidence",
    )


def prefix_features(spark, sf):
    return tidy(_features(spark, sf))


def feature_vectors(spark, sf):
    f = _features(spark, sf)
    v = f.select("rollout_id", "t", F.array(*[F.col(n) for n in X.FEATURE_NAMES]).alias("v"))
    return tidy(
        v.select(
            "rollout_id",
            "t",
            F.size("v").alias("dim"),
            F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"),
            F.element_at("v", 1).alias("first"),
            F.element_at("v", -1).alias("last"),
        )
    )


def _prompts(spark, sf):
    t = views.turns(spark, sf)
    # Up to four picked checkpoints a conversation; their histories are grouped by id and turn alone.
    ends = t.groupBy("rollout_id").agg(F.max("t").alias("n_steps"))
    cps = T.pick_checkpoints(ends).select("rollout_id", "t")
    hist = T.prefixes(cps, t.where("t >= 1"), "rollout_id", ["action", "obs"], "history")
    hist = hist.join(t.select("rollout_id", "t", "task_type", "commands"), ["rollout_id", "t"])
    first = t.where("t = 0").select("rollout_id", F.col("response").alias("obs0"))
    b = table(spark, sf, "benchmark").withColumn("task_type", views.task_type_of(F.col("item_id")))
    shots = (
        S.top_k_per_group(b, "task_type", ["item_id"], 2)
        .groupBy("task_type")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda x: x["text"]).alias("shots"))
    )
    # Two texts for each of six task types: a fixed-size side.
    j = hist.join(first, "rollout_id").join(F.broadcast(shots), "task_type", "left")
    no_shots = F.array().cast("array<string>")
    return j.withColumn("shots", F.coalesce("shots", no_shots))


def prompts(spark, sf):
    j = _prompts(spark, sf)
    user = X.user_message(F.col("obs0"), F.col("shots"), F.col("history"), F.col("commands"))
    return j.select("rollout_id", "t", X.chat_wrapped(user).alias("prompt"))


def confidence_prompts(spark, sf):
    j = _prompts(spark, sf)
    user = X.user_message(F.col("obs0"), F.col("shots"), F.col("history"))
    chosen = F.element_at("history", -1)["action"]
    return j.select("rollout_id", "t", X.chat_wrapped(X.confidence_message(user, chosen)).alias("prompt"))


def _trace_rollouts(spark, sf):
    s = views.steps(spark, sf)
    return s.groupBy("trace").agg(F.max("t").alias("n_steps"))


def checkpoint_picks(spark, sf):
    return tidy(T.pick_checkpoints(_trace_rollouts(spark, sf), 4, "trace"))


def prefix_actions(spark, sf):
    cps = T.pick_checkpoints(_trace_rollouts(spark, sf), 4, "trace").select("trace", "t")
    p = T.prefixes(cps, views.steps(spark, sf), "trace", ["action"], "steps")
    acts = F.transform("steps", lambda x: x["action"])
    return tidy(
        p.select(
            "trace",
            "t",
            I.composite_id(F.col("trace"), F.concat(F.lit("t"), F.col("t"))).alias("checkpoint_id"),
            F.array_join(acts, ",").alias("actions"),
            remaining_budget(F.lit(50), F.col("t")).alias("steps_remaining"),
        )
    )


def offered_actions(spark, sf):
    s = S.with_offered(views.steps(spark, sf), ["trace"], "t", "commands", F.array().cast("array<string>"))
    return tidy(s.select("trace", "t", F.array_join("offered", ",").alias("offered"), F.array_contains("offered", F.col("action")).alias("admissible")))


def step_rates(spark, sf):
    s = S.with_offered(views.steps(spark, sf), ["trace"], "t", "commands", F.array().cast("array<string>"))
    s = s.withColumn("confidence", X.parse_confidence(F.col("obs")))
    return tidy(S.step_rates(s, ["done"]))


def top_actions(spark, sf):
    s = S.with_offered(views.steps(spark, sf), ["trace"], "t", "commands", F.array().cast("array<string>"))
    return tidy(S.top_actions(s, 12))


def state_hashes(spark, sf):
    s = views.steps(spark, sf)
    sig = I.state_signature(
        F.col("obs"), F.col("commands"), F.col("reward"), F.col("done"), F.lit(False), F.array(F.col("action"), F.lit(" at home "))
    )
    return s.select("trace", "t", I.signature_hash(sig).alias("state_hash"))


def _verdicts(spark, sf, ignore=()):
    rec = views.steps(spark, sf)
    return T.verify(rec, views.observed_steps(rec), ["trace"], "t", STEP_FIELDS, ignore)


def trace_verification(spark, sf):
    v = _verdicts(spark, sf)
    return tidy(
        v.select(
            "trace",
            "n_expected",
            "n_observed",
            "length_error",
            "verified",
            "step_index",
            "action",
            "match_rate",
            F.col("diff.reward.expected").alias("reward_expected"),
            F.col("diff.reward.actual").alias("reward_actual"),
        )
    )


def trace_verification_ignoring_reward(spark, sf):
    v = _verdicts(spark, sf, ("reward",))
    return tidy(v.groupBy("verified", "length_error").agg(F.count(F.lit(1)).alias("n"), F.avg("match_rate").alias("match_rate")))


def list_differences(spark, sf):
    """Command sets of consecutive steps, compared as lists."""
    s = S.with_offered(views.steps(spark, sf), ["trace"], "t", "commands", F.array().cast("array<string>"))
    d = s.withColumn("d", T.list_diff(F.col("offered"), F.col("commands"))).where("d is not null")
    return tidy(
        d.select(
            "trace",
            "t",
            F.array_join("d.only_expected", ",").alias("only_expected"),
            F.array_join("d.only_actual", ",").alias("only_actual"),
            F.col("d.n_expected").alias("n_expected"),
            F.col("d.n_actual").alias("n_actual"),
        )
    )


def token_array_equality(spark, sf):
    """Word arrays of each turn, stored against recomputed from trimmed text."""
    c = table(spark, sf, "conversations")
    a, b = F.split("text", " "), F.split(F.trim(F.regexp_replace("text", " +", " ")), " ")
    return tidy(c.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(~a.eqNullSafe(b)).alias("n_differ")))


def rejected_units(spark, sf):
    v = _verdicts(spark, sf)
    units = (
        views.steps(spark, sf)
        .groupBy("trace")
        .agg(F.bool_or("done").alias("success"))
        .withColumn("terminal_reason", F.when(F.col("success"), "goal").otherwise("step_cap"))
    )
    r = T.rejected_branches(units, v, "trace")
    return tidy(r.groupBy("replay_verified", "terminal_reason", "success").agg(F.count(F.lit(1)).alias("n")))


QUERIES = {
    f.__name__: f
    for f in (
        record_hashes,
        seeded_order,
        completion_actions,
        action_classes,
        banner_strip,
        prefix_features,
        feature_vectors,
        prompts,
        confidence_prompts,
        checkpoint_picks,
        prefix_actions,
        offered_actions,
        step_rates,
        top_actions,
        state_hashes,
        trace_verification,
        trace_verification_ignoring_reward,
        list_differences,
        token_array_equality,
        rejected_units,
    )
}

# ------------------------------------------------------------------ oracle

SP = X.SPACE.replace("\\x1c", "\\x{1c}").replace("\\x1f", "\\x{1f}").replace("\\x0b", "\\x{0b}")
LE = X.LINE_END
_STRIP = f"regexp_replace({{x}}, '^{SP}+|{SP}+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.replace("{x}", x)


def _parse_action_sql(x: str) -> str:
    body = f"regexp_replace(regexp_replace(s, '^{SP}*>?{SP}*', ''), '{SP}+$', '')"
    return (
        f"coalesce(regexp_replace(lower(list_filter(list_transform(regexp_split_to_array({x}, '{LE}'), lambda s: {body}), "
        f"lambda b: length(b) > 0)[1]), '{SP}+', ' ', 'g'), '')"
    )


def _confidence_sql(x: str) -> str:
    v = f"CAST(nullif(regexp_extract({x}, '([0-9]*\\.?[0-9]+)', 1), '') AS DOUBLE)"
    return (
        f"CASE WHEN {v} IS NOT NULL THEN least(1e0, greatest(0e0, CASE WHEN contains({x}, '%') OR {v} > 1 THEN {v} / 1e2 ELSE {v} END)) END"
    )


def _banner_sql(x: str) -> str:
    blocks = f"str_split({x}, chr(10) || chr(10))"
    return _strip(
        f"(CASE WHEN len({blocks}) > 1 AND contains(lower({blocks}[1]), 'welcome') THEN array_to_string({blocks}[2:], chr(10)) ELSE {x} END)"
    )


def _word_count_sql(x: str) -> str:
    return f"CASE WHEN length({_strip(x)}) = 0 THEN 0 ELSE len(regexp_split_to_array({_strip(x)}, '{SP}+')) END"


def _kind_sql(x: str) -> str:
    text = f"lower({_strip(x)})"
    first = f"regexp_split_to_array({text}, '{SP}+')[1]"
    plain = ", ".join(f"'{a}'" for a in X.ACTION_TYPES if a != "goto")
    return (
        f"CASE WHEN starts_with({text}, 'go to') THEN 'goto' WHEN {first} = 'move' THEN 'put' WHEN {first} = 'toggle' THEN 'use' "
        f"WHEN {first} IN ({plain}) THEN {first} END"
    )


_FEATURES = f"""
later AS (
  SELECT *, sum(length(action) + length(obs)) OVER (PARTITION BY rollout_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS history
  FROM turns WHERE t >= 1),
feats AS (
  SELECT rollout_id, l.t, l.t::DOUBLE AS step_index, history::DOUBLE AS history_length, length(f.response)::DOUBLE AS task_desc_length,
    length(l.obs)::DOUBLE AS observation_length, length(l.response)::DOUBLE AS response_length, len(l.commands)::DOUBLE AS n_admissible_commands,
    ({_word_count_sql('l.action')})::DOUBLE AS action_word_count,
    {", ".join(f"coalesce(({_kind_sql('l.action')}) = '{a}', false)::INT::DOUBLE AS action_type_{a}" for a in X.ACTION_TYPES)},
    contains(lower(l.obs), 'nothing happens')::INT::DOUBLE AS nothing_happens,
    {", ".join(f"(CASE WHEN l.task_type = 'none' THEN 'unknown' ELSE l.task_type END = '{t}')::INT::DOUBLE AS task_type_{t}" for t in X.TASK_TYPES)},
    least(1e0, greatest(0e0, coalesce({_confidence_sql('l.response')}, 5e-1))) AS confidence
  FROM later l JOIN (SELECT rollout_id, response FROM turns WHERE t = 0) f USING (rollout_id))"""

_PROMPTS = f"""
shots AS (
  SELECT task_type, list({_strip('text')} ORDER BY item_id) AS shots FROM (
    SELECT item_id, text, ({views._TASKS})[1 + item_id % 6] AS task_type FROM benchmark
    QUALIFY row_number() OVER (PARTITION BY item_id % 6 ORDER BY item_id) <= 2) GROUP BY task_type),
ends AS (SELECT rollout_id, max(t) AS n FROM turns GROUP BY rollout_id),
cps AS (
  SELECT rollout_id, unnest(CASE WHEN n - 1 <= 0 THEN []::BIGINT[] WHEN n - 1 <= 4 THEN range(1, n)
    ELSE list_distinct(list_transform(range(0, 4), lambda i: (1 + i * (n - 1) // 4
      + ('0x' || substr(sha256(rollout_id || '|cp|' || i), 1, 8))::BIGINT % greatest((i + 1) * (n - 1) // 4 - i * (n - 1) // 4, 1))::BIGINT)) END) AS t
  FROM ends),
hist AS (
  SELECT c.rollout_id, c.t, any_value(c.task_type) AS task_type, any_value(c.commands) AS commands,
    string_agg('> ' || s.action || chr(10) || {_strip('s.obs')}, chr(10) ORDER BY s.t) AS body, arg_max(s.action, s.t) AS chosen
  FROM turns c SEMI JOIN cps ON c.rollout_id = cps.rollout_id AND c.t = cps.t JOIN turns s ON s.rollout_id = c.rollout_id
  WHERE s.t >= 1 AND s.t <= c.t GROUP BY c.rollout_id, c.t),
msg AS (
  SELECT h.rollout_id, h.t, h.commands, h.chosen, '{X.PROMPT_HEADER}' || chr(10) || coalesce(array_to_string(shots, chr(10)) || chr(10), '')
    || '{X.TASK_HEADER}' || chr(10) || {_banner_sql('f.response')} || chr(10) || body AS text
  FROM hist h JOIN (SELECT rollout_id, response FROM turns WHERE t = 0) f USING (rollout_id) LEFT JOIN shots USING (task_type))"""

_WRAP = (
    f"'<|im_start|>system' || chr(10) || '{X.SYSTEM_PROMPT}' || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || "
    "{x} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"
)

_PICKS = """
lens AS (SELECT trace, max(t) AS n_steps FROM steps GROUP BY trace),
picks AS (
  SELECT trace, n_steps, unnest(CASE WHEN n_steps - 1 <= 0 THEN []::BIGINT[] WHEN n_steps - 1 <= 4 THEN range(1, n_steps)
    ELSE list_distinct(list_transform(range(0, 4), lambda i: (1 + i * (n_steps - 1) // 4
      + ('0x' || substr(sha256(trace || '|cp|' || i), 1, 8))::BIGINT
        % greatest((i + 1) * (n_steps - 1) // 4 - i * (n_steps - 1) // 4, 1))::BIGINT)) END) AS t
  FROM lens)"""

_OFFERED = """
off AS (SELECT *, coalesce(lag(commands) OVER (PARTITION BY trace ORDER BY t), []) AS offered FROM steps)"""

_VERDICT = """
pairs AS (
  SELECT coalesce(e.trace, a.trace) AS trace, e.t AS et, a.t AS obt, e.action, e.reward AS er, a.reward AS ar,
    e.trace IS NOT NULL AND a.trace IS NOT NULL AS paired,
    e.obs IS DISTINCT FROM a.obs OR e.done IS DISTINCT FROM a.done OR e.commands IS DISTINCT FROM a.commands AS other,
    e.reward IS DISTINCT FROM a.reward AS rew
  FROM steps e FULL JOIN observed a ON e.trace = a.trace AND e.t = a.t),
verdict AS (
  SELECT trace, count(et) AS n_expected, count(obt) AS n_observed, count(*) FILTER (NOT paired) > 0 AS length_error,
    count(*) FILTER (paired AND (other OR rew)) = 0 AND count(*) FILTER (NOT paired) = 0 AS verified,
    min(et) FILTER (paired AND (other OR rew)) - 1 AS step_index, arg_min(action, et) FILTER (paired AND (other OR rew)) AS action,
    arg_min(er, et) FILTER (paired AND (other OR rew)) AS er, arg_min(ar, et) FILTER (paired AND (other OR rew)) AS ar,
    count(*) FILTER (paired AND other) = 0 AS verified_other
  FROM pairs GROUP BY trace)"""

_verbs = "[" + ", ".join(f"'{v}'" for v in VERBS) + "]"

ORACLE = {
    "record_hashes": """SELECT o_orderkey, substr(sha256(o_orderpriority), 1, 16) AS text_hash,
      substr(sha256('{"key":' || o_orderkey || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}'), 1, 16) AS record_hash,
      ('0x' || substr(sha256(o_orderkey || '|cp'), 1, 8))::BIGINT AS seed,
      concat_ws('::', o_orderkey, o_orderstatus, o_orderpriority) AS record_id, o_orderstatus AS second_part FROM orders""",
    "seeded_order": "SELECT c_custkey, row_number() OVER (ORDER BY md5('7|' || c_custkey)) AS position FROM customer",
    "completion_actions": f"SELECT doc_id, {_parse_action_sql('text')} AS action, {_confidence_sql('text')} AS confidence FROM documents",
    "action_classes": f"""SELECT {_kind_sql('action')} AS kind, count(*) AS n, sum({_word_count_sql('action')})::BIGINT AS words,
      count(*) FILTER (contains(lower(action), 'the')) AS n_marked FROM (
        SELECT {_parse_action_sql('text')} AS action FROM documents UNION ALL
        SELECT ({_verbs})[1 + p_size % {len(VERBS)}] || ' ' || p_name FROM part) GROUP BY ALL""",
    "banner_strip": f"""SELECT doc_id, {_banner_sql('text')} AS plain, {_banner_sql("('-= Welcome =-' || chr(10) || chr(10) || text)")} AS stripped FROM documents""",
    "prefix_features": with_views("turns", f"SELECT * REPLACE ({', '.join(f'round({n}, 6) + 0e0 AS {n}' for n in X.FEATURE_NAMES)}) FROM feats", _FEATURES),
    "feature_vectors": with_views(
        "turns",
        f"""SELECT rollout_id, t, {len(X.FEATURE_NAMES)}::BIGINT AS dim, round({' + '.join(X.FEATURE_NAMES)}, 6) + 0e0 AS total,
        step_index AS first, round(confidence, 6) + 0e0 AS last FROM feats""",
        _FEATURES,
    ),
    "prompts": with_views(
        "turns",
        "SELECT rollout_id, t, "
        + _WRAP.replace("{x}", "text || CASE WHEN len(commands) > 0 THEN chr(10) || 'Available actions: ' || array_to_string(commands, ', ') ELSE '' END || chr(10) || '>'")
        + " AS prompt FROM msg",
        _PROMPTS,
    ),
    "confidence_prompts": with_views(
        "turns",
        "SELECT rollout_id, t, "
        + _WRAP.replace("{x}", f"text || chr(10) || '> ' || chosen || chr(10) || chr(10) || '{X.CONFIDENCE_QUESTION}'")
        + " AS prompt FROM msg",
        _PROMPTS,
    ),
    "checkpoint_picks": with_views("steps", "SELECT trace, n_steps, t FROM picks", _PICKS),
    "prefix_actions": with_views(
        "steps",
        """SELECT p.trace, p.t, p.trace || '::t' || p.t AS checkpoint_id, string_agg(s.action, ',' ORDER BY s.t) AS actions,
        greatest(0, 50 - p.t)::BIGINT AS steps_remaining FROM picks p JOIN steps s ON s.trace = p.trace AND s.t <= p.t GROUP BY ALL""",
        _PICKS,
    ),
    "offered_actions": with_views(
        "steps",
        "SELECT trace, t, coalesce(array_to_string(offered, ','), '') AS offered, list_contains(offered, action) AS admissible FROM off",
        _OFFERED,
    ),
    "step_rates": with_views(
        "steps",
        tidy_sql(
            f"""SELECT done, count(*) AS n_steps, avg(list_contains(offered, action)::INT) AS admissible_rate, avg((action = '')::INT) AS empty_rate,
            avg(contains(lower(obs), 'nothing happens')::INT) AS nothing_happens_rate, count({_confidence_sql('obs')}) AS n_confidence,
            avg({_confidence_sql('obs')}) AS mean_confidence FROM off GROUP BY done""",
            "admissible_rate empty_rate nothing_happens_rate mean_confidence",
        ),
        _OFFERED,
    ),
    "top_actions": with_views(
        "steps",
        """SELECT action, n, action IN (SELECT unnest(offered) FROM off) AS admissible_somewhere
        FROM (SELECT action, count(*) AS n FROM off GROUP BY action ORDER BY n DESC, action LIMIT 12)""",
        _OFFERED,
    ),
    "state_hashes": with_views(
        "steps",
        """SELECT trace, t, substr(sha256('{"admissible_commands":' || to_json(list_sort(commands)) || ',"done":' || done || ',"facts":'
        || to_json(list_sort([trim(action), 'at home'])) || ',"obs":' || to_json(trim(obs)) || ',"reward":' || to_json(reward) || ',"won":false}'), 1, 32) AS state_hash FROM steps""",
    ),
    "trace_verification": with_views(
        "observed",
        """SELECT trace, n_expected, n_observed, length_error, verified, step_index, action,
        round(CASE WHEN verified THEN 1e0 ELSE step_index::DOUBLE / (step_index + 1) END, 6) + 0e0 AS match_rate,
        er::VARCHAR AS reward_expected, ar::VARCHAR AS reward_actual FROM verdict""",
        _VERDICT,
    ),
    "trace_verification_ignoring_reward": with_views(
        "observed",
        "SELECT verified_other AS verified, length_error, count(*) AS n, avg(verified_other::INT::DOUBLE) AS match_rate FROM verdict GROUP BY ALL",
        _VERDICT,
    ),
    "list_differences": with_views(
        "steps",
        """SELECT trace, t, coalesce(array_to_string(list_sort(list_filter(offered, lambda x: NOT list_contains(commands, x)))[1:10], ','), '') AS only_expected,
        coalesce(array_to_string(list_sort(list_filter(commands, lambda x: NOT list_contains(offered, x)))[1:10], ','), '') AS only_actual,
        len(offered)::BIGINT AS n_expected, len(commands)::BIGINT AS n_actual FROM off WHERE offered IS DISTINCT FROM commands""",
        _OFFERED,
    ),
    "token_array_equality": """SELECT role, count(*) AS n, count(*) FILTER (str_split(text, ' ') IS DISTINCT FROM
      str_split(trim(regexp_replace(text, ' +', ' ', 'g')), ' ')) AS n_differ FROM conversations GROUP BY role""",
    "rejected_units": with_views(
        "observed",
        """SELECT verified AS replay_verified, CASE WHEN NOT verified THEN 'replay_mismatch' WHEN win THEN 'goal' ELSE 'step_cap' END AS terminal_reason,
        verified AND win AS success, count(*) AS n
        FROM verdict JOIN (SELECT trace, bool_or(done) AS win FROM steps GROUP BY trace) USING (trace) GROUP BY ALL""",
        _VERDICT,
    ),
}
