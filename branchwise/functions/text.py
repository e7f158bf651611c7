"""Text columns: completion normalisation, prompts, prefix features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space and line ends as the reference results treat them.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

# Feature names, action verbs, task types, marker, prompt texts.
ACTION_TYPES = ("goto", "take", "put", "open", "close", "use", "heat", "cool", "clean", "examine")
TASK_TYPES = (
    "pick_and_place_simple",
    "look_at_obj_in_light",
    "pick_clean_then_place_in_recep",
    "pick_heat_then_place_in_recep",
    "pick_cool_then_place_in_recep",
    "pick_two_obj_and_place",
    "unknown",
)
NOTHING_HAPPENS = "nothing happens"
BASE_FEATURES = (
    "step_index",
    "history_length",
    "task_desc_length",
    "observation_length",
    "response_length",
    "n_admissible_commands",
    "action_word_count",
)
FEATURE_NAMES = (
    BASE_FEATURES
    + tuple(f"action_type_{a}" for a in ACTION_TYPES)
    + ("nothing_happens",)
    + tuple(f"task_type_{t}" for t in TASK_TYPES)
    + ("confidence",)
)
SYSTEM_PROMPT = (
    "You are an agent solving a household task in a text environment. "
    "Reply with exactly one action and nothing else."
)
PROMPT_HEADER = "Interact with a household to solve a task. Here are two examples."
TASK_HEADER = "Here is the task."
CONFIDENCE_QUESTION = (
    "How confident are you, from 0.00 to 1.00, that you will complete this task "
    "successfully? Reply with only a number."
)


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def parse_action(raw: Column) -> Column:
    """One action from a raw completion; '' when nothing usable is present."""
    lines = F.split(F.coalesce(raw, F.lit("")), LINE_END)
    bodies = F.transform(
        lines, lambda ln: F.regexp_replace(F.regexp_replace(ln, f"^{SPACE}*>?{SPACE}*", ""), f"{SPACE}+$", "")
    )
    first = F.get(F.filter(bodies, lambda b: F.length(b) > 0), F.lit(0))
    return F.coalesce(F.regexp_replace(F.lower(first), f"{SPACE}+", " "), F.lit(""))


def parse_confidence(raw: Column) -> Column:
    """Confidence in [0, 1]; null when there is no number."""
    value = F.nullif(F.regexp_extract(raw, r"([0-9]*\.?[0-9]+)", 1), F.lit("")).cast("double")
    scaled = F.when(raw.contains("%") | (value > 1.0), value / 100.0).otherwise(value)
    return F.when(value.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled)))


def strip_banner(obs: Column) -> Column:
    """Drop the first blank-line block when it is the welcome banner."""
    blocks = F.split(obs, "\n\n")
    has_banner = (F.size(blocks) > 1) & F.lower(F.get(blocks, F.lit(0))).contains("welcome")
    rest = F.array_join(F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0))), "\n")
    return strip_space(F.when(has_banner, rest).otherwise(obs))


def classify_action(action: Column) -> Column:
    """Action verb class, null for anything unrecognised."""
    text = F.lower(strip_space(action))
    first = F.get(F.split(text, f"{SPACE}+"), F.lit(0))
    plain = [a for a in ACTION_TYPES if a != "goto"]
    return (
        F.when(text.startswith("go to"), F.lit("goto"))
        .when(first == "move", F.lit("put"))
        .when(first == "toggle", F.lit("use"))
        .when(first.isin(*plain), first)
    )


def normalise_task_type(task_type: Column) -> Column:
    t = strip_space(F.coalesce(task_type, F.lit("")))
    return F.when(t.isin(*TASK_TYPES), t).otherwise(F.lit("unknown"))


def word_count(text: Column) -> Column:
    body = strip_space(text)
    return F.when(F.length(body) == 0, F.lit(0)).otherwise(F.size(F.split(body, f"{SPACE}+")))


def contains_marker(text: Column, marker: str = NOTHING_HAPPENS) -> Column:
    return F.lower(text).contains(marker)


def with_prefix_features(
    df: DataFrame,
    keys: list[str],
    step_index: str,
    history_length: str,
    task_desc: str,
    observation: str,
    response: str,
    commands: str,
    action: str,
    task_type: str,
    confidence: str,
) -> DataFrame:
    """The 26 prefix features by column name.

    ``history_length`` is a running sum the caller supplies. The action class and
    task type are their own step, so each regular expression runs once per row.
    """
    named = df.withColumns({"_kind": classify_action(F.col(action)), "_task": normalise_task_type(F.col(task_type))})
    conf = F.coalesce(F.col(confidence), F.lit(0.5))
    out = {
        "step_index": F.col(step_index),
        "history_length": F.col(history_length),
        "task_desc_length": F.length(task_desc),
        "observation_length": F.length(observation),
        "response_length": F.length(response),
        "n_admissible_commands": F.size(commands),
        "action_word_count": word_count(F.col(action)),
        "nothing_happens": contains_marker(F.col(observation)),
        "confidence": F.least(F.lit(1.0), F.greatest(F.lit(0.0), conf)),
    }
    out |= {f"action_type_{a}": F.coalesce(F.col("_kind") == a, F.lit(False)) for a in ACTION_TYPES}
    out |= {f"task_type_{t}": F.col("_task") == t for t in TASK_TYPES}
    return named.select(*keys, *[out[n].cast("double").alias(n) for n in FEATURE_NAMES])


def feature_vector(feature_map: Column) -> Column:
    """Map column to vector in the fixed feature order."""
    return F.transform(F.array(*[F.lit(n) for n in FEATURE_NAMES]), lambda n: F.element_at(feature_map, n))


def user_message(
    obs0: Column,
    exemplars: Column,
    history: Column,
    commands: Column | None = None,
    header: str = PROMPT_HEADER,
    task_header: str = TASK_HEADER,
) -> Column:
    """Prompt body from the initial observation and an ordered history array.

    ``history`` holds structs with ``action`` and ``obs``; ``exemplars`` is an
    array of texts; ``commands`` adds the line of available actions.
    """
    shots = F.transform(exemplars, strip_space)
    turns = F.flatten(
        F.transform(history, lambda h: F.array(F.concat(F.lit("> "), h["action"]), strip_space(h["obs"])))
    )
    lines = F.concat(F.array(F.lit(header)), shots, F.array(F.lit(task_header), strip_banner(obs0)), turns)
    text = F.array_join(lines, "\n")
    if commands is not None:
        listing = F.concat(F.lit("\nAvailable actions: "), F.array_join(commands, ", "))
        text = F.concat(text, F.when(F.size(commands) > 0, listing).otherwise(F.lit("")))
    return F.concat(text, F.lit("\n>"))


def chat_wrapped(user: Column, system: str = SYSTEM_PROMPT) -> Column:
    """The plain chat wrapper around a user message."""
    return F.concat(
        F.lit(f"<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n"),
        user,
        F.lit("<|im_end|>\n<|im_start|>assistant\n"),
    )


def confidence_message(user: Column, chosen_action: Column) -> Column:
    """User message completed with the chosen action and the confidence question."""
    return F.concat(user, F.lit(" "), chosen_action, F.lit("\n\n" + CONFIDENCE_QUESTION))
