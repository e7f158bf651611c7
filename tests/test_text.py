import pytest
from pyspark.sql import functions as F

from branchwise.functions import text as X

ACTIONS = [
    ("go to desk 1", "go to desk 1"),
    ("> Go To  desk 1\n", "go to desk 1"),
    ("\n\n  take mug 1\nobs: you take it", "take mug 1"),
    (">\nlook", "look"),
    ("", ""),
    ("   \n>\n", ""),
    (None, ""),
    (" > OPEN\tfridge 1 x", "open fridge"),
]
CONFIDENCE = [
    ("0.7", 0.7),
    (".7", 0.7),
    ("70%", 0.7),
    ("70", 0.7),
    ("Confidence: 0.85", 0.85),
    ("1", 1.0),
    ("1.5", 0.015),
    ("-0.3", 0.3),
    ("none", None),
    (None, None),
    ("", None),
]
CLASSES = [
    ("go to desk 1", "goto"),
    ("take mug", "take"),
    ("put mug in desk", "put"),
    ("move mug to desk", "put"),
    ("open drawer 1", "open"),
    ("close drawer 1", "close"),
    ("toggle lamp", "use"),
    ("use lamp", "use"),
    ("HEAT egg", "heat"),
    ("look", None),
    ("inventory", None),
    ("", None),
]


def column(spark, rows, fn):
    df = spark.createDataFrame([(r[0],) for r in rows], "s string").coalesce(1)
    return [r[0] for r in df.select(fn(F.col("s"))).collect()]


def test_actions(spark):
    assert column(spark, ACTIONS, X.parse_action) == [r[1] for r in ACTIONS]


def test_confidence(spark):
    got = column(spark, CONFIDENCE, X.parse_confidence)
    for g, (_, w) in zip(got, CONFIDENCE):
        assert g == (pytest.approx(w) if w is not None else None)


def test_classes(spark):
    assert column(spark, CLASSES, X.classify_action) == [r[1] for r in CLASSES]


def test_banner(spark):
    rows = [("-= Welcome to it =-\n\nYou are in a room.\n\nTask: x", "You are in a room.\nTask: x"), (" plain ", "plain"), ("a\n\nb", "a\n\nb")]
    assert column(spark, rows, X.strip_banner) == [r[1] for r in rows]


def test_feature_names_and_vector(spark):
    assert len(X.FEATURE_NAMES) == 26
    df = spark.createDataFrame(
        [(3, 40, "t" * 7, "Nothing happens.", "resp", ["a", "b"], "go to desk 1", "nope", None)],
        "st int, h int, d string, o string, r string, c array<string>, a string, k string, f double",
    )
    f = X.with_prefix_features(df, [], "st", "h", "d", "o", "r", "c", "a", "k", "f").first().asDict()
    assert f["step_index"] == 3 and f["history_length"] == 40 and f["n_admissible_commands"] == 2
    assert f["action_type_goto"] == 1 and sum(v for k, v in f.items() if k.startswith("action_type")) == 1
    assert f["task_type_unknown"] == 1 and f["nothing_happens"] == 1
    assert f["confidence"] == 0.5 and f["action_word_count"] == 4
    m = spark.createDataFrame([({n: float(i) for i, n in enumerate(X.FEATURE_NAMES)},)], "m map<string,double>")
    assert m.select(X.feature_vector(F.col("m"))).first()[0] == [float(i) for i in range(26)]


def test_prompt_layout(spark):
    df = spark.createDataFrame(
        [("-= Welcome =-\n\nRoom.", ["ex1 ", "ex2"], [("go", " you go ")], ["go", "look"])],
        "o string, e array<string>, h array<struct<action:string,obs:string>>, c array<string>",
    )
    text = df.select(X.user_message(F.col("o"), F.col("e"), F.col("h"), F.col("c"))).first()[0]
    assert text == "\n".join(
        [X.PROMPT_HEADER, "ex1", "ex2", X.TASK_HEADER, "Room.", "> go", "you go", "Available actions: go, look", ">"]
    )
    wrapped = df.select(X.chat_wrapped(F.lit("U"))).first()[0]
    assert wrapped.endswith("<|im_start|>user\nU<|im_end|>\n<|im_start|>assistant\n")
