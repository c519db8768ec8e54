import re
import math
import random

import pytest
from pyspark.sql import functions as F

from quern.functions import chunks, numbers
from quern.functions import text as T
from quern.sources import files as S
from quern.streaming.meter import next_state


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "text string").select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_normalized_text(spark):
    got = one(spark, "  ａｂ​c \r\n\r\n\r\n\r\n d\t\te ", T.normalize_text(F.col("text")))[0]
    assert got == "abc\n\nd e"


def test_redaction_is_a_chain(spark):
    r = one(spark, "mail a.b@c.org, call 13812345678, id 11010519491231002X, lat: 31.2", T.redact(F.col("text")))[0]
    assert r.kinds == ["email", "phone", "national_id", "precise_coordinate"] and "138" not in r.text and "@" not in r.text


def test_tokens_and_cjk(spark):
    assert one(spark, "Ab_1 火灾!", T.tokens(F.col("text")))[0] == ["ab_1", "火", "灾"]


@pytest.mark.parametrize("copy,text,want", [(1, "a?", "a？"), (1, "好。", "好"), (1, "好", "好？"), (1, "好！", "好！"), (2, "好？", "好?")])
def test_variants(spark, copy, text, want):
    assert one(spark, text, T.text_variant(F.col("text"), F.lit(copy)))[0] == want


def test_positive_instruction_looks_back(spark):
    f = lambda a, t: one(spark, t, T.positive_instruction(F.lit(a), F.col("text")))[0]
    assert f("返回室内", "请返回室内") and not f("返回室内", "不要返回室内") and not f("返回室内", "离开")


def test_score_features(spark):
    f = T.score_features(F.array(F.lit(0.5), F.lit(0.25), F.lit(-1.0)))
    r = one(spark, "", *f.values())
    assert r[0] == 0.5 and r[1] == 0.25 and math.isclose(r[2], -(2 / 3) * math.log(2 / 3) - (1 / 3) * math.log(1 / 3))


def test_numbers(spark):
    assert math.isclose(numbers.normal_quantile(0.95), 1.6448536, abs_tol=1e-6) and math.isclose(numbers.normal_quantile(0.001), -3.0902323, abs_tol=1e-5)
    r = one(spark, "x", numbers.wilson_upper(F.lit(1), F.lit(3), 0.05), numbers.wilson_upper(F.lit(0), F.lit(3), 0.05), numbers.wilson_upper(F.lit(0), F.lit(0), 0.05), numbers.sigmoid(F.lit(-800.0)), numbers.sigmoid(F.lit(800.0)))
    assert math.isclose(r[0], 0.746466, abs_tol=1e-6) and math.isclose(r[1], 0.474196, abs_tol=1e-6) and r[2] == 1 and r[3] == 0 and r[4] == 1
    d = spark.createDataFrame([("2024-02-30",), ("2024-02-29T10",), ("soon",), (None,)], "d string").select(numbers.day(F.col("d")).cast("string")).collect()
    assert [x[0] for x in d] == [None, "2024-02-29", None, None]


def test_jurisdictions(spark):
    df = spark.createDataFrame([("CN", "CN-SC"), ("", "US"), ("global", "US"), ("US", "CN"), ("CN-SC", "CN")], "a string, q string")
    assert [r[0] for r in df.select(numbers.jurisdiction_applies(F.col("a"), F.col("q"))).collect()] == [True, True, True, False, False]


def test_chunks_cover_the_text():
    random.seed(3)
    for _ in range(200):
        text = "".join(random.choice("ab。；. \n") for _ in range(random.randint(0, 300)))
        got = chunks.cut(text, 40, 7)
        assert all(len(c) <= 42 for c in got)
        assert set("".join(text.split())) == set("".join("".join(got).split()))
    assert chunks.cut("a" * 25, 10, 2) == ["a" * 10, "a" * 10, "a" * 9] and chunks.cut(None, 10, 2) == []
    assert chunks.cut("first part. second part. third", 26, 3)[0] == "first part. second part."
    with pytest.raises(ValueError):
        chunks.cut("x", 5, 5)


def test_state_machine():
    state, run, answers = "IDLE", "", []
    for command, asked in [("START", "a"), ("ARM", "a"), ("ARM", "b"), ("START", "b"), ("START", "a"), ("START", "a"), ("STOP", "b"), ("STOP", "a")]:
        state, run, answer = next_state(state, run, command, asked)
        answers.append(answer)
    assert answers == ["NOT_ARMED", "ARMED", "BUSY", "RUN_ID_MISMATCH", "STARTED", "BUSY", "RUN_ID_MISMATCH", "STOPPED"] and state == "IDLE"


def test_each_pattern_of_redaction_runs_once_over_a_text(spark):
    texts = ["", None, "plain later on", "a@b.co 13912345678 x", "lat: 31.2 lon=-100", "id 12345678901234567X.", "\u0661lat\u0663", "1391234567\u0663", "x@y", "a@b.org a@b.org, \u7eac\u5ea6\uff1a3"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    r = T.redact(F.col("t"))
    out = df.select("i", r["text"].alias("text"), r["kinds"].alias("kinds"))
    got = {x.i: (x.text, x.kinds) for x in out.collect()}
    for i, t in enumerate(texts):
        kinds = []
        for name, pattern, instead in T.SENSITIVE if t is not None else ():
            found = re.compile(re.sub(r"^\(\?(i?)U\)", lambda m: "(?i)" if m[1] else "", pattern))
            kinds += [name] if found.search(t) else []
            t = found.sub(instead, t)
        assert got[i] == (t, kinds)
    plan = df.select(r["text"].alias("text"), r["kinds"].alias("kinds")).select(F.length("text"), "kinds")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("A-Z0-9._%+-]+@") <= 4  # tested and replaced, for each of the two columns


@pytest.mark.parametrize("made", [T.normalize_text, T.normalize_all, S.marked_text])
def test_texts_go_to_python_in_small_batches(spark, made):
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": "268435456"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        made(F.col("t"))
        assert [int(spark.conf.get(k)) for k in keys] == [1000, 8 << 20]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
