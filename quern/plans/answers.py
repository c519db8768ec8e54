"""The answering plans: which evidence each configuration retrieves, and what it says with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import retrieval as R

# What an answer says without evidence, or instead of it.
GENERAL = "本配置未检索协议，仅可给出一般性安全提示；请以当地官方指令为准。"
NO_EVIDENCE = "无可用协议证据。"
FALLBACKS = {
    "out_of_scope": "这个问题超出当前离线应急协议库的范围，无法安全作答。请联系相应的当地主管机构；如存在即时人身危险，请优先联系当地紧急服务。",
    "conflicting_evidence": "检索到的协议存在可能冲突，当前不能给出确定性行动建议。请遵循现场最新官方指令，必要时转由人工应急人员判断。",
    "no_applicable_protocol": "当前没有找到与地点、时间和场景均适用的协议证据。请补充所在地区、事件类型和现场危险，并以当地最新官方指令为准。",
    "resource_unavailable": "设备资源不足，无法完成可靠检索或生成。请改用官方应急渠道或转人工处理；如存在即时危险，请优先撤离到安全位置。",
    "safe_fallback_configuration": "当前信息不足或风险较高，无法安全给出确定性行动建议。请补充地点、受影响对象、现场危险和可用资源，并优先联系当地应急机构。",
}
INSTRUCTIONS = {
    "C0": "你是离线应急助手。本配置不提供检索证据，只能给出保守的一般性安全提示；不得声称依据了本地协议，不得虚构辖区、电话或现场事实。",
    "": "你是离线应急助手。只能依据给定协议回答；证据不足时必须明确回退并请求补充信息。不得虚构。回答应短、可执行，并用方括号标注证据编号。",
}


def fallback_text(reason: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in FALLBACKS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, reason), F.lit(FALLBACKS["safe_fallback_configuration"]))


def prompt(text: Column, evidence: Column, configuration: Column, most: int | None = None) -> Column:
    """A generator's prompt; evidence is an array of (evidence_id, text)."""
    shown = F.array_join(F.transform(evidence, lambda e: F.concat(F.lit("["), e["evidence_id"], F.lit("] "), e["text"])), "\n")
    shown = shown if most is None else F.substring(shown, F.lit(1), F.lit(most))
    start = F.when(configuration == "C0", INSTRUCTIONS["C0"]).otherwise(INSTRUCTIONS[""])
    return F.concat(start, F.lit("\n\n问题："), text, F.lit("\n协议证据：\n"), F.coalesce(F.nullif(shown, F.lit("")), F.lit(NO_EVIDENCE)), F.lit("\n\n回答："))


def extractive(evidence: Column) -> Column:
    return F.array_join(F.transform(evidence, lambda e: F.concat(e["text"], F.lit(" ["), e["evidence_id"], F.lit("]"))), "\n")


def _gathered(ranked: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, evidence): a query's few documents in rank order. Their ids go to the texts, so that no text of other documents is shuffled."""
    found = corpus.select("evidence_id", "text").join(F.broadcast(ranked), "evidence_id")
    return found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "evidence_id", "text"))), lambda e: F.struct(e["evidence_id"].alias("evidence_id"), e["text"].alias("text"))).alias("evidence"))


def answered(corpus: DataFrame, queries: DataFrame, configuration: str, encoder=None, top_k: int | None = None, candidate_k: int | None = None, least: int = 3) -> DataFrame:
    """(query_id, configuration, answer, evidence, fallback, fallback_reason, steps) by one of C0 to C3.

    C0 retrieves nothing; C1 takes the fused candidates; C2 gates them by applicability, searches again with a longer query
    where fewer than `least` apply, reranks, and refuses where evidence conflicts; C3 always falls back.
    """
    base = queries.select("query_id", "text")
    empty = F.array().cast("array<struct<evidence_id: string, text: string>>")
    if configuration == "C0":
        rows = base.withColumn("evidence", empty).withColumn("reason", F.lit(None).cast("string")).withColumn("steps", F.lit(0))
    elif configuration == "C3":
        rows = base.withColumn("evidence", empty).withColumn("reason", F.lit("safe_fallback_configuration")).withColumn("steps", F.lit(0))
    elif configuration == "C1":
        got = _gathered(R.hybrid(corpus, queries, top_k or 5, candidate_k or 20, encoder), corpus)
        rows = base.join(got, "query_id", "left").withColumn("reason", F.when(F.col("evidence").isNull(), "no_applicable_protocol")).withColumn("steps", F.lit(1))
    elif configuration == "C2":
        depth = candidate_k or 24
        asked = queries.select("query_id", "text", *[(F.col(c) if c in queries.columns else F.lit("")).alias(f"_{c}") for c in ("jurisdiction", "as_of_date", "target_population")])
        meta = corpus.drop("text")
        gate = R.rejection(F.col("_jurisdiction"), F.col("_as_of_date"), F.col("_target_population"))
        applies = lambda q: R.hybrid(corpus, q, depth, depth, encoder).join(meta, "evidence_id").join(asked.drop("text"), "query_id").where(gate.isNull()).select("query_id", "evidence_id", "score", "rank")
        first = applies(queries)
        enough = first.groupBy("query_id").agg(F.count("*").alias("n"))
        again = queries.join(enough.where(F.col("n") >= least), "query_id", "left_anti").withColumn("text", R.second_step(F.col("text")))
        both = R.merged(first, applies(again)).join(meta, "evidence_id").join(base.withColumnRenamed("text", "_asked"), "query_id")
        best = R.reranked(both, F.col("_asked")).where(F.col("rank") <= (top_k or 8)).select("query_id", "evidence_id", "rank")
        clash = R.conflicts(best.join(corpus.select("evidence_id", "text"), "evidence_id")).select("query_id").distinct().withColumn("clash", F.lit(True))
        rows = base.join(_gathered(best, corpus), "query_id", "left").join(clash, "query_id", "left").join(again.select("query_id", F.lit(2).alias("_two")), "query_id", "left")
        rows = rows.withColumn("reason", F.when(F.col("evidence").isNull(), "no_applicable_protocol").when(F.col("clash"), "conflicting_evidence")).withColumn("steps", F.coalesce("_two", F.lit(1)))
    else:
        raise ValueError(f"unknown configuration: {configuration}")
    answer = F.when(F.col("reason").isNotNull(), fallback_text(F.col("reason"))).when(F.lit(configuration == "C0"), F.lit(GENERAL)).otherwise(extractive(F.col("evidence")))
    return rows.select("query_id", F.lit(configuration).alias("configuration"), answer.alias("answer"), F.coalesce("evidence", empty).alias("evidence"), F.col("reason").isNotNull().alias("fallback"), F.col("reason").alias("fallback_reason"), "steps")


def evaluated(answers: DataFrame, annotated: DataFrame) -> DataFrame:
    """Metrics of answers against annotations (query_id, required_actions, prohibited_actions, gold_evidence_ids, should_fallback)."""
    from quern.functions.text import action_matched, positive_instruction

    rows = answers.join(annotated, "query_id")
    done = F.filter("required_actions", lambda a: action_matched(a, F.col("answer")))
    bad = F.filter("prohibited_actions", lambda a: positive_instruction(a, F.col("answer")))
    ids = F.transform("evidence", lambda e: e["evidence_id"])
    share = lambda part, whole: F.when(F.size(whole) > 0, F.size(part) / F.size(whole))
    return rows.select(
        "query_id", "configuration", share(done, F.col("required_actions")).alias("action_completeness"), share(F.array_intersect("gold_evidence_ids", ids), F.array_distinct("gold_evidence_ids")).alias("retrieval_recall"),
        (F.col("fallback") == F.col("should_fallback")).alias("fallback_correct"), ((F.size(bad) > 0) | (F.col("should_fallback") & ~F.col("fallback"))).alias("severe_failure"),
    )
