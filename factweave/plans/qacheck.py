"""The multi-turn check: at most so many turns of sufficiency, question and answer, then a verdict for all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.prompts import TURNS, render
from factweave.functions.tags import enough, history_text, next_answer, next_question, verdict_tag
from factweave.plans.checkpoint import cut

HISTORY = "array<struct<q:string,a:string>>"


def run(claims: DataFrame, reply: Callable[[Column], Column], max_turns: int = 5) -> DataFrame:
    """``claims(id, claim, evidence)`` with history, turns, early exit and predicted label.

    ``reply`` gives a model's reply column for a prompt column. Rows that are done
    keep their state; each turn is one pass over the rows and cuts the lineage.
    """
    state = claims.withColumns({"history": F.array().cast(HISTORY), "done": F.lit(False), "turns": F.lit(0)})
    for _ in range(max_turns):
        said = {"claim": F.col("claim"), "evidence": F.col("evidence"), "history": history_text("history")}
        state = state.withColumn("done", F.col("done") | enough(reply(render(TURNS["sufficiency"], **said))))
        state = state.withColumn("q", F.when(~F.col("done"), next_question(reply(render(TURNS["question"], **said)))))
        state = state.withColumn("a", F.when(~F.col("done"), next_answer(reply(render(TURNS["answer"], evidence=F.col("evidence"), question=F.col("q"))))))
        more = F.array(F.struct(F.col("q").alias("q"), F.col("a").alias("a"))).cast(HISTORY)
        state = cut(state.withColumns({"history": F.when(F.col("done"), F.col("history")).otherwise(F.concat("history", more)), "turns": F.col("turns") + (~F.col("done")).cast("int")}).drop("q", "a"))
        if state.where("NOT done").isEmpty():
            break
    final = reply(render(TURNS["verdict"], claim=F.col("claim"), evidence=F.col("evidence"), history=history_text("history")))
    return state.select("id", "claim", F.col("history").alias("qa_history"), F.col("turns").alias("num_turns"), F.col("done").alias("exited_early"), final.alias("generation"), verdict_tag(final).alias("pred_label"))
