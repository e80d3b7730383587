"""Prompts as columns. The wording is this engine's own; the tags and fields are those that the parsers and the validity gate need."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

VERIFY = {
    "v1": "Decide whether the document supports the claim. Think in <think> tags. Ask what you need in <question> tags and answer each from the document in <answer> tags, or say I don't know. End with <verification>Supported</verification> or <verification>Refuted</verification>.\n\nDocument: {document}\n\nClaim: {claim}",
    "v2": "Break the claim into atomic questions. For each: <think>, <question>, <answer> from the document only. Close with one <verification> of Supported or Refuted.\n\nClaim: {claim}\n\nDocument: {document}",
}
TASKS = {
    "question_count": "How many questions does it take to check this claim? Reply in <count> tags.\n\nClaim: {claim}",
    "decompose": "List the questions that together decide this claim, one per line.\n\nClaim: {claim}\nNumber of questions: {n}",
    "question_answerable": "Can the question be answered from the document? Reply 1 or 0 in <label> tags.\n\nDocument: {document}\nQuestion: {question}",
    "answer_correctness": "Does the document back this answer? Reply 1 or 0 in <label> tags.\n\nDocument: {document}\nQuestion: {question}\nAnswer: {answer}",
    "atomicity": "Judge the question by is_question, single_focus, no_conjunctions, verifiable and grounded, a line each with yes or no, in <checklist> tags.\n\nClaim: {claim}\nQuestion: {question}",
    "coverage": "By these answers alone, is the claim supported, refuted, or is there not enough information? Reply in <verdict> tags.\n\nClaim: {claim}\nAnswers:\n{answers}",
}
#: By the fixed names of the baselines; each asks for the verdict in the form that ``verdict_tag`` reads.
BASELINES = {
    "simple": "Claim: {claim}\nEvidence: {evidence}\nReply with Supported or Refuted.",
    "cot": "Claim: {claim}\nEvidence: {evidence}\nReason step by step, then give <verdict>Supported</verdict> or <verdict>Refuted</verdict>.",
    "self_ask": "Are follow-up questions needed? Ask and answer them from the evidence, then give <verdict>Supported</verdict> or <verdict>Refuted</verdict>.\nClaim: {claim}\nEvidence: {evidence}",
    "decomposed_prompting": "List the sub-questions that the claim needs, answer each from the evidence, say when there are no more, and give <verdict>Supported</verdict> or <verdict>Refuted</verdict>.\nClaim: {claim}\nEvidence: {evidence}",
    "hiss": "Split the claim into parts. For each part, ask and answer questions step by step from the evidence alone (I don't know where it is silent) and judge the part. From all parts give <verdict>Supported</verdict> or <verdict>Refuted</verdict>.\nClaim: {claim}\nEvidence: {evidence}",
    "folk": "Turn the claim into predicates, ground each in the evidence, and end with [SUPPORTED] or [NOT_SUPPORTED].\nClaim: {claim}\nEvidence: {evidence}",
    "programfc": "Write the checks that this claim needs, run each on the evidence, set label to True or False, and give <verdict>Supported</verdict> for True or <verdict>Refuted</verdict> for False.\nClaim: {claim}\nEvidence: {evidence}",
    "chen_complex": "Write yes/no questions that together decide the claim, answer each from the evidence with a reason (I don't know where it is silent), weigh the answers as a whole, and give <verdict>Supported</verdict> or <verdict>Refuted</verdict>.\nClaim: {claim}\nEvidence: {evidence}",
}
TURNS = {
    "sufficiency": "Claim: {claim}\nEvidence: {evidence}\n{history}\nIs this enough to decide? Reply in <enough> tags with yes or no.",
    "question": "Claim: {claim}\nEvidence: {evidence}\n{history}\nAsk the next question in <question> tags.",
    "answer": "Evidence: {evidence}\nQuestion: {question}\nReply in <answer> tags.",
    "verdict": "Claim: {claim}\nEvidence: {evidence}\n{history}\nGive <verdict>Supported</verdict> or <verdict>Refuted</verdict>.",
}


def render(template: str, **fields: Column) -> Column:
    """The template with its ``{name}`` fields filled; braces and percent signs inside values stay as they are."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(fields[p].cast("string"), F.lit("")) if k % 2 else F.lit(p) for k, p in enumerate(parts)])


def subquestion_prompt(claim: Column, evidence: Column, asked: Column) -> Column:
    """All sub-questions with an answer line for each; without any, one plain question."""
    some = F.when(F.size(asked) > 0, asked).otherwise(F.array(F.lit("Is the claim true?")))
    q = F.array_join(F.transform(some, lambda x, i: F.concat(F.lit("Q"), (i + 1).cast("string"), F.lit(": "), x)), "\n")
    a = F.array_join(F.transform(some, lambda x, i: F.concat(F.lit("A"), (i + 1).cast("string"), F.lit(": <Yes, No or Unknown>"))), "\n")
    return F.concat(F.lit("Claim: "), claim, F.lit("\nEvidence: "), evidence, F.lit("\n"), q, F.lit("\nReply line by line:\n"), a)
