"""Text, tag and table functions: hand-worked cases and plain Python versions."""

import hashlib
import itertools
import re

import pytest
from pyspark.sql import functions as F

from factweave.functions import tables, tags, text
from factweave.functions.prompts import render, subquestion_prompt
from factweave.operators import filters, judgelog, rewards


def one(spark, rows, column, schema="t string"):
    """``column`` of each row, in the order of the rows."""
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k long, " + schema)
    return [r[0] for r in df.orderBy("k").select(column.alias("x")).collect()]


def test_text(spark):
    rows = ["  A b.\n C! d? ", "", " \t\n", None, "one. two", "no end", "a.b c"]
    assert one(spark, rows, text.strip("t"))[:3] == ["A b.\n C! d?", "", ""]
    assert one(spark, rows, text.word_count("t")) == [4, 0, 0, 0, 2, 2, 2]
    assert one(spark, rows, text.sentence_count("t")) == [3, 0, 0, 0, 2, 1, 1]
    assert one(spark, ["I don't know.", "", "Yes", " i DON'T know . ", " \n"], text.is_idk("t")) == [True, True, False, True, True]


def test_hashes(spark):
    rows = [f"claim {k} é" for k in range(60)]
    digest = [hashlib.sha256(r.encode()).hexdigest() for r in rows]
    assert one(spark, rows, text.hash16("t")) == [d[:16] for d in digest]
    assert one(spark, rows, text.hash16_mod("t", 100)) == [int(d[:16], 16) % 100 for d in digest]
    assert one(spark, rows, text.sha256_mod("t", 10_000)) == [int(d, 16) % 10_000 for d in digest]
    assert one(spark, rows, filters.is_supervised(0.4, "t")) == [int(d, 16) % 10_000 / 10_000 < 0.4 for d in digest]
    assert one(spark, rows, filters.is_supervised(1, "t")) == [True] * 60
    with pytest.raises(ValueError):
        filters.is_supervised(1.5)


GENERATIONS = [
    "<think>a</think><question>q</question><answer>x</answer><think>b</think><verification>Supported</verification>",
    " \n<think>a</think><question>q</question><answer>x</answer><verification> Mixed </verification> \n",
    "no tags", "", "<verification>supported</verification> tail", "x<think>é日</think><question>1</question><question>2</question><answer>3</answer>",
    "<verification>No</verification><verification>Refuted</verification>", "<think>a<think>b</think></think><answer></answer>",
]


def plain_format(g):
    found = {t: list(re.finditer(f"<{t}>(.*?)</{t}>", g, re.S)) for t in tags.TAGS}
    order = "".join(tags.TAGS[t] for _, t in sorted((m.start(), t) for t in tags.TAGS for m in found[t]))
    think, v = found["think"], found["verification"]
    checks = [bool(think) and not g[: think[0].start()].strip(), bool(found["question"]), bool(found["answer"]), len(think) >= 2, bool(v)]
    checks += [bool(v) and v[-1][1].strip() in tags.VALID_LABELS, bool(v) and not g[v[-1].end() :].strip(), bool(re.fullmatch("t(?:t|qa)*v", order)) and "qa" in order]
    return sum(checks) / 8


def test_format_reward(spark):
    pieces = ("<think>t</think>", "<question>q</question>", "<answer>a</answer>", "<verification>Refuted</verification>")
    rows = GENERATIONS + ["".join(p) for n in range(5) for p in itertools.product(pieces, repeat=n)]
    assert one(spark, rows, tags.format_reward("t")) == [plain_format(r) for r in rows]


def test_qa_pairs(spark):
    got = one(spark, GENERATIONS, tags.qa_pairs("t"))
    assert [(x["question"], x["answer"]) for x in got[5]] == [("1", "3"), ("2", "3")]
    assert got[3] == [] and [(x["index"], x["answer"]) for x in one(spark, ["<question>a</question>"], tags.qa_pairs("t"))[0]] == [(1, tags.NO_ANSWER)]


def test_verification(spark):
    assert one(spark, GENERATIONS, tags.verification_label("t")) == ["supported", None, None, None, "supported", None, None, None]
    got = one(spark, GENERATIONS, tags.verification_reward("t", F.lit("Supported")))
    assert [(r["score"], r["label"]) for r in got[:5]] == [(1.0, "Supported"), (0.0, "Mixed"), (0.0, "unknown"), (0.0, "unknown"), (1.0, "supported")]
    toks = [[("<veri", -1.0), ("fication>", -2.0), (" ", -3.0), ("Sup", -0.5)], [("x", -1.0)]]
    got = one(spark, toks, tags.verification_confidence("t"), "t array<struct<tok:string,lp:double>>")
    assert got[0] == pytest.approx(2.718281828 ** -0.5) and got[1] is None


def test_verdicts(spark):
    rows = ["a <verdict>Refuted</verdict> supported", "x <verdict>SUPPORTED", "NOT_SUPPORTED", "so [supported]", "refuted then supported", "supported then refuted", "none", " Supported "]
    assert one(spark, rows, tags.verdict_tag("t")) == ["refuted", "supported", "refuted", "supported", "supported", "refuted", None, "supported"]
    rows = ["<verdict> Refuted </verdict>supported", "Supported", "it is supported.", "supported or refuted", "refuted, supported", "maybe refuted supported x", "", "not supported"]
    assert one(spark, rows, tags.prompted_label("t", cot=True)) == ["refuted", "supported", "supported", "supported", "supported", None, None, "supported"]
    assert one(spark, ["unsupported", "Refuted", "not enough", "?", None], tags.coverage_code("t")) == [0, 1, 2, None, None]
    assert one(spark, ["unsupported", "Refuted", "not enough", "?", None], tags.coverage_verdict("t")) == ["supported", "refuted", "not enough information", "not enough information", None]


def test_votes(spark):
    rows = ["A1: Yes\nA2: No\nA3: Unknown", "A1: unknown", "no lines", "  a12 : NO\nA2: yesterday\nA3: yes"]
    v = tags.answer_votes("t")
    assert one(spark, rows, v) == [["yes", "no", "unknown"], ["unknown"], [], ["no", "yes"]]
    assert one(spark, rows, tags.vote_verdict(v)) == ["supported", "refuted", None, "supported"]
    assert one(spark, rows, tags.yes_share(v)) == [0.5, 0.0, None, 0.5]


def test_subquestions(spark):
    rows = ["1. Is it A? - \"Is it B\"? Q2: is  it a? The claim", "", "???", "Did X?\nDid Y? Did X?"]
    assert one(spark, rows, tags.subquestions("t", 5, F.lit("the claim."))) == [["Is it A?", 'Is it B"?'], [], [], ["Did X?", "Did Y?"]]  # a quote before the mark stays
    assert one(spark, rows, tags.subquestions("t", 1)) == [["Is it A?"], [], [], ["Did X?"]]


def test_turn_replies(spark):
    assert one(spark, ["<enough>Yes</enough>", "<enough>no</enough> yes", " YES it is", "no", "hm"], tags.enough("t")) == [True, False, True, False, False]
    assert one(spark, ["<question> A? </question>", "x\n B? \ny", "C\nD", ""], tags.next_question("t")) == ["A?", "B?", "C", "Is the claim true?"]
    assert one(spark, ["<answer>a</answer>", " b "], tags.next_answer("t")) == ["a", "b"]
    history = one(spark, [[("q", "a"), ("r", "b")], []], tags.history_text("t"), "t array<struct<q:string,a:string>>")
    assert history == ["Q1: q\nA1: a\nQ2: r\nA2: b", "(no questions asked yet)"]


def test_labels(spark):
    full = "\n".join(f" {c}: {'Yes' if k % 2 else 'no'}" for k, c in enumerate(tags.CRITERIA))
    rows = [full, full.rsplit("\n", 1)[0], "", None]
    df = "extracted_response string"
    assert one(spark, rows, judgelog.label("atomicity_checklist"), df) == [0.4, None, None, None]
    assert one(spark, rows, judgelog.label("atomicity_single_focus"), df) == [1, None, None, None]
    assert one(spark, [" 1\n", "0", "2", "x", "1.0", None], judgelog.label("answer_correctness"), df) == [1, 0, None, None, None, None]
    assert one(spark, [0.0, 0.1, 0.31, 0.5, 0.99], judgelog.bin_atomicity(F.col("t")), "t double") == [0, 0, 2, 2, 5]


def test_question_count_reward(spark):
    rows = [(0, 4), (2, 4), (4, 4), (6, 4), (8, 4), (9, 4), (1, 0)]
    got = spark.createDataFrame(rows, "a int, b int").select(rewards.question_count_reward(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [0, 0.5, 1, 0.5, 0, 0, 1]


def test_prompts(spark):
    assert one(spark, ["{x} 100%", None], render("a {t}, %s {t}", t=F.col("t"))) == ["a {x} 100%, %s {x} 100%", "a , %s "]
    assert one(spark, [["a", "b"], []], subquestion_prompt(F.lit("c"), F.lit("e"), F.col("t")), "t array<string>")[1].count("Q1: Is the claim true?") == 1


#: HTML and its markdown.
TABLES = {
    "<table><tr><th>Name<br/>long</th><th>B</th></tr><tr><td>cafÃ©</td><td>â5&nbsp;&amp;  Â x</td></tr></table>": "| Name long | B |\n| --- | --- |\n| café | −5 & x |",
    "<table><tr><td>a<td>b<tr><td>c<br><br>d<p>e</p><td><b>f</b> <i>g</i></table>": "| a | b |\n| --- | --- |\n| c d e | **f** *g* |",
    "<p>Head  line</p><table><thead><tr><th colspan=2>wide</th><th>z</th></tr></thead><tbody><tr><td>1</td></tr></tbody></table>tail<br>end": "Head line\n\n| wide | | z |\n| --- | --- | --- |\n| 1 |\n\ntail\nend",
    "<table><tr><th>x</th></tr><tr><td>in <table><tr><td>ner</td><td>cell</td></tr></table> out</td></tr></table>": "| x |\n| --- |\n| in ner cell out |",
    "<table><tr><td>1â\x80\x932 â\x82¬ â\x80\x99s Ã\x97 Â° ð\x9f\x98\x80 Ãx â\x80\x90</td></tr></table>": "| 1–2 € 's × ° 😀 Ãx - |\n| --- |",
    "<table><tr><td>\u201ca\u201d\u200b\u00a0\u2019</td></tr></table>": "| \"a\" ' |\n| --- |",
    "<table></table>": "", "": "", "<table><tr></tr><tr><td>&amp;lt;b&amp;gt;</td></tr>": "| <b> |\n| --- |", "a\n\n\n\nb \t c": "a\n\nb c",
}


def test_html_tables():
    table = "| a |\n| --- |\n| b |"
    assert tables.html_to_markdown("<p>x</p><table><caption>CAP <b>t</b></caption><tr><th>a</th></tr> <tr><td>b</td></tr></table>y") == f"x\n\nCAP **t**\n\n{table}\n\ny"
    assert tables.html_to_markdown("<table>\n<tr><th>a<tr><td>b</table><table><caption>two</caption><tr><td>a</td></tr><tr><td>b</td></tr></table>") == f"{table}\n\ntwo\n\n{table}"
    assert tables.html_to_markdown("<table>stray<tr><td>a</td></tr><tr><td>b</td></tr></table>") == f"stray\n\n{table}"
    assert tables.html_to_markdown(None) is None
    for source, want in TABLES.items():
        assert tables.html_to_markdown(source) == want, source


def test_table_columns(spark):
    assert one(spark, ["['a', 'b']", None, "bad", "[1]"], tables.python_list(F.col("t"))) == [["a", "b"], [], [], ["1"]]
    assert one(spark, ["<b>x</b>", None], tables.table_markdown(F.col("t"))) == ["**x**", None]


def test_long_decompositions(spark):
    """Ten thousand questions in time, the first of each kind, as many as the limit."""
    asked = " ".join(f"{k + 1}. Word number {k % 700}?" for k in range(10_000))
    got = one(spark, [asked, "1. A? 2. a? 3. B?"], tags.subquestions("t", 100))
    assert got == [[f"Word number {k}?" for k in range(100)], ["A?", "B?"]]
    assert one(spark, ["1. Is it so? 2. c?"], tags.subquestions("t", 5, F.lit("C?"))) == [["Is it so?"]]


def test_baseline_prompts(spark):
    from factweave.functions.prompts import BASELINES

    assert set(BASELINES) == {"simple", "cot", "self_ask", "decomposed_prompting", "hiss", "folk", "programfc", "chen_complex"}
    for name, template in BASELINES.items():
        made = one(spark, ["x"], render(template, claim=F.lit("the {claim}"), evidence=F.lit("E")))[0]
        assert "the {claim}" in made and "Supported" in made or name == "folk"
