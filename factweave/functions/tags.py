"""Parsing of tagged generations and of model verdicts; native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factweave.functions.text import col, let, strip, text_between

#: Tags of a generation with the letter that stands for each in the order check, and the labels a verification may carry.
TAGS = {"think": "t", "question": "q", "answer": "a", "verification": "v"}
VALID_LABELS = ("Supported", "Refuted", "Mixed")
VERDICTS = ("supported", "refuted")
NO_ANSWER = "[No answer found]"
SPAN = "array<struct<tag:string,begin:int,end:int,body:string>>"
#: Fixed value: the five atomicity criteria.
CRITERIA = ("is_question", "single_focus", "no_conjunctions", "verifiable", "grounded")


def spans(c: Column | str, tag: str) -> Column:
    """Begin, end (code points, end exclusive) and body of each ``<tag>...</tag>``, shortest matches from the left."""
    pattern = rf"(?s)<{tag}>(.*?)</{tag}>"
    pieces, bodies = F.split(col(c), pattern, -1), F.regexp_extract_all(col(c), F.lit(pattern), F.lit(1))
    around = 2 * len(tag) + 5
    walked = F.aggregate(
        F.arrays_zip(F.slice(pieces, 1, F.size(bodies)).alias("p"), bodies.alias("b")),
        F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["p"]) + F.length(x["b"]) + around).alias("at"),
            F.concat(
                acc["out"],
                F.array(F.struct(F.lit(tag).alias("tag"), (acc["at"] + F.length(x["p"])).alias("begin"), (acc["at"] + F.length(x["p"]) + F.length(x["b"]) + around).alias("end"), x["b"].alias("body"))),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.coalesce(walked, F.array().cast(SPAN))


def all_spans(c: Column | str) -> Column:
    """The spans of all tags in the order of their begins."""
    every = F.concat(*[spans(c, t) for t in TAGS])
    return F.array_sort(every, lambda x, y: x["begin"] - y["begin"])


def qa_pairs(c: Column | str) -> Column:
    """Each question with the first answer that begins behind it; several questions may share one."""
    answers = spans(c, "answer")
    return F.transform(
        spans(c, "question"),
        lambda q, i: F.struct(
            (i + 1).alias("index"),
            strip(q["body"]).alias("question"),
            F.coalesce(strip(F.get(F.filter(answers, lambda a: a["begin"] > q["begin"]), F.lit(0))["body"]), F.lit(NO_ANSWER)).alias("answer"),
        ),
    )


def format_checks(c: Column | str) -> Column:
    """The eight checks of a generation's form, as a struct of booleans."""
    think, question, answer, verification = (spans(c, t) for t in TAGS)
    final = F.try_element_at(verification, F.lit(-1))
    order = F.array_join(F.transform(all_spans(c), lambda s: F.element_at(F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv]), s["tag"])), "")
    first = F.get(think, F.lit(0))
    return F.struct(
        F.coalesce(strip(F.substring(col(c), F.lit(1), first["begin"])) == "", F.lit(False)).alias("initial_think"),
        (F.size(question) > 0).alias("questions"),
        (F.size(answer) > 0).alias("answers"),
        (F.size(think) >= 2).alias("intermediate_thinks"),
        (F.size(verification) > 0).alias("verification"),
        F.coalesce(strip(final["body"]).isin(*VALID_LABELS), F.lit(False)).alias("valid_label"),
        F.coalesce(strip(F.substring(col(c), final["end"] + 1, F.length(col(c)))) == "", F.lit(False)).alias("no_trailing"),
        (F.rlike(order, F.lit("^t(?:t|qa)*v$")) & F.contains(order, F.lit("qa"))).alias("ordering"),
    )


def format_reward(c: Column | str) -> Column:
    """The share of the eight checks that hold."""
    checks = format_checks(c)
    names = ("initial_think", "questions", "answers", "intermediate_thinks", "verification", "valid_label", "no_trailing", "ordering")
    return sum((checks[n].cast("int") for n in names[1:]), checks[names[0]].cast("int")) / F.lit(8.0)


def verification_label(c: Column | str) -> Column:
    """The first verification block if it is a verdict, lower-case."""
    label = F.lower(text_between(c, "verification"))
    return F.when(label.isin(*VERDICTS), label)


def verification_reward(c: Column | str, truth: Column | str) -> Column:
    """1 if the first verification block equals the truth whatever the case, and the block (``unknown`` without one)."""
    label = text_between(c, "verification")
    return F.struct(F.coalesce((F.lower(label) == F.lower(col(truth))).cast("double"), F.lit(0.0)).alias("score"), F.coalesce(label, F.lit("unknown")).alias("label"))


def verification_confidence(tokens: Column | str) -> Column:
    """``exp`` of the log probability of the first token that isn't blank among the five behind the verification tag; ``tokens``: array of ``tok, lp``."""
    t = col(tokens)
    done = F.aggregate(
        t,
        F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(-1).alias("end")),
        lambda a, x: F.struct(
            F.concat(a["text"], x["tok"]).alias("text"),
            (a["n"] + 1).alias("n"),
            F.when((a["end"] < 0) & F.contains(F.concat(a["text"], x["tok"]), F.lit("<verification>")), a["n"] + 1).otherwise(a["end"]).alias("end"),
        ),
    )
    after = F.filter(F.slice(t, F.greatest(done["end"], F.lit(0)) + 1, 5), lambda x: strip(x["tok"]) != "")
    return F.when(done["end"] >= 0, F.exp(F.get(after, F.lit(0))["lp"]))


def prompted_label(c: Column | str, cot: bool = False) -> Column:
    """A plain answer's verdict: its verdict tag (``cot``), the whole text, the only verdict word in it, the first or the last word; else null."""
    g = F.lower(strip(c))
    sup, ref = F.contains(g, F.lit("supported")), F.contains(g, F.lit("refuted"))
    w = F.filter(F.split(g, r"\s+"), lambda x: x != "")
    first, last = F.get(w, F.lit(0)), F.try_element_at(w, F.lit(-1))
    found = F.when(g.isin(*VERDICTS), g).when(sup & ~ref, "supported").when(ref & ~sup, "refuted").when(first.isin(*VERDICTS), first).when(last.isin(*VERDICTS), last)
    if not cot:
        return found
    tag = F.lower(text_between(c, "verdict"))
    return F.when(tag.isin(*VERDICTS), tag).otherwise(found)


def verdict_tag(c: Column | str) -> Column:
    """The last verdict tag (or the whole text), else a bracketed or underscored marker, else the verdict word that comes last; else null."""
    tag = F.lower(text_between(c, "verdict", last=True, whole=True))
    g = F.lower(col(c))
    place = lambda word: F.when(F.contains(g, F.lit(word)), F.length(g) - F.instr(F.reverse(g), word[::-1]) - len(word) + 1).otherwise(F.lit(-1))
    sup, ref = place("supported"), place("refuted")
    return (
        F.when(tag.isin(*VERDICTS), tag)
        .when(F.contains(g, F.lit("not_supported")), "refuted")
        .when(F.contains(g, F.lit("[supported]")), "supported")
        .when((sup == -1) & (ref == -1), F.lit(None))
        .when(sup > ref, "supported")
        .otherwise("refuted")
    )


def answer_votes(c: Column | str) -> Column:
    """The ``yes``, ``no`` and ``unknown`` of lines ``A1: ...``, lower-case."""
    return F.transform(F.regexp_extract_all(col(c), F.lit(r"(?im)^\s*A\d+\s*:\s*(yes|no|unknown)\b"), F.lit(1)), F.lower)


def yes_share(votes: Column) -> Column:
    """Yes among yes and no (0 of none); null without votes."""
    yes, no = (F.size(F.filter(votes, lambda v: v == x)) for x in ("yes", "no"))
    return F.when(F.size(votes) > 0, yes / F.greatest(yes + no, F.lit(1)))


def vote_verdict(votes: Column) -> Column:
    """Supported if half of the decided votes are yes; refuted if none is decided; null without votes."""
    yes, no = (F.size(F.filter(votes, lambda v: v == x)) for x in ("yes", "no"))
    return F.when(F.size(votes) == 0, F.lit(None)).when((yes + no > 0) & (yes * 2 >= yes + no), "supported").otherwise("refuted")


def _plain(c: Column) -> Column:
    return strip(F.regexp_replace(F.lower(c), r"""[\s"'`.,;:!?]+""", " "))


def subquestions(c: Column | str, limit: int, claim: Column | str | None = None) -> Column:
    """Questions of a decomposition: split at ``?``, without numbering, quotes, echoes of the claim and repeats; at most ``limit``."""
    quotes = lambda q: strip(F.regexp_replace(F.regexp_replace(q, '^"+|"+$', ""), "^'+|'+$", ""))
    flat = strip(F.regexp_replace(col(c), r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]", " "))
    parts = F.filter(F.transform(F.split(flat, r"\?", -1), strip), lambda p: p != "")
    bare = F.transform(parts, lambda p: quotes(strip(F.regexp_replace(F.concat(p, F.lit("?")), r"(?i)^\s*(?:Q\d*[.:)]?\s*|\d+[.):]\s*|[-*]\s*)(?=.)", ""))))
    asked = F.transform(bare, lambda q: F.when(F.endswith(q, F.lit("?")), q).otherwise(F.concat(q, F.lit("?"))))
    keyed = F.filter(F.transform(asked, lambda q: F.struct(_plain(q).alias("key"), q.alias("q"))), lambda x: x["key"] != "")
    if claim is not None:
        keyed = let(_plain(col(claim)), lambda echo: F.filter(keyed, lambda x: (echo == "") | (x["key"] != echo)))

    def firsts(asked: Column) -> Column:
        """The first question of each key."""
        place = lambda keys, x: F.get(asked, (F.array_position(keys, x) - 1).cast("int"))["q"]
        return let(F.transform(asked, lambda x: x["key"]), lambda keys: F.transform(F.slice(F.array_distinct(keys), 1, limit), lambda x: place(keys, x)))

    return let(keyed, firsts)


def enough(c: Column | str) -> Column:
    """Whether a sufficiency reply says yes: its tag, else its beginning; no otherwise."""
    tag = text_between(c, "enough")
    return F.when(tag.isNotNull(), F.startswith(F.lower(tag), F.lit("y"))).otherwise(F.startswith(F.lower(strip(c)), F.lit("yes")))


def next_question(c: Column | str) -> Column:
    """A question reply: its tag, else the first line that ends with ``?``, else the first line."""
    tag = text_between(c, "question")
    lines = F.transform(F.split(col(c), r"\r\n|[\n\r]"), strip)
    asked = F.get(F.filter(lines, lambda x: F.endswith(x, F.lit("?"))), F.lit(0))
    first = strip(F.element_at(F.split(strip(c), "\n"), 1))
    return F.when(tag != "", tag).otherwise(F.coalesce(asked, F.when(first != "", first), F.lit("Is the claim true?")))


def next_answer(c: Column | str) -> Column:
    tag = text_between(c, "answer")
    return F.when(tag != "", tag).otherwise(strip(c))


def history_text(history: Column | str) -> Column:
    """``Q1: ...`` and ``A1: ...`` lines of an array of ``q, a``."""
    lines = F.transform(col(history), lambda x, i: F.concat(F.lit("Q"), (i + 1).cast("string"), F.lit(": "), x["q"], F.lit("\nA"), (i + 1).cast("string"), F.lit(": "), x["a"]))
    return F.when(F.size(col(history)) > 0, F.array_join(lines, "\n")).otherwise("(no questions asked yet)")


def criteria(c: Column | str) -> Column:
    """0 or 1 for each atomicity criterion by the first line that begins with it; null if one is missing."""
    lines = F.transform(F.split(F.lower(strip(c)), r"\r\n|[\n\r]"), strip)
    first = lambda name: F.get(F.filter(lines, lambda x: F.startswith(x, F.lit(name))), F.lit(0))
    found = [first(n) for n in CRITERIA]
    scores = F.array(*[F.contains(x, F.lit("yes")).cast("int") for x in found])
    return F.when(~F.exists(scores, lambda s: s.isNull()), scores)


def coverage_code(c: Column | str) -> Column:
    """0 supported, 1 refuted, 2 not enough information by the first that the text holds, in this order; else null."""
    low = F.lower(col(c))
    return F.when(F.contains(low, F.lit("supported")), 0).when(F.contains(low, F.lit("refuted")), 1).when(F.contains(low, F.lit("not enough")) | F.contains(low, F.lit("not_enough")), 2)


def coverage_verdict(c: Column | str) -> Column:
    """As ``coverage_code`` but in words, and ``not enough information`` for all other text."""
    low = F.lower(col(c))
    return F.when(low.isNull(), F.lit(None)).when(F.contains(low, F.lit("supported")), "supported").when(F.contains(low, F.lit("refuted")), "refuted").otherwise("not enough information")


